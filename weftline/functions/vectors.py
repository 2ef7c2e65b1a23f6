"""Vector and sparse-vector expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a null, a length mismatch or a zero norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps from term to weight: shared terms over norms of all terms; 0 where either is empty or null."""
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    shared = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    return F.coalesce(F.when(norm(a) * norm(b) > 0, shared / (norm(a) * norm(b))), F.lit(0.0))


def sparse_arrays(m: Column) -> Column:
    """A map as struct(indices, values): positive values only, by numeric key."""
    kept = F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: v > 0)))
    return F.struct(F.transform(kept, lambda e: e["key"]).alias("indices"), F.transform(kept, lambda e: e["value"]).alias("values"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
