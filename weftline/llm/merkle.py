"""Merkle manifest of a dataset: leaves by group, a tree of runs of three, proofs and folding.

Rows are numbered within their group by a range partitioning and sums over its partitions, so that a group may hold
any part of the rows. Nodes are then taken span by span: a span of the tree, ``HEIGHT`` levels high, is built by
one task, its top is a node of the next tier, and so on until each group has one node; the groups' nodes form the last
tree in the same way. On the way down every span gets the siblings above it once.

In a span each parent keeps a copy of its hash state before each of its children. A changed leaf is folded to the root
by resuming the state that its place has, with the new digest and the siblings to its right only; what is above the
span is resumed in the same way, from states that hold the siblings to the left.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialise

#: Children of a parent, levels of a span (which has ``WIDTH ** HEIGHT`` nodes).
WIDTH, HEIGHT = 3, 6

_PATH = "array<struct<before: string, after: string>>"


def encoded(column: Column) -> Column:
    """A value as ``-`` if null, else its UTF-8 bytes' number, a colon and the value."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*columns: Column) -> Column:
    """The digest of a row: lower-case hex of the hash of its encoded values."""
    return F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256)


def levels(nodes: int) -> int:
    """Levels of runs until one node is left."""
    out = 0
    while nodes > 1:
        nodes, out = -(-nodes // WIDTH), out + 1
    return out


class Span:
    """Some levels of a tree over neighbouring nodes, with the hash states before each child."""

    def __init__(self, digests: list[str], height: int):
        self.rows, self.states = [digests], []
        for _ in range(height):
            row, kept, above = self.rows[-1], [], []
            for at in range(0, len(row), WIDTH):
                state = sha256()
                for digest in row[at : at + WIDTH]:
                    kept.append(state.copy())
                    state.update(digest.encode())
                above.append(state.hexdigest())
            self.rows.append(above)
            self.states.append(kept)

    @property
    def top(self) -> str:
        return self.rows[-1][0]

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """Level by level, the digests before and after the node's own in its run, joined."""
        out = []
        for row in self.rows[:-1]:
            first = at - at % WIDTH
            out.append(("".join(row[first:at]), "".join(row[at + 1 : first + WIDTH])))
            at //= WIDTH
        return out

    def folded(self, at: int, digest: str) -> str:
        """The top with ``digest`` in place of node ``at``."""
        for row, states in zip(self.rows, self.states):
            state = states[at].copy()
            state.update(digest.encode())
            for right in row[at + 1 : at - at % WIDTH + WIDTH]:
                state.update(right.encode())
            digest, at = state.hexdigest(), at // WIDTH
        return digest


def _numbered(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``idx``, the place in its group by ``order``, and ``total``, the group's size; both counted by ranges."""
    ids = "__run"
    run = materialise(nodes.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn(ids, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(ids), 33)
    held = run.groupBy(group, part.alias("__part")).agg(F.count(F.lit(1)).alias("n"), F.min(ids).alias("first"))
    by = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = held.select(group, "__part", (before - F.col("first")).alias("__shift"), F.sum("n").over(by).alias("total"))
    return run.withColumn("__part", part).join(places, [group, "__part"]).withColumn("idx", F.col(ids) + F.col("__shift")).drop(ids, "__part", "__shift")


def _sorted(table: pa.Table, height: int) -> tuple[pa.Table, Span]:
    table = table.sort_by("idx")
    return table, Span(table.column("digest").to_pylist(), min(height, levels(table.column("total")[0].as_py())))


def _tiers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` (grp, idx, total, digest) and the tiers above them, until each group has one node."""
    width = WIDTH**height

    def up(table: pa.Table) -> pa.Table:
        table, span = _sorted(table, height)
        total = -(-table.column("total")[0].as_py() // width)
        return pa.table([table.column("grp")[:1], pa.array([table.column("idx")[0].as_py() // width]), pa.array([total]), pa.array([span.top])], ["grp", "idx", "total", "digest"])

    out = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        below = out[-1].select("grp", "idx", "total", "digest", F.expr(f"idx div {width}").alias("span"))
        out.append(materialise(below.groupBy("grp", "span").applyInArrow(up, "grp string, idx long, total long, digest string")))
        most = -(-most // width)
    return out


def _paths(tiers: list[DataFrame], top: DataFrame, height: int) -> DataFrame:
    """(grp, idx, subroot, path) of the nodes of the lowest of ``tiers``, from those of the highest."""

    def down(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, span = _sorted(nodes, height)
        path, n = above.column("path")[0].as_py(), nodes.num_rows
        paths = [[{"before": b, "after": a} for b, a in span.siblings(i)] + path for i in range(n)]
        return pa.table([nodes.column("grp"), nodes.column("idx"), pa.array([above.column("subroot")[0].as_py()] * n, pa.string()), pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))], ["grp", "idx", "subroot", "path"])

    out = top
    for nodes in reversed(tiers[:-1]):
        spans = nodes.withColumn("span", F.expr(f"idx div {WIDTH**height}")).groupBy("grp", "span")
        out = spans.cogroup(out.withColumn("span", F.col("idx")).groupBy("grp", "span")).applyInArrow(down, f"grp string, idx long, subroot string, path {_PATH}")
    return out


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, altered: dict[str, Column] | None = None, when: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(order column, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of ``docs``.

    A leaf is the hash of ``columns``; leaves of a ``group`` ascend by ``order`` (null first, then the digest; rows
    equal in both are interchangeable), groups by their bytes, null first. ``proof_sha256`` is the hash of all siblings
    from the leaf to the root. ``folded_root`` is the root that follows from the row with the values ``altered`` where
    ``when`` holds (nulls count as not), or from the row as it is; ``verified`` tells whether it is the root. A table of
    one row has its leaf as root and the hash of nothing as proof; an empty one has no rows. Other columns are not
    looked at. ``height`` is that of a span; it does not change the result.
    """
    named = lambda c: F.col(f"`{c}`")
    own = leaf(*[named(c) for c in columns])
    changed = leaf(*[(altered or {}).get(c, named(c)) for c in columns]) if altered else own
    grp = F.coalesce(F.concat(F.lit("="), named(group).cast("string")), F.lit(""))
    # The number among equal rows is fixed by being written: one row may stand in a third of the table.
    leaves = materialise(docs.select(named(order).alias("key"), grp.alias("grp"), own.alias("digest"), (F.when(when, changed) if when is not None else changed).alias("new"), F.monotonically_increasing_id().alias("nth")))
    nodes = materialise(_numbered(leaves, "grp", ["key", "digest", "nth"]).select("grp", "idx", "total", "digest", "key", "new"))
    tiers = _tiers(nodes, height)
    ends = tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    tops = materialise(_numbered(ends, "grp", ["name"]))
    groups = _tiers(tops, height)
    root = groups[-1].select("digest").first()
    if root is None:
        return docs.limit(0).select(named(order), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    root = root["digest"]
    start = groups[-1].select("grp", "idx", F.lit("").alias("subroot"), F.array().cast(_PATH).alias("path"))
    found = _paths(groups, start, height).join(tops.select("idx", F.col("name"), F.col("digest").alias("top")), "idx")
    above = _paths(tiers[1:] if len(tiers) > 1 else tiers, found.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), F.col("top").alias("subroot"), "path"), height)

    def fold(rows: pa.Table, path: pa.Table) -> pa.Table:
        rows, span = _sorted(rows, height)
        outer = path.column("path")[0].as_py()
        states = [sha256(p["before"].encode()) for p in outer]
        rest, after = "".join(p["before"] + p["after"] for p in outer), [p["after"].encode() for p in outer]
        proofs, roots = [], []
        for i, (old, new) in enumerate(zip(span.rows[0], rows.column("new").to_pylist())):
            proofs.append(sha256(("".join(b + a for b, a in span.siblings(i)) + rest).encode()).hexdigest())
            digest = span.folded(i, new or old)
            for state, right in zip(states, after):
                state = state.copy()
                state.update(digest.encode())
                state.update(right)
                digest = state.hexdigest()
            roots.append(digest)
        n = rows.num_rows
        return pa.table([rows.column("key"), rows.column("digest"), pa.array([path.column("subroot")[0].as_py()] * n), pa.array([root] * n), pa.array(proofs), pa.array(roots), pa.array([x == root for x in roots])], [order, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    spans = nodes.withColumn("span", F.expr(f"idx div {WIDTH**height}")).groupBy("grp", "span")
    return spans.cogroup(above.withColumn("span", F.col("idx")).groupBy("grp", "span")).applyInArrow(fold, f"`{order}` {docs.schema[order].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
