"""JSON data sets, bulk texts, and sinks for state, reports and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array, of an object with ``samples``, ``results`` or ``data`` (the first that is a list), or of JSON lines."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    kind = f"array<struct<{schema}>>"
    as_array = F.when(F.col("v").startswith("["), F.from_json("v", kind))
    holder = F.from_json("v", f"struct<samples: {kind}, results: {kind}, data: {kind}>")
    lines = F.transform(F.filter(F.split("v", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{schema}>"))
    rows = F.coalesce(as_array, holder["samples"], holder["results"], holder["data"], lines)
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def titled_texts(df: DataFrame, text: str = "value", most: int = 40) -> DataFrame:
    """Blank-line separated texts as documents, titled by their first line."""
    parts = df.select(F.posexplode(F.filter(F.transform(F.split(F.col(text), r"\n\s*\n+"), lambda p: F.trim(p)), lambda p: p != "")).alias("pos", "text"))
    return parts.withColumn("title", F.substring(F.element_at(F.split("text", "\n"), 1), 1, most))


def normalised_samples(df: DataFrame) -> DataFrame:
    """Evaluation samples under their common names, with why one cannot be used.

    Fields may come as question, query or user_input; answer or response; contexts, retrieved_contexts or
    retrieved_docs; ground_truth, groundTruth or reference.
    """
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None))
    contexts = F.filter(F.coalesce(first("contexts", "retrieved_contexts", "retrieved_docs").cast("array<string>"), F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    out = df.select(first("question", "query", "user_input").alias("question"), first("answer", "response").alias("answer"), contexts.alias("contexts"), first("ground_truth", "groundTruth", "reference").alias("ground_truth"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reasons = F.concat_ws("; ", F.when(blank(F.col("question")), "no question"), F.when(blank(F.col("answer")), "no answer"), F.when(F.size("contexts") == 0, "no contexts"))
    return out.withColumn("reasons", reasons).withColumn("valid", reasons == "")


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with rows replaced or added by ``changes`` (columns alike, the last one of a key by ``seq`` wins)."""
    last = changes.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))).where("__n = 1").drop("__n", "seq")
    return current.join(last.select(*key), key, "left_anti").unionByName(last)


def vector_sink(folder: str, vector: str = "vector") -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` is given to write a stream of rows with vectors to ``folder``.

    Rows whose vector is null or empty are left out. Each batch is a partition of its own that is written anew, all or
    nothing, so a batch that is replayed after a failure changes nothing. ``vector_rows`` reads the folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.where(F.size(F.col(vector)) > 0).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def vector_rows(spark: SparkSession, folder: str, key: list[str], seq: str | None = None) -> DataFrame:
    """The rows of a ``vector_sink`` as they stand: of each key the one of the newest batch (within it, of the largest ``seq``)."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    newest = [F.desc("batch"), *([F.desc(seq)] if seq else []), F.desc(F.xxhash64(*rows.columns))]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where("__n = 1").drop("__n", "batch")


def synchronised(current: DataFrame, dirty: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``dirty`` put in, and without those whose key is not in ``ids``."""
    return current.join(dirty.select(key), key, "left_anti").unionByName(dirty).join(ids.select(key), key, "left_semi")


def write_snapshot(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet, all or nothing by the job's commit."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with every field quoted, quotes doubled, line breaks as spaces."""
    flat = [F.regexp_replace(c, r"[\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', quote='"')


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def markdown_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of a Markdown table, pipes escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def conversation_lines(turns: DataFrame, text: Column, role: Column, style: str = "text") -> DataFrame:
    """Turns as export lines (text, Markdown or HTML), without welcome and blank ones."""
    from weftline.functions.text import html_escaped

    name = F.when(role == "user", "User").otherwise("Assistant")
    line = {"text": F.concat(name, F.lit(": "), text), "markdown": F.concat(F.lit("**"), name, F.lit("**\n\n"), text), "html": F.concat(F.lit("<p><b>"), name, F.lit("</b> "), html_escaped(text), F.lit("</p>"))}[style]
    return turns.where((F.trim(text) != "") & (role != "welcome")).withColumn("line", line)
