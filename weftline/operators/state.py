"""Keyed state, conversations and memory, as queries over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import snippet
from weftline.operators.operations import last_n


def hash_current(log: DataFrame, by: list[str], op: str, *newest_first: Column) -> DataFrame:
    """The fields as they stand after all sets and deletes of a log: the newest entry of each, unless it deletes."""
    return last_n(log, by, 1, *newest_first).where(F.col(op) != "del")


def set_members(log: DataFrame, key: str, member: str, op: str, *newest_first: Column) -> DataFrame:
    """(key, member) of sets after all adds and removes."""
    return hash_current(log, [key, member], op, *newest_first).select(key, member)


def list_range(rows: DataFrame, by: list[str], start: int, stop: int, *order: Column) -> DataFrame:
    """Rows of each list from ``start`` to ``stop``, both included; negative places count from the end."""
    w = Window.partitionBy(*by)
    placed = rows.withColumn("place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    at = lambda x: F.lit(x) if x >= 0 else F.col("__n") + x
    return placed.where((F.col("place") >= at(start)) & (F.col("place") <= at(stop))).drop("__n")


def history_within(turns: DataFrame, conversation: str, turn: str, text: str, most_turns: int = 12, each: int = 2000, most_chars: int = 6000) -> DataFrame:
    """The newest non-empty turns of each conversation within the budget, each cut to ``each`` characters; always at least one.

    Lengths are at least one, so once the sum is over the budget it stays so, and a prefix rule is exact.
    """
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    rows = turns.where(F.length(F.trim(F.col(text))) > 0).withColumn("kept", F.substring(F.col(text), 1, each)).withColumn("back", F.row_number().over(w))
    total = F.sum(F.length("kept")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("total", total).where((F.col("back") <= most_turns) & ((F.col("back") == 1) | (F.col("total") <= most_chars))).drop("total")


def compaction(turns: DataFrame, conversation: str, turn: str, role: str, recent: int = 12) -> DataFrame:
    """Each turn with what becomes of it: system turns and the newest stay, earlier ones go into a summary."""
    w = Window.partitionBy(conversation, F.col(role) == "system").orderBy(F.desc(turn))
    return turns.withColumn("part", F.when(F.col(role) == "system", "system").when(F.row_number().over(w) <= recent, "recent").otherwise("summarised"))


def session_digest(turns: DataFrame, conversation: str, turn: str, role: str, text: str, last: int = 6) -> DataFrame:
    """The last user and assistant texts among the newest turns, white space squeezed, cut to 60 and 120 characters."""
    recent = last_n(turns, [conversation], last, F.desc(turn))
    flat = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    said = lambda who, n: F.substring(F.max_by(F.when(F.col(role) == who, flat), F.when(F.col(role) == who, F.col(turn))), 1, n)
    return recent.groupBy(conversation).agg(said("user", 60).alias("last_user"), said("assistant", 120).alias("last_assistant"))


def runs(events: DataFrame, by: list[str], value: str, *order: Column) -> DataFrame:
    """Runs of equal consecutive values: (by, run, value, length), by gaps and islands."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    numbered = events.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))) if "__new" in events.columns else events.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run", value).agg(F.count(F.lit(1)).alias("length"))


def client_history(turns: DataFrame, conversation: str, turn: str, role: str, text: str, most: int = 20) -> DataFrame:
    """The last non-empty user and assistant turns; of turns by the same role in a row the last, and no user turn at the end."""
    said = turns.where(F.col(role).isin("user", "assistant") & (F.trim(F.col(text)) != ""))
    recent = last_n(said, [conversation], most, F.desc(turn))
    after = F.lead(role).over(Window.partitionBy(conversation).orderBy(turn))
    ends = recent.withColumn("__after", after).where(F.col("__after").isNull() | (F.col("__after") != F.col(role)))
    return ends.where(~(F.col("__after").isNull() & (F.col(role) == "user"))).drop("__after")


def reconcile(server: DataFrame, local: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """Server rows with ``fill`` taken from the local copy where the server has none, and local rows that it lacks."""
    copy = local.select(key, *[F.col(c).alias(f"__{c}") for c in fill])
    merged = server.join(copy, key, "left").select(key, *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in fill], F.lit("server").alias("origin"))
    return merged.unionByName(local.join(server.select(key), key, "left_anti").select(key, *fill, F.lit("local").alias("origin")))


def live_titles(saved: DataFrame, titles: DataFrame, key: str, title: str) -> DataFrame:
    """Saved rows with their current title, or the one saved with them where there is none any more."""
    now = titles.select(key, F.col(title).alias("__now"))
    return saved.join(now, key, "left").withColumn(title, F.coalesce(F.nullif("__now", F.lit("")), F.col(title))).drop("__now")


def memory_score(query: Column, content: Column, similarity: Column, accesses: Column) -> Column:
    """0.3 x share of the query's words in the content + 0.7 x similarity + 0.01 x accesses (at most 10)."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 1)
    found = F.size(F.filter(words, lambda w: F.contains(F.lower(content), w)))
    return 0.3 * F.when(F.size(words) > 0, found / F.size(words)).otherwise(0.0) + 0.7 * similarity + 0.01 * F.least(accesses, F.lit(10))


def age_bucket(seconds: Column) -> Column:
    """How long ago, in words' buckets."""
    return F.when(seconds < 60, "now").when(seconds < 3600, "minutes").when(seconds < 86400, "hours").when(seconds < 7 * 86400, "days").otherwise("date")


def short_term(turns: DataFrame, conversation: str, turn: str, most: int = 8, full: int = 6, oldest: int = 3) -> DataFrame:
    """The newest ``most`` turns of each conversation; of more than ``full``, the ``oldest`` ones are to be compressed (``part``)."""
    back = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))
    kept = turns.withColumn("__back", back).where(F.col("__back") <= most)
    n = F.count(F.lit(1)).over(Window.partitionBy(conversation))
    return kept.withColumn("part", F.when((n > full) & (F.col("__back") > n - oldest), "compressed").otherwise("kept")).drop("__back")


def deleted(rows: DataFrame, gone: DataFrame, own: str, parent: str) -> DataFrame:
    """``rows`` without those whose own id or parent is in ``gone`` (id)."""
    ids = gone.select(F.col("id").alias("__gone")).distinct()
    left = rows.join(ids, F.col(own) == F.col("__gone"), "left_anti")
    return left.join(ids, F.col(parent) == F.col("__gone"), "left_anti")


def flattened(groups: DataFrame, children: str = "children") -> DataFrame:
    """A tree of two levels, groups (value, label, children: array of struct(value, label)), as rows (value, label, parent); groups have no parent."""
    top = groups.select("value", "label", F.lit(None).cast("string").alias("parent"))
    return top.unionByName(groups.select(F.col("value").alias("parent"), F.explode(children).alias("c")).select("c.value", "c.label", "parent"))


def reindexed(index: DataFrame, rebuilt: DataFrame, category: str, which: str | None = None) -> DataFrame:
    """``index`` with the rows of one category replaced by those of ``rebuilt``; all of them where none is named."""
    if which is None:
        return rebuilt
    return index.where(~F.col(category).eqNullSafe(which)).unionByName(rebuilt.where(F.col(category) == which))


def vector_fields(df: DataFrame) -> DataFrame:
    """(field, kind, n, least, most): the columns that hold dense vectors (arrays of numbers) or sparse ones (maps to numbers), with how many and how long they are."""
    kinds = {name: "dense" if kind.startswith("array") else "sparse" for name, kind in df.dtypes if kind in ("array<float>", "array<double>") or (kind.startswith("map<") and kind.endswith((",float>", ",double>")))}
    sizes = df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), F.when(F.col(name).isNotNull(), F.size(name)).alias("size")) for name, kind in kinds.items()])).alias("x")).select("x.*")
    return sizes.groupBy("field", "kind").agg(F.count("size").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"))


def matched_conversations(conversations: DataFrame, messages: DataFrame, word: str) -> DataFrame:
    """(conv_id, preview) of the conversations (conv_id, title) that hold a word, in any case and without white space around it.

    A hit in the title comes first, with the title as preview; else the first message (conv_id, turn, text) that has the
    word, with what stands around its first hit. An empty word finds all, with an empty preview. A message's text is
    looked at where it is; only the first hit of each conversation is kept.
    """
    key = word.strip().lower()
    if not key:
        return conversations.select("conv_id", F.lit("").alias("preview"))
    hits = messages.where(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(key)))
    first = hits.groupBy("conv_id").agg(F.min_by(snippet(F.col("text"), key), F.col("turn")).alias("__text"))
    titled = F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(key))
    rows = conversations.join(first, "conv_id", "left").withColumn("preview", F.when(titled, F.col("title")).otherwise(F.col("__text")))
    return rows.where("preview IS NOT NULL").select("conv_id", "preview")
