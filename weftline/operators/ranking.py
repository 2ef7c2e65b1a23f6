"""Ranking: grouping hits to parents, cut-offs, diversity, and context under a budget."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import distinct_bigrams, jaccard


def to_parents(hits: DataFrame, key: str = "parent_id") -> DataFrame:
    """Hits (query_id, parent_id, id, rank, score, parent_text) as one row a parent: best child, its score, first rank, children in order.

    The best child has the highest score, the earliest of equal ones; the parent text is the longest that came with a child.
    """
    best = F.max_by(F.struct("id", "score"), F.struct("score", -F.col("rank")))
    grouped = hits.groupBy("query_id", key).agg(best.alias("best"), F.max_by("parent_text", F.length("parent_text")).alias("parent_text"), F.min("rank").alias("first_rank"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("ordered"))
    return grouped.select("query_id", key, F.col("best.id").alias("best_id"), F.col("best.score").alias("score"), "parent_text", "first_rank", F.transform("ordered", lambda c: c["id"]).alias("children"))


def top_parents(parents: DataFrame, limit: int = 20) -> DataFrame:
    """The best ``limit`` parents of each query by score, then by first rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank")
    return parents.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def adaptive_cut(hits: DataFrame, cap: int | Column = 6, drop: float = 0.05, base: float | Column = 0.30, low: float | Column = 0.20, high: float | Column = 0.50, floor: float | None = None) -> DataFrame:
    """The leading rows of each query's (query_id, id, score) that are worth keeping, best first, as windows only.

    The list ends one row past the first gap larger than ``drop``, or before the first score under a least one if
    that comes no later, and at ``cap``. The least score is ``floor`` if given, else ``base``, lowered by 0.05 for a top
    score above 0.8, raised by 0.10 for one under 0.3, within ``low`` and ``high``. A single row is joined by a second
    above the least score. Lists of one row pass.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    whole = Window.partitionBy("query_id")
    rows = hits.withColumn("place", F.row_number().over(by_score) - 1).withColumn("gap", F.lag("score").over(by_score) - F.col("score"))
    top = F.max("score").over(whole)
    least = lit(floor) if floor is not None else F.when(top > 0.8, F.greatest(lit(low), lit(base) - 0.05)).when(top < 0.3, F.least(lit(high), lit(base) + 0.10)).otherwise(lit(base))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("least", least)
    rows = rows.withColumn("cliff", F.coalesce(F.min(F.when(F.col("gap") > drop, F.col("place"))).over(whole), F.col("n")))
    rows = rows.withColumn("under", F.min(F.when(F.col("score") < F.col("least"), F.col("place"))).over(whole))
    rows = rows.withColumn("second", F.max(F.when(F.col("place") == 1, F.col("score"))).over(whole))
    cut = F.when(F.col("under").isNotNull() & (F.col("under") <= F.col("cliff")), F.col("under")).otherwise(F.col("cliff") + 1)
    keep = F.greatest(F.lit(1), F.least(cut, lit(cap), F.col("n")))
    keep = F.when((keep == 1) & (F.col("second") > F.col("least")), 2).otherwise(keep)
    keep = F.when(F.col("n") <= 1, F.col("n")).otherwise(keep)
    return rows.where(F.col("place") < keep).select(*hits.columns, (F.col("place") + 1).alias("kept_rank"))


def diverse(rows: DataFrame, keep: int = 6, balance: float = 0.7, most: float = 0.85) -> DataFrame:
    """Of each query's (query_id, doc_id, id, score, text) at most ``keep`` rows, by maximal marginal relevance.

    A row's worth is balance x score - (1 - balance) x its largest bigram similarity to a chosen row of the same document;
    rows at or above ``most`` are out. The choice is one after the other, so a query's candidates (a ranked list that an
    earlier step has cut) meet in one task; the similarities are worked out before, in Spark.
    """
    sized = rows.withColumn("grams", distinct_bigrams(F.col("text")))
    left, right = (sized.select("query_id", "doc_id", F.col("id").alias(c), F.col("grams").alias(f"g{c}")) for c in "ab")
    pairs = left.join(right, ["query_id", "doc_id"]).where("a != b").select("query_id", "a", F.struct("b", jaccard(F.col("ga"), F.col("gb")).alias("s")).alias("near"))
    near = pairs.groupBy("query_id", F.col("a").alias("id")).agg(F.collect_list("near").alias("near"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True])
        score = dict(zip(group["id"], group["score"]))
        like = {i: ({x["b"]: x["s"] for x in n} if n is not None else {}) for i, n in zip(group["id"], group["near"])}
        chosen: list = []
        while score and len(chosen) < keep:
            worst = {i: max((like[i].get(c, 0.0) for c in chosen), default=0.0) for i in score}
            allowed = [i for i in score if worst[i] < most] if chosen else list(score)
            if not allowed:
                break
            best = max(allowed, key=lambda i: balance * score[i] - (1 - balance) * worst[i])
            chosen.append(best)
            del score[best]
        out = group.set_index("id").loc[chosen].reset_index()
        return pd.DataFrame({"query_id": out["query_id"], "id": out["id"], "doc_id": out["doc_id"], "score": out["score"], "pick": range(1, len(out) + 1)})

    kinds = dict(rows.dtypes)
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, doc_id {kinds['doc_id']}, score double, pick int"
    return rows.drop("text").join(near, ["query_id", "id"], "left").groupBy("query_id").applyInPandas(choose, schema)


def fit_budget(rows: DataFrame, size: Column, order: list, key: str = "query_id", budget: int = 6000, least_part: int = 200) -> DataFrame:
    """Rows of each key in order while their running size fits; the first that does not is cut if over ``least_part`` is left.

    Adds ``used`` (size kept of the row) and ``partial``.
    """
    w = Window.partitionBy(key).orderBy(*order)
    running = rows.withColumn("size", size.cast("long")).withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("upto") - F.col("size")
    left = F.lit(budget) - before
    over = F.col("upto") > budget
    first_over = F.row_number().over(Window.partitionBy(key, over).orderBy(*order)) == 1
    marked = running.withColumn("partial", over).withColumn("first_over", first_over)
    used = F.when(~F.col("partial"), F.col("size")).otherwise(left)
    return marked.where(~F.col("partial") | (F.col("first_over") & (left > least_part))).withColumn("used", used).drop("upto", "first_over", "size")


#: A parent's header, the mark of a cut entry, the rule between entries, characters of a snippet.
HEADER, CUT, RULE, SNIPPET = "【文档 {}】{}（段落 {}）", "\n...(截断)", "\n\n" + "=" * 40 + "\n\n", 1500


def context_entries(parents: DataFrame, documents: DataFrame, budget: int = 6000) -> DataFrame:
    """(query_id, place, doc_id, title, score, entry, snippet, partial): what of each query's parents goes into its context.

    Parents (query_id, doc_id, parent_idx, score, text) are taken best first (ties by document and parent); those
    without a text or a document (doc_id, title) are left out. An entry is a header with its number, the title and the
    parent's number from 1 (a null one counts as 0), and the text. Entries go in while they fit in ``budget``; the first
    that does not is cut and marked if over 200 characters are left, and ends the context. Rules between entries and
    the mark do not count. A null title is empty.
    """
    named = documents.select("doc_id", F.coalesce("title", F.lit("")).alias("title"))
    rows = parents.where(F.coalesce("text", F.lit("")) != "").join(named, "doc_id")
    order = [F.desc("score"), F.col("doc_id"), F.col("parent_idx")]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    a, b, c, d = (F.lit(x) for x in HEADER.split("{}"))
    placed = rows.withColumn("place", place)
    header = F.concat(a, F.col("place").cast("string"), b, F.col("title"), c, (F.coalesce("parent_idx", F.lit(0)) + 1).cast("string"), d)
    entries = placed.withColumn("entry", F.concat(header, F.lit("\n"), F.col("text")))
    kept = fit_budget(entries, F.length("entry"), [F.col("place")], budget=budget)
    entry = F.when(F.col("partial"), F.concat(F.col("entry").substr(F.lit(1), F.col("used").cast("int")), F.lit(CUT))).otherwise(F.col("entry"))
    return kept.select("query_id", "place", "doc_id", "title", "score", entry.alias("entry"), F.substring("text", 1, SNIPPET).alias("snippet"), "partial")


def contexts(entries: DataFrame) -> DataFrame:
    """(query_id, context, sources): the entries of ``context_entries`` as one text, with how many there are."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "entry")))
    return entries.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["entry"]), RULE).alias("context"), F.count(F.lit(1)).alias("sources"))


def rerank(hits: DataFrame, scorer: Column, k: int) -> DataFrame:
    """The best ``k`` of each query by a model's logit through the logistic function; only the leading rows are scored.

    ``scorer`` is a column, usually a Pandas UDF over query and text; rows it has no value for keep their own order at
    the end. One candidate keeps its score.
    """
    pool = min(max(2 * k, 10), 30)
    count = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    led = hits.withColumn("n", count).where(F.col("rank") <= pool)
    scored = led.withColumn("rerank_score", F.when(F.col("n") == 1, F.col("score")).otherwise(1 / (1 + F.exp(-scorer))))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).drop("n")


def overlap_scorer(query: Column, text: Column) -> Column:
    """The stand-in for a cross-encoder: the share of the query's words that the text holds, as a logit."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))
    share = F.size(F.filter(words, lambda w: F.contains(F.lower(text), w))) / F.greatest(F.size(words), F.lit(1))
    return 4 * share - 2


def distinct_sources(rows: DataFrame, key: str = "query_id", order: str = "rank") -> DataFrame:
    """The first row of each source: by document id, else title, else the whole row."""
    name = F.coalesce(F.concat(F.lit("i:"), F.col("doc_id").cast("string")), F.concat(F.lit("t:"), F.col("title")), F.to_json(F.struct(*rows.columns)))
    w = Window.partitionBy(key, "__source").orderBy(order)
    return rows.withColumn("__source", name).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__source", "__n")


def parent_sources(children: DataFrame, text_chars: int = 1500) -> DataFrame:
    """Children (query_id, doc_id, parent_idx, chunk_index, rank, score, channels, text) as one source a parent.

    (query_id, doc_id, parent_idx, chunk_ids, matched, channels, first_rank, score, snippet): distinct chunk ids (ascending) and
    channels, how many matched (rows, where no chunk has an id), the best child's score within 0 and 1, and the
    longest text, cut. A parent's children are part of a ranked list that an earlier step has cut.
    """
    score = F.max(F.when(F.abs("score") < float("inf"), F.col("score").cast("double")))
    ids = F.array_sort(F.collect_set("chunk_index"))
    out = children.groupBy("query_id", "doc_id", F.coalesce("parent_idx", F.lit(0)).alias("parent_idx")).agg(
        ids.alias("chunk_ids"), F.when(F.size(ids) > 0, F.size(ids)).otherwise(F.count(F.lit(1)).cast("int")).alias("matched"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("channels")))).alias("channels"), F.min("rank").alias("first_rank"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)))).alias("score"),
        F.substring(F.coalesce(F.max_by("text", F.length("text")), F.lit("")), 1, text_chars).alias("snippet"),
    )
    return out


def in_reading_order(parents: DataFrame, key: str = "query_id") -> DataFrame:
    """Each query's parents with ``place``: by document, then by their order in it."""
    return parents.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("doc_id", "parent_idx")))


def looked_up(sources: DataFrame, chunks: DataFrame, documents: DataFrame, most: int = 1200) -> DataFrame:
    """(doc_id, context): of each source (doc_id, chunk_ids) the chunks (doc_id, chunk_index, chunk) that it names, else the beginning of its document (doc_id, text); each text once, blanks left out."""
    named = sources.select("doc_id", F.explode("chunk_ids").alias("chunk_index")).where("chunk_index >= 0").distinct()
    found = named.join(chunks, ["doc_id", "chunk_index"]).select("doc_id", F.trim("chunk").alias("context"))
    rest = sources.select("doc_id").distinct().join(named.select("doc_id").distinct(), "doc_id", "left_anti").join(documents, "doc_id")
    return found.unionByName(rest.select("doc_id", F.trim(F.substring("text", 1, most)).alias("context"))).where("context <> ''").distinct()


def candidate_rows(hits: DataFrame) -> DataFrame:
    """Chunks (query_id, rank, id, doc_id, parent_id, parent_idx, chunk_index, title, category, text, score, and channel scores where they are known) as candidates, every missing field with its default.

    An id is ``doc_id:chunk_index`` where none is given, a parent ``doc_id_para_parent_idx``; indexes are -1, texts
    empty, scores 0, the hybrid score that of the row, channels an empty array.
    """
    has = lambda name, kind: F.col(name) if name in hits.columns else F.lit(None).cast(kind)
    text = lambda name: F.coalesce(has(name, "string"), F.lit(""))
    number = lambda name: F.coalesce(has(name, "double"), F.lit(0.0))
    own = F.coalesce(F.nullif(has("id", "string").cast("string"), F.lit("")), F.concat_ws(":", F.col("doc_id").cast("string"), has("chunk_index", "int").cast("string")))
    parent = F.coalesce(F.nullif(has("parent_id", "string"), F.lit("")), F.concat(F.col("doc_id").cast("string"), F.lit("_para_"), F.coalesce(has("parent_idx", "int"), F.lit(0)).cast("string")))
    return hits.select(
        "query_id", "rank", own.alias("id"), "doc_id", parent.alias("parent_id"), F.coalesce(has("parent_idx", "int"), F.lit(-1)).alias("parent_idx"), F.coalesce(has("chunk_index", "int"), F.lit(-1)).alias("chunk_index"),
        *[text(c).alias(c) for c in ("title", "category", "text")], *[number(c).alias(c) for c in ("score", "vector_score", "sparse_score")],
        F.when(number("hybrid_score") != 0, number("hybrid_score")).otherwise(number("score")).alias("hybrid_score"), number("keyword_score").alias("keyword_score"), number("rerank_score").alias("rerank_score"), text("rerank_model").alias("rerank_model"),
        F.coalesce(has("channels", "array<string>"), F.array().cast("array<string>")).alias("channels"),
    )


def source_rows(candidates: DataFrame) -> DataFrame:
    """``candidate_rows`` as sources: the document's id as id, and itself as parent where no other is known."""
    return candidates.select("query_id", "rank", F.col("doc_id").alias("id"), "title", "category", "chunk_index", F.col("score").alias("matched_score"), "parent_id", "vector_score", "sparse_score", "hybrid_score", "keyword_score", "rerank_score", "channels")


def parent_candidates(candidates: DataFrame, documents: DataFrame, children: bool = True) -> DataFrame:
    """``candidate_rows`` as one candidate a parent, with its document's title and category (doc_id, title, category) before the best chunk's own, and its children by rank.

    Chunk ids are distinct and ascending (those of -1 do not count; without any, the rows do), channels distinct; scores
    and the text are those of the best chunk (the largest score, then the first rank). A parent's children are what one
    list found, so they are bounded by its length. Ranks count parents by their first child.
    """
    best = F.max_by(F.struct("title", "category", "text", "score", "vector_score", "sparse_score", "hybrid_score", "keyword_score", F.col("rank").alias("best_child_rank")), F.struct("score", -F.col("rank")))
    ids = F.array_sort(F.collect_set(F.when(F.col("chunk_index") >= 0, F.col("chunk_index"))))
    kids = F.array_sort(F.collect_list(F.struct("rank", "id", "chunk_index", "score")))
    groups = candidates.groupBy("query_id", "doc_id", "parent_id", "parent_idx").agg(best.alias("b"), ids.alias("chunk_ids"), F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels"), F.min("rank").alias("first_child_rank"), kids.alias("children"))
    named = documents.select("doc_id", F.nullif("title", F.lit("")).alias("__title"), F.nullif("category", F.lit("")).alias("__category"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first_child_rank"))
    rows = groups.join(named, "doc_id", "left").select(
        "query_id", place.cast("int").alias("rank"), F.col("parent_id").alias("id"), "doc_id", "parent_idx", F.coalesce("__title", "b.title").alias("title"), F.coalesce("__category", "b.category").alias("category"),
        F.col("b.text").alias("parent_text"), F.when(F.size("chunk_ids") > 0, F.size("chunk_ids")).otherwise(F.col("n")).cast("long").alias("matched"), "chunk_ids", "first_child_rank", "b.best_child_rank",
        F.col("b.score").alias("matched_score"), "b.vector_score", "b.sparse_score", "b.hybrid_score", "b.keyword_score", "channels", "children",
    )
    return rows if children else rows.drop("children")
