"""The retrieval pipeline as one lazy plan for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import rules
from weftline.operators import evaluation, hybrid, ranking, search
from weftline.tables import stored


def retrieve(queries: DataFrame, corpus: DataFrame, child_k: int = 50, parent_k: int = 20, least: float = 0.1) -> DataFrame:
    """Hits of both channels fused by reciprocal ranks, grouped to parents, cut adaptively: (query_id, id, score, kept_rank).

    ``queries`` has (query_id, vector); ``corpus`` has (id, vector, parent_id). The second channel is the cosine of the
    sparse vectors, the components of ``least`` or more. A parent is scored by its best child's cosine.
    """
    dense = search.exact_cosine(queries, corpus, child_k)
    sparse = search.exact_cosine(search.sparsified(queries, least), search.sparsified(corpus, least), child_k)
    fused = search.fuse_reciprocal(dense, sparse, child_k)
    scored = fused.select("query_id", "id", "rank").join(dense.select("query_id", "id", "score"), ["query_id", "id"]).join(corpus.select("id", "parent_id"), "id")
    parents = ranking.to_parents(scored.withColumn("parent_text", F.lit("")))
    best = ranking.top_parents(parents, parent_k).select("query_id", F.col("parent_id").alias("id"), "score")
    return ranking.adaptive_cut(best)


def evaluated(kept: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per-query metrics of what ``retrieve`` kept."""
    hits = kept.select("query_id", F.col("id").alias("doc_id"), F.col("kept_rank").alias("rank"))
    return evaluation.query_metrics(hits, relevant)


def answer_contexts(queries: DataFrame, passages: DataFrame, child_k: int = 20, keep: int = 6, budget: int = 6000) -> DataFrame:
    """(query_id, place, id, doc_id, score, used, partial): what each question's answer is to be drawn from, in reading order.

    ``queries`` has (query_id, query), ``passages`` (id, doc_id, parent_idx, text), one row a parent. Text search in both
    channels, reranking, the adaptive cut with the settings of the question's type, the diverse choice, reading order,
    and the character budget, in that order.
    """
    found = hybrid.weighted(hybrid.indexed(queries, "query_id", "query"), hybrid.indexed(passages, "id", "text"), child_k)
    hits = found.select("query_id", "id", "score", "rank").join(passages, "id").join(queries, "query_id")
    best = ranking.rerank(hits, ranking.overlap_scorer(F.col("query"), F.col("text")), child_k)
    settings = rules.type_settings(rules.question_type(F.col("query")))
    scored = best.select("query_id", "id", "doc_id", "parent_idx", "text", F.round("rerank_score", 9).alias("score"), settings.alias("s")).select("*", "s.*").drop("s")
    cut = ranking.adaptive_cut(scored, cap=F.col("cap"), base=F.col("base"), low=F.col("low"), high=F.col("high"))
    chosen = ranking.diverse(cut.select("query_id", "doc_id", "id", "score", "text"), keep).drop("doc_id", "score")
    rows = ranking.in_reading_order(chosen.join(cut, ["query_id", "id"]))
    return ranking.fit_budget(rows, F.length("text"), ["place"], budget=budget).select("query_id", "place", "id", "doc_id", "score", "used", "partial")


def search_knowledge(queries: DataFrame, passages: DataFrame, category: str | None = None, **options) -> DataFrame:
    """``answer_contexts`` over the passages of one category, or over all of them."""
    return answer_contexts(queries, passages.where(F.col("category") == category) if category else passages, **options)


def iterated(queries: DataFrame, find: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], rounds: int = 3, least: int = 3) -> DataFrame:
    """(query_id, doc_id, round): sources of each question over at most ``rounds`` rounds, each source with the round that first found it.

    ``find`` turns (query_id, query) into (query_id, doc_id); a question that has ``least`` sources in a round is done.
    ``rewrite`` gives the others their next wording, and leaves out those that have none. Only what is still open is
    asked again, and what a round found and left open is written down, so that no round is worked out again by a later one.
    """
    asked, out = queries.select("query_id", "query"), None
    for number in range(1, rounds + 1):
        hits = stored(find(asked).select("query_id", "doc_id").distinct())
        mine = hits.withColumn("round", F.lit(number))
        out = mine if out is None else out.unionByName(mine)
        enough = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        if number < rounds:
            asked = stored(rewrite(asked.join(enough, "query_id", "left_anti")).select("query_id", "query"))
    return out.groupBy("query_id", "doc_id").agg(F.min("round").alias("round"))
