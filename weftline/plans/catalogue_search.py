"""Registered queries over ``embeddings``: search, fusion, ranking, evaluation. Rows with an id divisible by 20 ask; all rows are searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import evaluation, ranking, search
from weftline.plans import retrieval
from weftline.tables import load

EVERY = 20


def _tables(spark: SparkSession, d: str, scoped: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("scope"))
    if not scoped:
        rows = rows.drop("scope")
    return rows.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id"), rows


def _dense(spark, d, k=20):
    return search.exact_cosine(*_tables(spark, d), k)


def _sparse(spark, d, k=20):
    return search.exact_cosine(*[search.sparsified(t) for t in _tables(spark, d)], k)


def _labels(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


def _wanted(spark, d):
    """(query_id, relevant): the other rows of the query's label, by a count of each label, so no pairs are listed."""
    rows = _labels(spark, d)
    n = rows.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("relevant"))
    return rows.where(F.col("id") % EVERY == 0).join(n, "label").where("relevant > 0").select(F.col("id").alias("query_id"), "relevant")


def _judged(spark, d, hits, name="id"):
    """``hits`` with ``hit``: whether the row's label is the query's."""
    rows = _labels(spark, d)
    own = rows.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("label").alias("__asked"))
    found = rows.select(F.col("id").alias(name), F.col("label").alias("__found"))
    return hits.join(own, "query_id").join(found, name).withColumn("hit", (F.col("__asked") == F.col("__found")).cast("int")).drop("__asked", "__found")


_SCORED = """thin AS (SELECT *, list_transform(embedding, lambda x: CASE WHEN abs(x::DOUBLE) >= 0.1 THEN x::DOUBLE ELSE 0.0::DOUBLE END) AS thin FROM embeddings),
sims AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label AS label, q.label AS qlabel,
  round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS s,
  round(list_cosine_similarity(q.thin, c.thin), 12) AS t
  FROM thin q, thin c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
dense AS (SELECT * FROM (SELECT query_id, id, label, qlabel, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM sims) WHERE rank <= 20),
sparse AS (SELECT * FROM (SELECT query_id, id, round(t, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, id) AS rank FROM sims) WHERE rank <= 20),
rel AS (SELECT q.vec_id AS query_id, c.vec_id AS id FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)"""

_WEIGHTED = """fusedw AS (SELECT query_id, id, score, channels, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(0.6 * coalesce(a.score, 0) + 0.4 * coalesce(b.score, 0), 6) AS score,
  concat_ws(',', CASE WHEN coalesce(a.score, 0) > 0 THEN 'dense' END, CASE WHEN coalesce(b.score, 0) > 0 THEN 'sparse' END) AS channels
  FROM dense a FULL JOIN sparse b USING (query_id, id)))"""

_RRF = """fusedr AS (SELECT query_id, id, score, channels, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score,
  concat_ws(',', CASE WHEN a.rank IS NOT NULL THEN 'dense' END, CASE WHEN b.rank IS NOT NULL THEN 'sparse' END) AS channels
  FROM (SELECT * FROM dense WHERE score > 0) a FULL JOIN (SELECT * FROM sparse WHERE score > 0) b USING (query_id, id)))"""


def knn_cosine_topk(spark, d):
    return _dense(spark, d)


def knn_filtered_by_label(spark, d):
    return search.exact_cosine(*_tables(spark, d, scoped=True), 10)


def weighted_fusion(spark, d):
    return search.fuse_weighted(_dense(spark, d), _sparse(spark, d), 20)


def rrf_fusion(spark, d):
    return search.fuse_reciprocal(_dense(spark, d), _sparse(spark, d), 20)


def dual_retrieve(spark, d):
    return search.best_of(_dense(spark, d), _sparse(spark, d), k=20)


def filter_fallback(spark, d):
    """Hits of the query's own label where any reaches 0.3, else unfiltered ones."""
    near = search.exact_cosine(*_tables(spark, d, scoped=True), 5).where("score >= 0.3")
    return search.with_fallback(near, _dense(spark, d, 5))


def fusion_weight_grid(spark, d):
    a, b = _dense(spark, d), _sparse(spark, d)
    both = a.select("query_id", "id", F.col("score").alias("sa")).join(b.select("query_id", "id", F.col("score").alias("sb")), ["query_id", "id"], "full").na.fill(0.0)
    grid = F.explode(F.array(*[F.lit(x / 10) for x in (0, 2, 4, 5, 6, 8, 10)])).alias("w")
    rows = both.select("query_id", "id", "sa", "sb", grid).withColumn("score", F.round(F.col("w") * F.col("sa") + (1 - F.col("w")) * F.col("sb"), 6))
    keyed = rows.withColumn("query_id", F.struct("w", "query_id"))
    top = search.ranked(keyed.select("query_id", "id", "score"), 5).select(F.col("query_id.w").alias("w"), F.col("query_id.query_id").alias("query_id"), F.col("id").alias("doc_id"), "rank")
    judged = _judged(spark, d, top, "doc_id")
    one = judged.groupBy("w", "query_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"), F.coalesce(F.max(F.when(F.col("hit") == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return one.groupBy("w").agg(F.count(F.lit(1)).alias("queries"), F.sum("hit").alias("hits"), F.round(F.avg("rr"), 6).alias("mrr"))


def fusion_win_tie_loss(spark, d):
    """Reciprocal-rank fusion with several constants against weighted fusion, by the first relevant rank."""
    a, b = _dense(spark, d), _sparse(spark, d)
    first = lambda hits: _judged(spark, d, hits).where("hit = 1").groupBy("query_id").agg(F.min("rank").alias("first"))
    asked = _wanted(spark, d).select("query_id")
    base = asked.join(first(search.fuse_weighted(a, b, 20)), "query_id", "left").select("query_id", F.coalesce("first", F.lit(99)).alias("base"))
    out = None
    for k in (10, 20, 40, 60):
        one = base.join(first(search.fuse_reciprocal(a, b, 20, k)), "query_id", "left").select(F.lit(k).alias("k"), "base", F.coalesce("first", F.lit(99)).alias("first"))
        out = one if out is None else out.union(one)
    return out.groupBy("k").agg(F.count_if(F.col("first") < F.col("base")).alias("wins"), F.count_if(F.col("first") == F.col("base")).alias("ties"), F.count_if(F.col("first") > F.col("base")).alias("losses"))


def doc_max_score(spark, d):
    rows = _dense(spark, d).join(load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    return rows.groupBy("query_id", "label").agg(F.max("score").alias("score"))


def rank_debug(spark, d):
    """First rank of a relevant row and number of them in the pool, by query."""
    return _wanted(spark, d).select("query_id").join(_judged(spark, d, _dense(spark, d)).where("hit = 1").groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("in_pool")), "query_id", "left").na.fill(0)


def _metrics(spark, d):
    hits = _dense(spark, d, 10).select("query_id", F.col("id").alias("doc_id"), "rank")
    return evaluation.judged_metrics(_judged(spark, d, hits, "doc_id"), _wanted(spark, d))


def retrieval_metrics(spark, d):
    return _metrics(spark, d).na.fill(0, ["first_rank"])


def metrics_by_group(spark, d):
    labels = load(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("category"))
    return evaluation.grouped_means(_metrics(spark, d).join(labels, "query_id").withColumn("difficulty", F.when(F.col("relevant") > 50, "easy").otherwise("hard")), ["category", "difficulty"], ["recall", "rr", "ndcg_at_5"])


def bad_case_hist(spark, d):
    m = _metrics(spark, d)
    return m.select(evaluation.bad_case(m).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def adaptive_truncate(spark, d):
    return ranking.adaptive_cut(_dense(spark, d).select("query_id", "id", "score"), cap=6, drop=0.02)


def parent_pipeline(spark, d):
    """Fused hits grouped by label as parent, best first, cut adaptively."""
    queries, corpus = _tables(spark, d)
    labels = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("parent_id"))
    return retrieval.retrieve(queries, corpus.join(labels, "id"), child_k=20, parent_k=10)


_CUT = """SELECT query_id, id, score, place + 1 AS kept_rank FROM (SELECT *, CASE WHEN n <= 1 THEN n WHEN keep0 = 1 AND second > least THEN 2 ELSE keep0 END AS keep FROM (
  SELECT *, greatest(1, least(CASE WHEN under IS NOT NULL AND under <= cliff THEN under ELSE cliff + 1 END, 6, n)) AS keep0 FROM (
  SELECT *, coalesce(min(CASE WHEN gap > {drop} THEN place END) OVER w, n) AS cliff, min(CASE WHEN score < least THEN place END) OVER w AS under, max(CASE WHEN place = 1 THEN score END) OVER w AS second FROM (
  SELECT *, CASE WHEN top > 0.8 THEN greatest(0.2::DOUBLE, 0.3::DOUBLE - 0.05::DOUBLE) WHEN top < 0.3 THEN least(0.5::DOUBLE, 0.3::DOUBLE + 0.10::DOUBLE) ELSE 0.3::DOUBLE END AS least FROM (
  SELECT query_id, id, score, row_number() OVER o - 1 AS place, lag(score) OVER o - score AS gap, max(score) OVER w AS top, count(*) OVER w AS n FROM {source}
  WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, id), w AS (PARTITION BY query_id)))
  WINDOW w AS (PARTITION BY query_id)))) WHERE place < keep"""

_METRICS = """hits AS (SELECT query_id, id, rank FROM dense WHERE rank <= 10),
m AS (SELECT r.query_id, r.relevant, coalesce(f.retrieved, 0) AS retrieved, f.first_rank, round(coalesce(f.hits, 0) / r.relevant, 6) AS recall,
  round(CASE WHEN f.retrieved > 0 THEN f.hits / f.retrieved ELSE 0 END, 6) AS "precision", round(coalesce(1.0::DOUBLE / f.first_rank, 0), 6) AS rr, CASE WHEN f.hits > 0 THEN 1 ELSE 0 END::INT AS hit,
  round(coalesce(h1, 0) / r.relevant, 6) AS recall_at_1, round(coalesce(h3, 0) / r.relevant, 6) AS recall_at_3, round(coalesce(h5, 0) / r.relevant, 6) AS recall_at_5,
  round(least(1.0::DOUBLE, coalesce(g1, 0)), 6) AS ndcg_at_1,
  round(least(1.0::DOUBLE, coalesce(g3, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 4) t(i) WHERE i <= r.relevant)), 6) AS ndcg_at_3,
  round(least(1.0::DOUBLE, coalesce(g5, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) t(i) WHERE i <= r.relevant)), 6) AS ndcg_at_5
  FROM (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1) r LEFT JOIN (
  SELECT h.query_id, count(*) AS retrieved, sum(CASE WHEN e.id IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE AS hits, min(CASE WHEN e.id IS NOT NULL THEN rank END) AS first_rank,
  sum(CASE WHEN e.id IS NOT NULL AND rank <= 1 THEN 1 ELSE 0 END)::DOUBLE AS h1, sum(CASE WHEN e.id IS NOT NULL AND rank <= 3 THEN 1 ELSE 0 END)::DOUBLE AS h3, sum(CASE WHEN e.id IS NOT NULL AND rank <= 5 THEN 1 ELSE 0 END)::DOUBLE AS h5,
  sum(CASE WHEN e.id IS NOT NULL AND rank <= 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS g1, sum(CASE WHEN e.id IS NOT NULL AND rank <= 3 THEN 1 / log2(rank + 1) ELSE 0 END) AS g3, sum(CASE WHEN e.id IS NOT NULL AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS g5
  FROM hits h LEFT JOIN rel e USING (query_id, id) GROUP BY 1) f USING (query_id))"""

_W = f"WITH {_SCORED}"

SQL = {
    "knn_cosine_topk": f"{_W} SELECT query_id, id, score, rank FROM dense",
    "knn_filtered_by_label": f"{_W} SELECT * FROM (SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM sims WHERE label = qlabel) WHERE rank <= 10",
    "weighted_fusion": f"{_W}, {_WEIGHTED} SELECT * FROM fusedw WHERE rank <= 20",
    "rrf_fusion": f"{_W}, {_RRF} SELECT * FROM fusedr WHERE rank <= 20",
    "dual_retrieve": f"{_W} SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM dense UNION ALL SELECT query_id, id, score FROM sparse) GROUP BY 1, 2)) WHERE rank <= 20",
    "filter_fallback": f"{_W}, near AS (SELECT * FROM (SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM sims WHERE label = qlabel) WHERE rank <= 5 AND score >= 0.3) SELECT query_id, id, score, rank FROM near UNION ALL SELECT query_id, id, score, rank FROM dense WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM near)",
    "fusion_weight_grid": f"{_W}, both_ AS (SELECT query_id, id, coalesce(a.score, 0) AS sa, coalesce(b.score, 0) AS sb FROM dense a FULL JOIN sparse b USING (query_id, id)), top AS (SELECT *, row_number() OVER (PARTITION BY w, query_id ORDER BY score DESC, id) AS rank FROM (SELECT w, query_id, id, round(w * sa + (1 - w) * sb, 6) AS score FROM both_, (SELECT unnest([0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0])::DOUBLE AS w))), one AS (SELECT w, query_id, max(CASE WHEN r.id IS NULL THEN 0 ELSE 1 END) AS hit, coalesce(max(CASE WHEN r.id IS NOT NULL THEN 1.0::DOUBLE / rank END), 0) AS rr FROM (SELECT * FROM top WHERE rank <= 5) LEFT JOIN rel r USING (query_id, id) GROUP BY 1, 2) SELECT w, count(*) AS queries, sum(hit)::BIGINT AS hits, round(avg(rr), 6) AS mrr FROM one GROUP BY 1",
    "fusion_win_tie_loss": f"{_W}, {_WEIGHTED}, base AS (SELECT q.query_id, coalesce(min(f.rank), 99) AS base FROM (SELECT DISTINCT query_id FROM rel) q LEFT JOIN (SELECT fusedw.* FROM fusedw JOIN rel USING (query_id, id) WHERE rank <= 20) f USING (query_id) GROUP BY 1), r AS (SELECT k, query_id, id, row_number() OVER (PARTITION BY k, query_id ORDER BY score DESC, id) AS rank FROM (SELECT k, query_id, id, round(coalesce(1.0::DOUBLE / (k + a.rank), 0) + coalesce(1.0::DOUBLE / (k + b.rank), 0), 9) AS score FROM (SELECT * FROM dense WHERE score > 0) a FULL JOIN (SELECT * FROM sparse WHERE score > 0) b USING (query_id, id), (SELECT unnest([10, 20, 40, 60]) AS k))), f AS (SELECT k, query_id, min(rank) AS first FROM r JOIN rel USING (query_id, id) WHERE rank <= 20 GROUP BY 1, 2), c AS (SELECT g.k, base, coalesce(f.first, 99) AS first FROM base, (SELECT unnest([10, 20, 40, 60]) AS k) g LEFT JOIN f ON f.k = g.k AND f.query_id = base.query_id) SELECT k, count_if(first < base)::BIGINT AS wins, count_if(first = base)::BIGINT AS ties, count_if(first > base)::BIGINT AS losses FROM c GROUP BY 1",
    "doc_max_score": f"{_W} SELECT query_id, label, max(score) AS score FROM dense GROUP BY 1, 2",
    "rank_debug": f"{_W} SELECT q.query_id, coalesce(min(f.rank), 0) AS first_rank, count(f.rank) AS in_pool FROM (SELECT DISTINCT query_id FROM rel) q LEFT JOIN (SELECT dense.* FROM dense JOIN rel USING (query_id, id)) f USING (query_id) GROUP BY 1",
    "retrieval_metrics": f"{_W}, {_METRICS} SELECT * REPLACE (coalesce(first_rank, 0) AS first_rank) FROM m",
    "metrics_by_group": f"""{_W}, {_METRICS}, g AS (SELECT m.*, e.label::VARCHAR AS category, CASE WHEN relevant > 50 THEN 'easy' ELSE 'hard' END AS difficulty FROM m JOIN embeddings e ON e.vec_id = m.query_id),
 x AS (SELECT 'all' AS "grouping", 'all' AS "value", * FROM g UNION ALL SELECT 'category', category, * FROM g UNION ALL SELECT 'difficulty', difficulty, * FROM g)
 SELECT "grouping", "value", count(*) AS n, round(avg(recall), 6) AS mean_recall, round(avg(rr), 6) AS mean_rr, round(avg(ndcg_at_5), 6) AS mean_ndcg_at_5 FROM x GROUP BY 1, 2""",
    "bad_case_hist": f"{_W}, {_METRICS} SELECT CASE WHEN relevant = 0 THEN 'skipped' WHEN retrieved = 0 THEN 'no_retrieval' WHEN hit = 0 THEN 'recall_miss' WHEN first_rank > 3 THEN 'ranking_error' WHEN \"precision\" < 0.34 THEN 'noisy_context' ELSE 'pass' END AS type, count(*) AS n FROM m GROUP BY 1",
    "adaptive_truncate": f"{_W} {_CUT.format(drop=0.02, source='dense')}",
    "parent_pipeline": f"{_W}, {_RRF}, p AS (SELECT f.query_id, e.label AS id, max(a.score) AS score, min(f.rank) AS first_rank FROM (SELECT * FROM fusedr WHERE rank <= 20) f JOIN dense a USING (query_id, id) JOIN embeddings e ON e.vec_id = f.id GROUP BY 1, 2), pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS r FROM p) WHERE r <= 10) {_CUT.format(drop=0.05, source='pr')}",
}

QUERIES = {name: globals()[name] for name in SQL}
