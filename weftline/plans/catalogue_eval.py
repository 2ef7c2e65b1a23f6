"""Registered queries of text search over two channels, evaluation roll-ups, and more of operations and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.rules import REFUSAL
from weftline.operators import chunking, evaluation, hybrid, operations, state
from weftline.plans import catalogue_search
from weftline.tables import half_up, load


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


def _asked(spark, d):
    """Benchmark items ask; conversation turns are searched."""
    return hybrid.indexed(load(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", "text"), hybrid.indexed(_turns(spark, d), "id", "text")


def sparse_vectors(spark, d):
    """Hashed bigram and trigram counts of every turn."""
    return hybrid.sparse_terms(_turns(spark, d), "id", "text")


def dense_fallback(spark, d):
    """Hashed dense vectors of every turn, as scaled entries."""
    return hybrid.dense_slots(_turns(spark, d), "id", "text").select("id", "slot", F.round(F.col("weight") / F.col("norm"), 6).alias("value"))


def hybrid_weighted(spark, d):
    return hybrid.weighted(*_asked(spark, d), 10).withColumn("score", F.round("score", 6))


def hybrid_rrf(spark, d):
    return hybrid.reciprocal(*_asked(spark, d), 10)


def vectors_after_delete(spark, d):
    """Rows left after documents went, as themselves or as parents."""
    rows = load(spark, d, "embeddings").select("vec_id", "label")
    gone = rows.where("vec_id % 50 = 3").select(F.col("vec_id").alias("id"))
    return state.deleted(rows, gone, "vec_id", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _candidates(spark, d):
    """Hits with a judge's label; rows of some labels have none."""
    hits = catalogue_search._dense(spark, d).select("query_id", "id", "rank")
    label = evaluation.label_value(F.when(F.col("label") % 7 == 6, "unclear").when(F.col("hit") == 1, "yes").otherwise("no"))
    rows = catalogue_search._judged(spark, d, hits).join(catalogue_search._labels(spark, d), "id")
    return rows.withColumn("relevant", label)


def labelled_queries(spark, d):
    return evaluation.labelled_queries(_candidates(spark, d), F.col("relevant"))


def parent_rerank(spark, d):
    return evaluation.rerank_metrics(_candidates(spark, d), F.col("relevant")).na.fill(0, ["first_rank"])


def rerank_advice(spark, d):
    return evaluation.rerank_summary(evaluation.rerank_metrics(_candidates(spark, d), F.col("relevant")))


def baseline_gate(spark, d):
    metrics = catalogue_search._metrics(spark, d)
    return evaluation.baseline(metrics.withColumn("precision_at_10", F.col("precision")), "recall_at_5", "precision_at_10")


def run_summary(spark, d):
    """Totals of a run: queries, evaluated, skipped, bad cases and means."""
    metrics = catalogue_search._metrics(spark, d)
    asked = load(spark, d, "embeddings").where("vec_id % 20 = 0").agg(F.count(F.lit(1)).alias("total"))
    kind = evaluation.bad_case(metrics)
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    means = metrics.agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(~kind.isin("pass", "skipped")).alias("bad_cases"), mean("recall"), mean("precision"), mean("rr"), mean("ndcg_at_5"))
    both = asked.select("total", F.lit(1).alias("one")).join(means.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("skipped", F.col("total") - F.col("evaluated"))


def _answered(spark, d):
    """A user's turn, the answer, and what the user said next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, d, "conversations").select("*", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"), F.lead("text", 2).over(w).alias("then"))
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer", F.coalesce("then", F.lit("")).alias("truth"))


def benchmark_keywords(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.explode(evaluation.keywords(F.col("text"))).alias("keyword"))


def answer_ratios(spark, d):
    context = F.concat_ws("\n", "question", "answer")
    got = evaluation.answer_ratios(F.col("question"), F.col("answer"), F.col("truth"), context, F.array("question", "answer"))
    return _answered(spark, d).select("conv_id", "turn", got.alias("r")).select("conv_id", "turn", "r.*")


def _hard(spark, d):
    rows = _answered(spark, d)
    return rows.select("conv_id", "turn", evaluation.hard_case(text.query_terms(F.col("question")), F.col("answer")).alias("x")).select("conv_id", "turn", "x.*")


def hard_cases(spark, d):
    return _hard(spark, d)


def hard_case_summary(spark, d):
    mean = lambda c: F.round(F.avg(c), 6)
    return _hard(spark, d).groupBy("turn").agg(F.count(F.lit(1)).alias("n"), mean("coverage").alias("mean_coverage"), F.count_if(F.col("missing") > 0).alias("with_missing"), F.sum("refused").alias("refusals"), mean("chars").alias("mean_chars"))


def _labelled_documents(spark, d):
    return load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id")


def probe_match_rate(spark, d):
    """How often a rule (at least 300 characters) agrees with the quality label, by label."""
    rows = _labelled_documents(spark, d).where("quality is not null").withColumn("match", ((F.length("text") >= 300).cast("int") == F.col("quality")).cast("int"))
    return rows.groupBy(F.col("quality").alias("expected")).agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("match"), 4).alias("rate"))


def metric_summary(spark, d):
    """Scores under two names, cleaned, averaged where present, by group."""
    score = evaluation.score_of(F.when(F.col("event_id") % 3 == 0, F.col("value") / 300), F.when(F.col("event_id") % 3 == 1, F.when(F.col("event_id") % 2 == 0, float("inf")).otherwise(F.col("value") / 200)))
    rows = load(spark, d, "events").select("event_type", score.alias("score"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("present"), F.round(F.avg("score"), 6).alias("mean"))


def run_rollup(spark, d):
    """Means by run: scores of rows that have one above 0, latencies of all."""
    rows = load(spark, d, "events").select((F.col("user_id") % 7).alias("run"), F.when(F.col("event_type") != "error", F.col("value")).otherwise(0.0).alias("overall"), "value")
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("overall") > 0).alias("scored"), F.round(F.coalesce(F.avg(F.when(F.col("overall") > 0, F.col("overall"))), F.lit(0.0)), 4).alias("mean_overall"), F.round(F.avg("value"), 4).alias("mean_latency"))


def human_scores(spark, d):
    """Documents with and without a judge's label, by source."""
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("quality").alias("scored"), F.count_if(F.col("quality").isNull()).alias("remaining"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("mean_human"))


def low_scores(spark, d):
    """The ten lowest values under a half, by type."""
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("value", "event_id"))
    return load(spark, d, "events").where("value < 0.5").withColumn("place", place).where("place <= 10").select("event_type", "event_id", "value", "place")


def documents_by_category(spark, d):
    category = F.coalesce(F.when(F.trim("lang") != "", F.col("lang")), F.lit("general"))
    return load(spark, d, "documents").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n_chars").alias("chars"))


def floor_percentiles(spark, d):
    return evaluation.floor_percentile(load(spark, d, "events"), "event_type", "value", 0.95)


def latency_alert_5m(spark, d):
    rows = load(spark, d, "events").select("event_id", "ts", (F.col("value") * 30).alias("ms"))
    return operations.sliding_latency(rows, "event_id", "ts", "ms").select("event_id", F.round("p95", 6).alias("p95"), "alert")


def latency_bands(spark, d):
    rows = load(spark, d, "events").select((F.col("value") * 30).alias("ms"))
    return rows.select(operations.latency_band(F.col("ms")).alias("band"), operations.coverage_band(F.col("ms") / 3000).alias("coverage"), F.when(F.col("ms") < 1000, "ms").otherwise("s").alias("unit")).groupBy("band", "coverage", "unit").agg(F.count(F.lit(1)).alias("n"))


def setting_overrides(spark, d):
    given = F.get_json_object("props", "$.k")
    rows = load(spark, d, "events").select(operations.override(given, 1, 50, F.lit(10.0)).alias("k"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def dashboard(spark, d):
    """Quality, operations and satisfaction as rows (part, measure, value)."""
    rated = F.when(F.col("event_type").isin("purchase", "signup"), 1.0).when(F.col("event_type") == "error", 0.0)
    tall = lambda df, part: df.select(F.lit(part).alias("part"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("double") for c in df.columns]))).alias("measure", "value"))
    quality = load(spark, d, "labels").agg(F.count(F.lit(1)).alias("labelled"), F.round(F.avg("quality"), 6).alias("good"))
    events = load(spark, d, "events")
    ops = events.agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("value"), 4).alias("mean_latency"), operations.share(F.count_if(F.col("event_type") == "error"), F.count(F.lit(1))).alias("error_rate"))
    pleased = events.agg(F.count(rated).alias("ratings"), F.round(F.avg(rated), 6).alias("satisfaction"))
    return tall(quality, "quality").union(tall(ops, "operations")).union(tall(pleased, "satisfaction"))


def recent_traces(spark, d):
    """Of the newest 50 events of each user the last 20, oldest first."""
    kept = operations.last_n(load(spark, d, "events"), ["user_id"], 50, F.desc("ts"), F.desc("event_id"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = kept.withColumn("back", place).where("back <= 20")
    return rows.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("place"))


def document_page(spark, d):
    """The second page of twenty of each source, newest first, with a status."""
    status = F.when(F.col("quality").isNull(), "local_only").when(F.length("text") == 0, "failed").when(F.col("quality") == 1, "ready").otherwise("indexing")
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", status.alias("status"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    return rows.withColumn("place", place).where("place > 20 AND place <= 40")


def short_term_memory(spark, d):
    return state.short_term(load(spark, d, "conversations"), "conv_id", "turn", 5, 3, 2).select("conv_id", "turn", "part")


def memory_stats(spark, d):
    rows = load(spark, d, "conversations")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.length(F.trim("text")) > 0).alias("embedded"), F.countDistinct("conv_id").alias("sessions"))


def context_split(spark, d):
    """Conversations as contexts, whose turns are divided by rules of several lengths, some too short to count, and their parts again; some parts are blank."""
    rule = lambda x: F.concat(F.lit("\n\n"), F.repeat(F.lit("="), (8 + x["turn"] % 6).cast("int")), F.lit("\n\n"))
    turn = lambda x: F.concat(F.when(x["turn"] % 5 == 2, F.lit(" \n ")).otherwise(x["text"]), rule(x))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), turn), "")
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(joined.alias("context"))
    return rows.select("conv_id", F.posexplode(chunking.context_parts(F.col("context"))).alias("pos", "part")).select("conv_id", "pos", F.length("part").alias("chars"), F.md5("part").alias("digest"))


def content_windows(spark, d):
    return chunking.content_windows(load(spark, d, "documents"), "doc_id", "text", 600, 3000)


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({g}, ''), lambda c: unicode(c)::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296)"
_ABS = "abs(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END)"


def _grams_sql(table: str, key: str, name: str) -> str:
    """Sparse terms and dense slots of a table's texts, as CTEs."""
    grams = lambda n: f"SELECT k, substring(t, unnest(range(1, length(t) - {n - 2}))::INT, {n}) AS g, {n} AS size FROM {name}_t"
    return f"""{name}_t AS (SELECT {key} AS k, lower(trim(text)) AS t FROM {table}),
 {name}_g AS (SELECT k, g, size, count(*) AS n FROM ({grams(1)} UNION ALL {grams(2)} UNION ALL {grams(3)}) GROUP BY 1, 2, 3),
 {name}_h AS (SELECT g, size, {_HASH.format(g='g')} AS u, {_HASH.format(g="CASE WHEN size = 2 THEN 'b:' ELSE 't:' END || g")} AS v FROM (SELECT DISTINCT g, size FROM {name}_g)),
 {name}_d AS (SELECT k, {_ABS.format(h='u')} % 512 AS slot, sum(n * CASE size WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1 ELSE 1.5::DOUBLE END) AS w FROM {name}_g JOIN {name}_h USING (g, size) GROUP BY 1, 2),
 {name}_s AS (SELECT k, {_ABS.format(h='v')} % 16777214 AS term, sum(n)::BIGINT AS tf FROM {name}_g JOIN {name}_h USING (g, size) WHERE size > 1 GROUP BY 1, 2)"""


_TURN = "conv_id * 1000 + turn"
_PAIRS = f"""{_grams_sql('benchmark', 'item_id', 'q')}, {_grams_sql('conversations', _TURN, 'c')},
 qd AS (SELECT k, sqrt(sum(w * w)) AS norm FROM q_d GROUP BY 1), cd AS (SELECT k, sqrt(sum(w * w)) AS norm FROM c_d GROUP BY 1),
 qs AS (SELECT k, sqrt(sum(tf * tf)) AS norm FROM q_s GROUP BY 1), cs AS (SELECT k, sqrt(sum(tf * tf)) AS norm FROM c_s GROUP BY 1),
 pd AS (SELECT a.k AS query_id, b.k AS id, round(sum((a.w / x.norm) * (b.w / y.norm)), 9) AS dense FROM q_d a JOIN c_d b USING (slot) JOIN qd x ON x.k = a.k JOIN cd y ON y.k = b.k GROUP BY 1, 2),
 ps AS (SELECT a.k AS query_id, b.k AS id, round(sum((a.tf / x.norm) * (b.tf / y.norm)), 9) AS sparse FROM q_s a JOIN c_s b USING (term) JOIN qs x ON x.k = a.k JOIN cs y ON y.k = b.k GROUP BY 1, 2),
 p AS (SELECT query_id, id, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse FROM pd FULL JOIN ps USING (query_id, id))"""
_CHANNELS = "concat_ws(',', CASE WHEN dense > 0 THEN 'dense' END, CASE WHEN sparse > 0 THEN 'sparse' END) AS channels"
_JUDGED = f"""WITH {catalogue_search._SCORED}, cand AS (SELECT query_id, id, rank, CASE WHEN label % 7 = 6 THEN NULL ELSE label = qlabel END AS relevant FROM dense),
 rr AS (SELECT query_id, count(*) AS candidates, count(*) FILTER (relevant) AS relevant, count(*) FILTER (relevant AND rank <= 10) AS in_top, coalesce((min(rank) FILTER (relevant) <= 10)::INT, 0) AS hit, min(rank) FILTER (relevant) AS first_rank, coalesce(round(1.0::DOUBLE / min(rank) FILTER (relevant), 6), 0) AS rr FROM cand GROUP BY 1)"""
_METRICS = f"WITH {catalogue_search._SCORED}, {catalogue_search._METRICS}"
_ANSWERED = "a AS (SELECT conv_id, turn, text AS question, answer, coalesce(n2, '') AS truth FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer, lead(text, 2) OVER w AS n2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"


def _keywords_sql(t: str) -> str:
    cjk = f"regexp_replace({t}, '[^一-鿿]', '', 'g')"
    grams = lambda n: f"list_transform(range(1, length({cjk}) - {n - 2}), lambda i: substring({cjk}, i::INT, {n}))"
    return f"list_distinct(list_concat(list_transform(regexp_extract_all({t}, '[a-zA-Z]{{2,}}'), lambda w: lower(w)), {grams(1)}, {grams(2)}, list_slice({grams(3)}, 1, 10), regexp_extract_all({t}, '\\d+')))"


def _share_sql(words: str, text_: str) -> str:
    return f"CASE WHEN len({words}) > 0 THEN len(list_filter({words}, lambda w: contains(lower({text_}), w))) / len({words})::DOUBLE ELSE 0 END"


_TERMS = "list_distinct(list_concat(regexp_extract_all(lower(question), '[a-z0-9]{2,}'), regexp_extract_all(lower(question), '\\d+')))"
_HARD = f"""{_ANSWERED}, t AS (SELECT conv_id, turn, answer, {_TERMS} AS terms FROM a), f AS (SELECT *, len(list_filter(terms, lambda t: contains(lower(answer), t))) AS found FROM t),
 h AS (SELECT conv_id, turn, CASE WHEN len(terms) > 0 THEN floor(found / len(terms)::DOUBLE * 100 + 0.5) / 100 ELSE 1 END AS coverage, len(terms) - found AS missing, regexp_matches(answer, '{REFUSAL}')::INT AS refused, length(answer) AS chars FROM f)"""
_RATIO = lambda name: f"CASE WHEN truth <> '' AND answer <> '' THEN floor(({name}) * 100 + 0.5) / 100 ELSE 0 END AS {name}"

SQL = {
    "sparse_vectors": f"WITH {_grams_sql('conversations', _TURN, 'c')} SELECT k AS id, term, tf FROM c_s",
    "dense_fallback": f"WITH {_grams_sql('conversations', _TURN, 'c')} SELECT k AS id, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY k)), 6) AS value FROM c_d",
    "hybrid_weighted": f"WITH {_PAIRS} SELECT query_id, id, round(score, 6) AS score, channels, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(0.6::DOUBLE * dense + 0.4::DOUBLE * sparse, 9) AS score, {_CHANNELS} FROM p)) WHERE rank <= 10",
    "hybrid_rrf": f"WITH {_PAIRS}, r AS (SELECT *, CASE WHEN dense > 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, id) END AS rd, CASE WHEN sparse > 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, id) END AS rs FROM p) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(coalesce(1.0::DOUBLE / (60 + rd), 0) + coalesce(1.0::DOUBLE / (60 + rs), 0), 9) AS score, {_CHANNELS} FROM r)) WHERE rank <= 10",
    "vectors_after_delete": "WITH g AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 50 = 3) SELECT label, count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT id FROM g) AND label NOT IN (SELECT id FROM g) GROUP BY 1",
    "labelled_queries": f"{_JUDGED} SELECT query_id, bool_and(relevant IS NOT NULL)::INT AS labelled, bool_or(relevant IS NOT NULL)::INT AS partly FROM cand GROUP BY 1",
    "parent_rerank": f"{_JUDGED} SELECT * REPLACE (coalesce(first_rank, 0) AS first_rank) FROM rr",
    "rerank_advice": f"{_JUDGED}, s AS (SELECT count(*) AS evaluated, round(avg(hit), 6) AS recall, round(avg(rr), 6) AS mrr, coalesce(round(avg(first_rank), 6), 0) AS mean_first_rank, count_if(first_rank > 3)::BIGINT AS ranking_errors FROM rr) SELECT *, CASE WHEN evaluated = 0 THEN 'label first' WHEN recall >= 0.95 AND mrr >= 0.5 AND mean_first_rank > 0 AND mean_first_rank <= 2 THEN 'skip reranking' WHEN mrr <= 0.25 OR mean_first_rank >= 5 THEN 'go on with reranking' ELSE 'small comparison first' END AS advice FROM s",
    "baseline_gate": f'{_METRICS} SELECT count(*) AS queries, round(avg(recall_at_5), 6) AS recall, round(avg("precision"), 6) AS "precision", (avg(recall_at_5) >= 0.8)::INT AS passed FROM m',
    "run_summary": f"""{_METRICS} SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS total, count(*) AS evaluated, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) - count(*) AS skipped, count_if(retrieved = 0 OR hit = 0 OR first_rank > 3 OR "precision" < 0.34)::BIGINT AS bad_cases, round(avg(recall), 6) AS recall, round(avg("precision"), 6) AS "precision", round(avg(rr), 6) AS rr, round(avg(ndcg_at_5), 6) AS ndcg_at_5 FROM m""",
    "benchmark_keywords": f"SELECT item_id, unnest({_keywords_sql('text')}) AS keyword FROM benchmark",
    "answer_ratios": f"""WITH {_ANSWERED}, k AS (SELECT *, {_keywords_sql('truth')} AS wanted, {_keywords_sql('question')} AS asked FROM a),
 r AS (SELECT conv_id, turn, truth, answer, {_share_sql('wanted', 'answer')} AS faithfulness, {_share_sql('asked', 'answer')} AS answer_relevancy, {_share_sql('wanted', "concat_ws(chr(10), question, answer)")} AS context_recall, len(list_filter([question, answer], lambda s: len(list_filter(wanted, lambda w: contains(lower(s), w))) > 0)) / 2.0::DOUBLE AS context_precision FROM k),
 o AS (SELECT *, (context_recall + answer_relevancy + faithfulness + context_precision) / 4 AS overall FROM r)
 SELECT conv_id, turn, {', '.join(_RATIO(c) for c in ('faithfulness', 'answer_relevancy', 'context_precision', 'context_recall', 'overall'))} FROM o""",
    "hard_cases": f"WITH {_HARD} SELECT * FROM h",
    "hard_case_summary": f"WITH {_HARD} SELECT turn, count(*) AS n, round(avg(coverage), 6) AS mean_coverage, count_if(missing > 0)::BIGINT AS with_missing, sum(refused)::BIGINT AS refusals, round(avg(chars), 6) AS mean_chars FROM h GROUP BY 1",
    "probe_match_rate": "SELECT quality AS expected, count(*) AS n, floor(avg(((length(text) >= 300)::INT = quality)::INT) * 10000 + 0.5) / 10000 AS rate FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1",
    "metric_summary": "WITH s AS (SELECT event_type, coalesce(CASE WHEN event_id % 3 = 0 THEN value / 300 END, CASE WHEN event_id % 3 = 1 AND event_id % 2 <> 0 THEN value / 200 END) AS s FROM events) SELECT event_type, count(*) AS n, count(s) AS present, round(avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, s))) FILTER (s IS NOT NULL), 6) AS mean FROM s GROUP BY 1",
    "run_rollup": "WITH r AS (SELECT user_id % 7 AS run, CASE WHEN event_type <> 'error' THEN value ELSE 0 END AS overall, value FROM events) SELECT run, count(*) AS n, count_if(overall > 0)::BIGINT AS scored, round(coalesce(avg(overall) FILTER (overall > 0), 0), 4) AS mean_overall, round(avg(value), 4) AS mean_latency FROM r GROUP BY 1",
    "human_scores": "SELECT source, count(*) AS documents, count(quality) AS scored, count_if(quality IS NULL)::BIGINT AS remaining, round(coalesce(avg(quality), 0), 6) AS mean_human FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "low_scores": "SELECT * FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS place FROM events WHERE value < 0.5) WHERE place <= 10",
    "documents_by_category": "SELECT coalesce(CASE WHEN trim(lang) <> '' THEN lang END, 'general') AS category, count(*) AS documents, min(doc_id) AS first, max(doc_id) AS last, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1",
    "floor_percentiles": "SELECT event_type, list_sort(list(value))[floor(count(*) * 0.95::DOUBLE)::INT + 1] AS value FROM events GROUP BY 1",
    "latency_alert_5m": "WITH e AS (SELECT event_id, epoch_us(ts) AS us, value * 30 AS ms FROM events), w AS (SELECT event_id, list_sort(list(ms) OVER (ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)) AS l FROM e), p AS (SELECT event_id, l[greatest(1, ceil(len(l) * 0.95::DOUBLE))::INT] AS p95 FROM w) SELECT event_id, round(p95, 6) AS p95, (p95 >= 3000)::INT AS alert FROM p",
    "latency_bands": "SELECT CASE WHEN ms < 500 THEN 'good' WHEN ms < 2000 THEN 'fair' ELSE 'poor' END AS band, CASE WHEN ms / 3000 >= 0.8 THEN 'good' WHEN ms / 3000 >= 0.5 THEN 'fair' ELSE 'poor' END AS coverage, CASE WHEN ms < 1000 THEN 'ms' ELSE 's' END AS unit, count(*) AS n FROM (SELECT value * 30 AS ms FROM events) GROUP BY 1, 2, 3",
    "setting_overrides": "SELECT CASE WHEN try_cast(props->>'$.k' AS DOUBLE) BETWEEN 1 AND 50 THEN try_cast(props->>'$.k' AS DOUBLE) ELSE 10 END AS k, count(*) AS n FROM events GROUP BY 1",
    "dashboard": "SELECT 'quality' AS part, unnest(['labelled', 'good']) AS measure, unnest([count(*)::DOUBLE, round(avg(quality), 6)]) AS value FROM labels UNION ALL SELECT 'operations', unnest(['requests', 'mean_latency', 'error_rate']), unnest([count(*)::DOUBLE, round(avg(value), 4), round(count_if(event_type = 'error') / count(*)::DOUBLE, 4)]) FROM events UNION ALL SELECT 'satisfaction', unnest(['ratings', 'satisfaction']), unnest([count(r)::DOUBLE, round(avg(r), 6)]) FROM (SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0::DOUBLE WHEN event_type = 'error' THEN 0.0::DOUBLE END AS r FROM events)",
    "recent_traces": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 20",
    "document_page": "SELECT * FROM (SELECT doc_id, source, CASE WHEN quality IS NULL THEN 'local_only' WHEN length(text) = 0 THEN 'failed' WHEN quality = 1 THEN 'ready' ELSE 'indexing' END AS status, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place FROM documents LEFT JOIN labels USING (doc_id)) WHERE place > 20 AND place <= 40",
    "short_term_memory": "SELECT conv_id, turn, CASE WHEN n > 3 AND back > n - 2 THEN 'compressed' ELSE 'kept' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5)",
    "memory_stats": "SELECT role, count(*) AS entries, count_if(length(trim(text)) > 0)::BIGINT AS embedded, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY 1",
    "context_split": r"""WITH c AS (SELECT conv_id, string_agg(CASE WHEN turn % 5 = 2 THEN ' ' || chr(10) || ' ' ELSE text END || chr(10) || chr(10) || repeat('=', (8 + turn % 6)::INT) || chr(10) || chr(10), '' ORDER BY turn) AS context FROM conversations GROUP BY 1),
 p AS (SELECT conv_id, list_filter(regexp_split_to_array(context, '\n\n={10,}\n\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS parts FROM c)
 SELECT conv_id, unnest(range(0, len(parts)))::INT AS pos, length(unnest(parts)) AS chars, md5(unnest(parts)) AS digest FROM p""",
    "content_windows": "SELECT doc_id, w AS window, least(600, n - 600 * w) AS chars FROM (SELECT doc_id, length(text) AS n, unnest(range(0, least(5, ceil(length(text) / 600.0))::INT)) AS w FROM documents)",
}

QUERIES = {name: globals()[name] for name in SQL}
