"""Registered queries of scores, reranking, sources, traces, samples and upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import evaluation, operations, ranking, search
from weftline.plans import catalogue_eval, catalogue_search
from weftline.sources import datasets, documents
from weftline.tables import load


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores read from replies: fenced, bare, as text, and none; cut short, below 0, in another field, in a list, of another kind, empty and missing."""
    v, kind = F.col("value").cast("string"), F.col("event_id") % 11
    broken = [F.concat(F.lit('{"score": '), v), F.concat(F.lit('{"score": -'), v, F.lit("}")), F.concat(F.lit('{"result": {"score": '), v, F.lit("}}")), F.concat(F.lit('[{"score": '), v, F.lit("}]")), F.lit('{"score": null}'), F.lit(""), F.lit(None).cast("string")]
    other = F.lit(None).cast("string")
    for i, shape in enumerate(broken):
        other = F.when(kind == 4 + i, shape).otherwise(other)
    reply = F.when(kind >= 4, other).when(kind == 0, F.concat(F.lit('```json\n{"score": '), v, F.lit("}\n```"))).when(kind == 1, F.concat(F.lit('Score: {"score": '), v, F.lit(', "why": "x"}.'))).when(kind == 2, F.concat(F.lit('{"score": "'), v, F.lit('"}'))).otherwise(v)
    return load(spark, d, "events").select("event_id", F.round(evaluation.judge_score(reply), 6).alias("score"))


def _asked_turns(spark, d):
    """Hits of vectors, with a query and a text put together from labels."""
    hits = catalogue_search._dense(spark, d)
    labels = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("w"), F.col("label").cast("string"), F.lit(" x"), (F.col("vec_id") % 3).cast("string")).alias("text"))
    asked = labels.select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    return hits.join(labels, "id").join(asked, "query_id")


def reranked(spark, d):
    """The best five of each query's hits by the share of its words that they hold."""
    out = ranking.rerank(_asked_turns(spark, d), ranking.overlap_scorer(F.col("query"), F.col("text")), 5)
    return out.select("query_id", "id", "new_rank", F.round("rerank_score", 6).alias("score"))


def reliable_queries(spark, d):
    return search.reliable(catalogue_search._dense(spark, d), 0.5).select("query_id", F.col("reliable").cast("int").alias("reliable"))


def distinct_sources(spark, d):
    """Hits as sources of labels: some without an id, some without a title."""
    hits = catalogue_search._dense(spark, d).join(catalogue_search._labels(spark, d), "id")
    rows = hits.select("query_id", "rank", F.when(F.col("label") % 3 != 0, F.col("label")).alias("doc_id"), F.when(F.col("label") % 2 == 0, F.concat(F.lit("t"), F.col("label").cast("string"))).alias("title"))
    return ranking.distinct_sources(rows).select("query_id", "rank")


def rewrite_needed(spark, d):
    """Follow-up questions that lean on what came before."""
    turns = load(spark, d, "conversations")
    question = F.when(F.col("turn") % 3 == 0, "那费用呢").when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("它"), "text"))
    return turns.select("conv_id", "turn", rules.needs_rewrite(question, F.col("turn") > 0).cast("int").alias("needed"))


def trace_status(spark, d):
    """Traces of eight events each, as stages."""
    stage = F.struct(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "total").otherwise(F.col("event_type")).alias("name"), F.col("value").alias("duration_ms"), (F.col("value") < 150).alias("success"), F.lit(None).cast("string").alias("error"))
    traces = load(spark, d, "events").groupBy(F.floor(F.col("event_id") / 8).alias("trace_id")).agg(F.array_sort(F.collect_list(stage)).alias("stages"), F.bool_or(F.col("event_type") == "error").alias("fallback"))
    out = operations.trace_summary(traces)
    return out.select("trace_id", "status", "stages", F.array_join("failed_stages", ",").alias("failed"), F.round("total_ms", 4).alias("total_ms"))


def relevance_ids(spark, d):
    """Ids of relevant documents without blanks and placeholders."""
    ids = F.array(F.col("source"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise("lang:x"), F.when(F.col("doc_id") % 2 == 0, " todo later").otherwise("z"))
    return load(spark, d, "documents").select("doc_id", F.array_join(evaluation.valid_ids(ids), "|").alias("ids"))


def evaluation_samples(spark, d):
    """Answered turns as samples, under other names, with what they lack."""
    rows = catalogue_eval._answered(spark, d)
    named = rows.select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("question")).alias("user_input"), F.when(F.col("conv_id") % 3 != 0, F.col("answer")).alias("response"), F.when(F.col("conv_id") % 5 == 0, F.array(F.lit(" "))).otherwise(F.array("question")).alias("retrieved_contexts"), F.col("truth").alias("reference"))
    out = datasets.normalised_samples(named)
    return out.groupBy("reasons").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("valid").cast("int")).alias("valid"), F.sum(F.size("contexts")).alias("contexts"))


def upserted(spark, d):
    """Labels with the last of several changes of some documents put in."""
    now = load(spark, d, "labels").select("doc_id", "quality")
    first = load(spark, d, "documents").select("doc_id", F.lit(7).alias("quality"), F.lit(1).alias("seq")).where("doc_id % 4 = 0")
    changes = first.unionByName(first.where("doc_id % 8 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit(2).alias("seq")))
    return datasets.upsert(now.select("doc_id", F.col("quality").cast("int").alias("quality")), changes, ["doc_id"])


def synchronised(spark, d):
    """Labels after a client's changed rows came in and rows that it no longer has went."""
    now = load(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    docs = load(spark, d, "documents")
    return datasets.synchronised(now, docs.where("doc_id % 7 = 0").select("doc_id", F.lit(5).alias("quality")), docs.where("n_chars > 300").select("doc_id"), "doc_id")


def report_rows(spark, d):
    """Rows of a Markdown report."""
    return datasets.markdown_rows(load(spark, d, "pages").select("page_id", F.concat("url", F.lit("|x")).alias("url")), "page_id", "url")


def exported_turns(spark, d):
    rows = load(spark, d, "conversations")
    return datasets.conversation_lines(rows, F.col("text"), F.col("role"), "html").select("conv_id", "turn", F.md5("line").alias("digest"))


def file_types(spark, d):
    """Pages by the extension of their path, and whether their text is too short to be a text layer."""
    pages = load(spark, d, "pages")
    path = F.concat(F.lit("/a.b/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".tar.Md").otherwise(""))
    return pages.groupBy(documents.extension(path).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum(documents.needs_ocr(F.substring("url", 9, 99)).cast("int")).alias("short"))


def titled_pages(spark, d):
    """Paragraphs of turns as documents, titled by their first line."""
    rows = load(spark, d, "conversations").select(F.concat("text", F.lit("\n\n  \n\nEnd of turn\nx")).alias("value"))
    out = datasets.titled_texts(rows)
    return out.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first"), F.sum(F.length("text")).alias("chars"))


def escaped_titles(spark, d):
    """Titles of pages, shortened, for use in HTML."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return load(spark, d, "pages").select("page_id", text.html_escaped(text.shortened(title, 30)).alias("title"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_LEANS = f"turn > 0 AND (length(q) < 5 OR regexp_matches(q, '{rules.REFERRING}') OR regexp_matches(q, '{rules.ELLIPTIC}') OR (regexp_matches(q, '^.+呢$') AND length(q) < 8))"

SQL = {
    "judge_scores": "SELECT event_id, CASE WHEN event_id % 11 > 1 THEN 0 ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN value > 1 THEN value / 100 ELSE value END)), 6) END AS score FROM events",
    "reranked": f"""WITH {catalogue_search._SCORED}, t AS (SELECT vec_id AS id, ['w' || label, 'x' || (vec_id % 3)] AS words, 'w' || label || ' x' || (vec_id % 3) AS text FROM embeddings),
 x AS (SELECT h.query_id, h.id, h.rank, count(*) OVER (PARTITION BY h.query_id) AS n, h.score AS own, len(list_filter(q.words, lambda w: contains(c.text, w))) / 2.0::DOUBLE AS share FROM dense h JOIN t c ON c.id = h.id JOIN t q ON q.id = h.query_id),
 y AS (SELECT *, CASE WHEN n = 1 THEN own ELSE 1 / (1 + exp(-(4 * share - 2))) END AS s FROM x WHERE rank <= 10)
 SELECT query_id, id, new_rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS new_rank FROM y) WHERE new_rank <= 5""",
    "reliable_queries": f"WITH {catalogue_search._SCORED} SELECT query_id, (max(score) >= 0.5)::INT AS reliable FROM dense GROUP BY 1",
    "distinct_sources": f"WITH {catalogue_search._SCORED}, k AS (SELECT query_id, rank, CASE WHEN label % 3 <> 0 THEN 'i:' || label WHEN label % 2 = 0 THEN 't:t' || label ELSE 'r:' || rank END AS source FROM dense) SELECT query_id, min(rank) AS rank FROM k GROUP BY query_id, source",
    "rewrite_needed": f"SELECT conv_id, turn, ({_LEANS})::INT AS needed FROM (SELECT conv_id, turn, trim(CASE turn % 3 WHEN 0 THEN '那费用呢' WHEN 1 THEN text ELSE '它' || text END) AS q FROM conversations)",
    "trace_status": "SELECT event_id // 8 AS trace_id, CASE WHEN bool_or(value >= 150) THEN 'error' WHEN bool_or(event_type = 'error') THEN 'fallback' ELSE 'ok' END AS status, count(*) AS stages, coalesce(string_agg(CASE event_type WHEN 'view' THEN 'total' ELSE event_type END, ',' ORDER BY event_id) FILTER (value >= 150), '') AS failed, round(coalesce(sum(value) FILTER (event_type <> 'view'), 0), 4) AS total_ms FROM events GROUP BY 1",
    "relevance_ids": "SELECT doc_id, concat_ws('|', nullif(trim(source), ''), CASE WHEN doc_id % 3 <> 0 THEN 'lang:x' END, CASE WHEN doc_id % 2 <> 0 THEN 'z' END) AS ids FROM documents",
    "evaluation_samples": f"""WITH {catalogue_eval._ANSWERED}, s AS (SELECT CASE WHEN turn % 3 <> 0 THEN question ELSE '' END AS q, CASE WHEN conv_id % 3 <> 0 THEN answer ELSE '' END AS r, CASE WHEN conv_id % 5 <> 0 AND trim(question) <> '' THEN 1 ELSE 0 END AS c FROM a),
 w AS (SELECT c, concat_ws('; ', CASE WHEN trim(q) = '' THEN 'no question' END, CASE WHEN trim(r) = '' THEN 'no answer' END, CASE WHEN c = 0 THEN 'no contexts' END) AS reasons FROM s)
 SELECT reasons, count(*) AS n, sum((reasons = '')::INT)::BIGINT AS valid, sum(c)::BIGINT AS contexts FROM w GROUP BY 1""",
    "upserted": "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0) UNION ALL SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 9 ELSE 7 END FROM documents WHERE doc_id % 4 = 0",
    "synchronised": "SELECT * FROM (SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 0) UNION ALL SELECT doc_id, 5 FROM documents WHERE doc_id % 7 = 0) WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 300)",
    "report_rows": r"SELECT '| ' || page_id || ' | ' || replace(url || '|x', '|', '\|') || ' |' AS line FROM pages",
    "exported_turns": f"SELECT conv_id, turn, md5('<p><b>' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || '</b> ' || {_ESC.format('text')} || '</p>') AS digest FROM conversations WHERE trim(text) <> '' AND role <> 'welcome'",
    "file_types": "SELECT CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' ELSE '' END AS ext, count(*) AS n, sum((length(trim(substr(url, 9, 99))) < 30)::INT)::BIGINT AS short FROM pages GROUP BY 1",
    "titled_pages": r"""WITH p AS (SELECT list_filter(list_transform(regexp_split_to_array(text || chr(10) || chr(10) || '  ' || chr(10) || chr(10) || 'End of turn' || chr(10) || 'x', '\n\s*\n+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM conversations),
 u AS (SELECT unnest(range(len(parts))) AS pos, unnest(parts) AS text FROM p) SELECT pos, count(*) AS n, min(substr(string_split(text, chr(10))[1], 1, 40)) AS first, sum(length(text))::BIGINT AS chars FROM u GROUP BY 1""",
    "escaped_titles": f"SELECT page_id, {_ESC.format('t')} AS title FROM (SELECT page_id, CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '...' ELSE t END AS t FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages))",
}

QUERIES = {name: globals()[name] for name in SQL}
