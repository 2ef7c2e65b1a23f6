"""Registered queries of messages, replies, memories, tools and knowledge bases, with their SQL.

Where a table has no column of the kind that an operator reads (a classifier's reply, say), it is put together from the
columns that are there, for every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import messages
from weftline.operators import evaluation, memory, operations, ranking, state
from weftline.plans import catalogue_eval, catalogue_search, retrieval
from weftline.tables import load


def procedure_questions(spark: SparkSession, d: str) -> DataFrame:
    turns = load(spark, d, "conversations")
    question = F.concat("text", F.when(F.col("turn") % 3 == 0, " 如何办理").otherwise(""))
    return turns.select("conv_id", "turn", messages.asks_procedure(question).cast("int").alias("procedure"))


def procedure_cards(spark, d):
    """Cards from replies: two steps, one without a text, a material that is blank for small parts, no place."""
    fence = F.when(F.col("p_partkey") % 2 == 0, "```json\n").otherwise("So: ")
    body = F.concat(
        F.lit('{"summary": "'), "p_name", F.lit('", "steps": ['), F.when(F.col("p_size") > 10, F.concat(F.lit('{"title": " '), "p_brand", F.lit(' "},'))).otherwise(""),
        F.lit('{"title": "", "detail": ""}], "materials": ["'), F.when(F.col("p_size") > 20, F.col("p_type")).otherwise(" "), F.lit('"]}'),
    )
    reply = F.when(F.col("p_size") == 7, F.lit("none {")).otherwise(F.concat(fence, body, F.when(F.col("p_partkey") % 2 == 0, "\n```").otherwise(".")))
    rows = load(spark, d, "part").select("p_partkey", messages.procedure_card(reply).alias("c")).where("c IS NOT NULL")
    return rows.select("p_partkey", F.col("c.summary").alias("summary"), F.array_join(F.transform("c.steps", lambda s: F.concat(s["title"], F.lit("/"), s["detail"])), ",").alias("steps"), F.array_join("c.materials", ",").alias("materials"))


def reply_intents(spark, d):
    """Intents of a classifier's replies; those without JSON fall back to chat."""
    named = F.when(F.col("event_type") == "click", "knowledge_query").when(F.col("event_type") == "view", "complex_task").otherwise("unheard_of")
    reply = F.when(F.col("event_type") == "error", "no idea").otherwise(F.concat(F.lit('Sure: {"intent": "'), named, F.lit('", "confidence": '), F.col("value").cast("string"), F.lit("} done")))
    fallback = F.struct(F.lit("general_chat").alias("intent"), F.lit("chat").alias("route"), F.lit(0.3).alias("confidence"))
    rows = load(spark, d, "events").select(messages.reply_intent(reply, fallback).alias("r")).select("r.*")
    return rows.groupBy("intent", "route").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def message_forms(spark, d):
    """Messages whose text came under one of three names."""
    turns = load(spark, d, "conversations")
    named = [F.when(F.col("turn") % 3 == i, F.col("text")).alias(c) for i, c in enumerate(("content", "body", "message"))]
    rows = turns.select("conv_id", "turn", "role", *named)
    return memory.normalised_turns(rows, "role", "content", "body", "message").select("conv_id", "turn", "role", F.md5("content").alias("digest"))


def embedding_forms(spark, d):
    """Vectors that came in three forms, in one."""
    e, kind = F.col("embedding"), F.col("vec_id") % 3
    sparse = F.create_map(F.col("label").cast("int"), F.lit(1.0))
    parts = messages.embedding_parts(F.when(kind == 0, e), F.when(kind == 1, e), F.when(kind == 2, e), F.when((kind == 1) | (kind == 0), sparse), F.when(kind == 2, sparse))
    return load(spark, d, "embeddings").select("vec_id", parts.alias("p")).select("vec_id", F.size("p.dense").alias("dense"), F.size("p.sparse").alias("sparse"), F.round(F.col("p.dense")[0].cast("double"), 6).alias("first"))


def rewrite_keys(spark, d):
    """What a rewritten question of each user turn is remembered by."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    history = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w)
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role", "text", history.alias("h")).where("role = 'user' AND size(h) > 0")
    return rows.select("conv_id", "turn", F.md5(messages.rewrite_key(F.col("text"), F.col("h"))).alias("key"))


def profile_facts(spark, d):
    turns = load(spark, d, "conversations")
    about = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("我叫学生"), F.col("conv_id").cast("string"), F.lit("，我在计算机学院，学号 2024"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit(" 专业是数学 "))).otherwise("")
    return turns.select("conv_id", "turn", F.explode(messages.profile_facts(F.concat("text", F.lit(" "), about))).alias("f")).select("conv_id", "turn", "f.field", "f.value")


def extracted_memories(spark, d):
    rows = catalogue_eval._answered(spark, d)
    question = F.concat("question", F.when(F.col("conv_id") % 4 == 0, " 我喜欢").otherwise(""))
    answer = F.concat("answer", F.when(F.col("conv_id") % 3 == 0, " 2024-05").otherwise(""))
    found = rows.select("conv_id", "turn", F.explode(messages.memories(question, answer)).alias("m")).select("conv_id", "turn", "m.*")
    return found.select("conv_id", "turn", "type", F.md5("content").alias("digest"), "confidence")


def remembered_events(spark, d):
    """What users' memories hold after all events: kinds with a number, many of them alike."""
    log = load(spark, d, "events").withColumn("content", F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k")))
    return memory.remembered(log, "user_id", "event_id", "content")


def memory_contexts(spark, d):
    """The context of a reply in each conversation: counts as facts, the best user turns, the last turn."""
    turns = load(spark, d, "conversations").withColumn("score", F.col("turn") % 7 / 10)
    said = operations.last_n(turns.where("role = 'user'"), ["conv_id"], 5, F.desc("score"), "turn")
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "turn", "text")))
    best = said.groupBy("conv_id").agg(F.transform(order, lambda m: F.struct((-m["s"]).alias("score"), F.lit("fact").alias("type"), m["text"].alias("content"))).alias("memories"))
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("text", "turn").alias("recent")).join(best, "conv_id", "left")
    profile = F.array(F.struct(F.lit("turns").alias("field"), F.col("n").cast("string").alias("value")))
    context = memory.memory_context(profile, F.coalesce("memories", F.array().cast("array<struct<score double, type string, content string>>")), F.col("recent"))
    return whole.select("conv_id", F.length(context).alias("chars"), F.md5(context).alias("digest"))


def tool_call_parts(spark, d):
    """Calls put together from fragments; error events lose theirs."""
    at = F.floor(F.col("event_id") / 2) % 4
    lost = F.col("event_type") == "error"
    part = F.when(lost, "").when(at == 0, '{"k": ').when(at == 1, F.col("value").cast("string")).when(at == 2, "").otherwise("}")
    rows = load(spark, d, "events").select(F.floor(F.col("event_id") / 8).alias("stream_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 2).alias("index"), F.when(at == 0, F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("id"), F.when((at == 0) & ~lost, F.col("event_type")).alias("name"), part.alias("arguments"))
    return memory.tool_calls(rows)


def shared_copies(spark, d):
    rows = memory.shared_copy(load(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return rows.select("conv_id", "turn", "role", F.length("text").alias("chars"))


def wire_events(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "click", "tool_result").when(e == "view", "retrieval").when(e == "error", "content").otherwise("intent")
    wire = memory.wire_event(kind, F.col("event_id") % 5 == 0, e, F.lit("search"), F.when(F.col("event_id") % 2 == 0, "found"), F.floor(F.col("value")))
    return load(spark, d, "events").select("event_id", wire.alias("wire")).where("wire IS NOT NULL")


def human_score_export(spark, d):
    scores = load(spark, d, "labels").select("doc_id", F.col("quality").alias("score"), F.when(F.col("toxic") == 1, "toxic").alias("comment"))
    return memory.scored_by_people(load(spark, d, "documents").select("doc_id", "source"), scores, "doc_id").na.fill(-1.0, ["human_score"])


def stage_timings(spark, d):
    name = F.when(F.col("event_type") == "click", "llm").when(F.col("event_type") == "view", "rerank").when(F.col("event_type") == "error", "total").otherwise(F.col("event_type"))
    rows = load(spark, d, "events").select(name.alias("name"), "value").where("name <> 'total' AND value >= 0")
    return rows.groupBy(messages.stage_label(F.col("name")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def derived_measures(spark, d):
    """Token totals, cost and clamped per cent by kind of event."""
    k = F.get_json_object("props", "$.k")
    rows = load(spark, d, "events")
    return rows.groupBy("event_type").agg(F.sum(F.coalesce(k.try_cast("long"), F.lit(0)) + 1).alias("tokens"), F.round(F.sum("value") / 1000, 3).alias("cost"), F.round(F.avg(messages.percent(F.col("value") / 100)), 4).alias("percent"), F.round(F.avg(messages.unit_score(k)), 4).alias("unit"))


def keyword_recall(spark, d):
    """The plain recall of the truth's words, with the constant precision that goes with it."""
    rows = catalogue_eval._answered(spark, d)
    return rows.select("conv_id", "turn", F.round(messages.keyword_recall(F.col("truth"), F.col("answer")), 6).alias("recall"), F.when((F.col("truth") != "") & (F.col("answer") != ""), 0.7).otherwise(0.0).alias("precision"))


def calculated(spark, d):
    expression = F.concat(F.lit("2*"), F.col("value").cast("string"), F.lit(" + sqrt("), F.col("event_id").cast("string"), F.lit(")^2 / 4"))
    return load(spark, d, "events").select("event_id", F.round(messages.calculate(expression), 4).alias("result"))


_K = 5


def iterative_search(spark, d):
    """Pages for each host: its own, and while there are fewer than three, those of the next wider domain; at most five a round."""
    pages = load(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    part = F.split("host", r"\.")
    wider = pages.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, i, 9), "."))).alias("query"))
    best = operations.last_n(wider, ["query"], _K, "page_id")
    find = lambda asked: asked.join(best, "query").select("query_id", F.col("page_id").alias("doc_id"))
    shorter = F.regexp_replace("query", r"^[^.]+\.", "")
    rewrite = lambda left: left.where(F.contains("query", F.lit("."))).select("query_id", shorter.alias("query"))
    hosts = pages.select(F.col("host").alias("query_id"), F.col("host").alias("query")).distinct()
    return retrieval.iterated(hosts, find, rewrite)


def parent_sources(spark, d):
    """Hits by label as documents, in reading order, as sources."""
    hits = catalogue_search._dense(spark, d).join(catalogue_search._labels(spark, d), "id")
    children = hits.select("query_id", F.col("label").alias("doc_id"), (F.col("id") % 2).alias("parent_idx"), F.col("id").alias("chunk_index"), "rank", "score", F.array(F.lit("dense")).alias("channels"), F.col("id").cast("string").alias("text"))
    rows = ranking.in_reading_order(ranking.parent_sources(children))
    return rows.select("query_id", "place", "doc_id", "parent_idx", F.array_join("chunk_ids", ",").alias("chunk_ids"), "matched", F.array_join("channels", ",").alias("channels"), "first_rank", F.round("score", 6).alias("score"))


def source_contexts(spark, d):
    """Lines of documents that their labels name, else the beginnings."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk"))
    named = load(spark, d, "labels").select("doc_id", F.array(F.col("quality"), F.col("quality") + F.col("toxic")).alias("chunk_ids"))
    sources = docs.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("chunk_ids", F.array().cast("array<int>")).alias("chunk_ids"))
    return ranking.looked_up(sources, chunks, docs).select("doc_id", F.md5("context").alias("digest"))


def knowledge_stats(spark, d):
    """Documents in all and by category."""
    return evaluation.grouped_means(load(spark, d, "documents"), ["lang", "source"], ["n_chars"], 4)


def reindexed_category(spark, d):
    """An index of document sizes in characters, with one language counted anew in words."""
    docs = load(spark, d, "documents")
    old = docs.select("doc_id", "lang", F.length("text").alias("size"))
    new = docs.select("doc_id", "lang", F.size(F.filter(F.split("text", "[ \n\t]+"), lambda w: w != "")).alias("size"))
    return state.reindexed(old, new, "lang", "fr")


def taxonomy_rows(spark, d):
    children = load(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("value"), F.col("n_name").alias("label"))).alias("children"))
    tree = load(spark, d, "region").join(children, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("value"), F.col("r_name").alias("label"), "children")
    return state.flattened(tree).na.fill("", ["parent"])


def vector_profile(spark, d):
    rows = load(spark, d, "embeddings").withColumn("terms", F.create_map("label", F.lit(1.0)))
    return state.vector_fields(rows)


def answer_contexts(spark, d):
    """What the answer to each benchmark item is to be drawn from, among all turns of conversations."""
    turns = load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("parent_idx"), "text", F.col("role").alias("category"))
    return retrieval.search_knowledge(load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), turns)


_WORDS = r"regexp_extract_all(truth, '[a-zA-Z]{2,}|[\x{4e00}-\x{9fff}]{1,4}|\d+')"
_CARD_MATERIAL = "CASE WHEN p_size > 20 THEN trim(p_type) ELSE '' END"
_MEMORY = """u AS (SELECT conv_id, turn, text, turn % 7 / 10.0::DOUBLE AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 7 DESC, turn) AS place FROM conversations WHERE role = 'user'),
 b AS (SELECT conv_id, string_agg('- [fact] ' || text, chr(10) ORDER BY place) AS body FROM u WHERE place <= 5 AND s > 0.15 GROUP BY 1),
 t AS (SELECT conv_id, count(*) AS n, max_by(text, turn) AS recent FROM conversations GROUP BY 1),
 c AS (SELECT conv_id, concat_ws(chr(10) || chr(10), '[用户信息]' || chr(10) || '- turns: ' || n, CASE WHEN body <> '' THEN '[相关记忆]' || chr(10) || body END, CASE WHEN recent <> '' THEN '[近期对话]' || chr(10) || recent END) AS x FROM t LEFT JOIN b USING (conv_id)),
 z AS (SELECT conv_id, CASE WHEN length(x) > 3000 THEN substr(x, 1, 3000) || chr(10) || '...' ELSE x END AS x FROM c)"""
_PAGES = r"""p AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages),
 w AS (SELECT page_id, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') AS q FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p)),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY page_id) AS place FROM w) WHERE place <= 5),
 a1 AS (SELECT DISTINCT host AS query_id, host AS q FROM p), h1 AS (SELECT query_id, page_id, 1 AS round FROM a1 JOIN k USING (q)),
 a2 AS (SELECT query_id, regexp_replace(q, '^[^.]+\.', '') AS q FROM a1 WHERE query_id NOT IN (SELECT query_id FROM h1 GROUP BY 1 HAVING count(*) >= 3) AND contains(q, '.')), h2 AS (SELECT query_id, page_id, 2 AS round FROM a2 JOIN k USING (q)),
 a3 AS (SELECT query_id, regexp_replace(q, '^[^.]+\.', '') AS q FROM a2 WHERE query_id NOT IN (SELECT query_id FROM h2 GROUP BY 1 HAVING count(*) >= 3) AND contains(q, '.')), h3 AS (SELECT query_id, page_id, 3 AS round FROM a3 JOIN k USING (q))"""

SQL = {
    "procedure_questions": f"SELECT conv_id, turn, regexp_matches(text || CASE WHEN turn % 3 = 0 THEN ' 如何办理' ELSE '' END, '{messages.PROCEDURE}')::INT AS procedure FROM conversations",
    "procedure_cards": f"SELECT p_partkey, p_name AS summary, CASE WHEN p_size > 10 THEN trim(p_brand) || '/' ELSE '' END AS steps, {_CARD_MATERIAL} AS materials FROM part WHERE p_size <> 7 AND p_size > 10",
    "reply_intents": "SELECT intent, CASE intent WHEN 'knowledge_query' THEN 'rag' WHEN 'complex_task' THEN 'agent' ELSE 'chat' END AS route, count(*) AS n, round(avg(c), 6) AS confidence FROM (SELECT CASE event_type WHEN 'click' THEN 'knowledge_query' WHEN 'view' THEN 'complex_task' ELSE 'general_chat' END AS intent, CASE WHEN event_type = 'error' THEN 0.3::DOUBLE WHEN value = 0 THEN 0.5::DOUBLE ELSE value END AS c FROM events) GROUP BY 1, 2",
    "message_forms": "SELECT conv_id, turn, CASE WHEN role = 'assistant' OR coalesce(role, '') = '' THEN 'model' ELSE role END AS role, md5(trim(coalesce(text, ''))) AS digest FROM conversations",
    "embedding_forms": "SELECT vec_id, len(embedding) AS dense, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS sparse, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings",
    "rewrite_keys": "WITH h AS (SELECT conv_id, turn, role, text, string_agg(role || ':' || substr(text, 1, 100), '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM conversations) SELECT conv_id, turn, md5(lower(trim(text)) || '|' || h) AS key FROM h WHERE role = 'user' AND h IS NOT NULL",
    "profile_facts": r"""WITH m AS (SELECT conv_id, turn, text || ' ' || CASE WHEN turn % 3 = 0 THEN '我叫学生' || conv_id || '，我在计算机学院，学号 2024' || lpad(conv_id::VARCHAR, 8, '0') || ' 专业是数学 ' ELSE '' END AS t FROM conversations),
 f AS (SELECT conv_id, turn, unnest(['name', 'studentId', 'college', 'major']) AS field, unnest([coalesce(nullif(regexp_extract(t, '我叫(.{2,8})[，。！？\s]|我是(.{2,8})[，。！？\s]?同学', 1), ''), regexp_extract(t, '我叫(.{2,8})[，。！？\s]|我是(.{2,8})[，。！？\s]?同学', 2)), regexp_extract(t, '\b(\d{10,12})\b', 1), regexp_extract(t, '(?:我是|我在|在|于)?(.{2,6})学院', 1), coalesce(nullif(regexp_extract(t, '专业是(\S{2,20})|(\S{2,20})专业', 1), ''), regexp_extract(t, '专业是(\S{2,20})|(\S{2,20})专业', 2))]) AS v FROM m)
 SELECT conv_id, turn, field, v || CASE WHEN field = 'college' THEN '学院' ELSE '' END AS value FROM f WHERE v <> ''""",
    "extracted_memories": f"""WITH {catalogue_eval._ANSWERED}, m AS (SELECT conv_id, turn, question || CASE WHEN conv_id % 4 = 0 THEN ' 我喜欢' ELSE '' END AS q, answer || CASE WHEN conv_id % 3 = 0 THEN ' 2024-05' ELSE '' END AS r FROM a)
 SELECT conv_id, turn, 'qa' AS type, md5('用户问：' || q || chr(10) || '回答：' || substr(r, 1, 500)) AS digest, 0.7::DOUBLE AS confidence FROM m WHERE length(r) > 30 AND length(r) < 3000 AND q <> '' AND regexp_matches(r, '{messages.SPECIFIC}')
 UNION ALL SELECT conv_id, turn, 'preference', md5(q), 0.6::DOUBLE FROM m WHERE regexp_matches(q, '{messages.PREFERENCE}')""",
    "memory_contexts": f"WITH {_MEMORY} SELECT conv_id, length(x) AS chars, md5(x) AS digest FROM z",
    "tool_call_parts": """WITH f AS (SELECT event_id // 8 AS stream_id, event_id AS seq, event_id % 2 AS index, event_id // 2 % 4 AS pos, event_type, value FROM events),
 c AS (SELECT stream_id, index, max(CASE WHEN pos = 0 THEN 'c' || seq END) AS id, max(CASE WHEN pos = 0 AND event_type <> 'error' THEN event_type END) AS name, string_agg(CASE WHEN event_type = 'error' THEN '' WHEN pos = 0 THEN '{"k": ' WHEN pos = 1 THEN value::VARCHAR WHEN pos = 2 THEN '' ELSE '}' END, '' ORDER BY seq) AS a FROM f GROUP BY 1, 2)
 SELECT stream_id, index, id, name, CASE WHEN json_valid(a) THEN a ELSE '{}' END AS arguments FROM c WHERE name <> ''""",
    "shared_copies": "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE trim(text) <> '') WHERE place <= 200",
    "wire_events": """SELECT event_id, CASE event_type WHEN 'click' THEN '{"tool_result":{"name":"search","content":"' || CASE WHEN event_id % 2 = 0 THEN 'found' ELSE 'click' END || '","durationMs":' || floor(value)::BIGINT || '}}' WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN '[DONE]' ELSE '{"content":"error"}' END ELSE '{"intent":"' || event_type || '"}' END AS wire FROM events WHERE event_type <> 'view'""",
    "human_score_export": "SELECT doc_id, source, coalesce(nullif(quality, 0), -1)::DOUBLE AS human_score, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS comment FROM documents LEFT JOIN labels USING (doc_id)",
    "stage_timings": "SELECT CASE event_type WHEN 'click' THEN 'LLM 生成' WHEN 'view' THEN 'Rerank 重排' ELSE event_type END AS label, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE event_type <> 'error' AND value >= 0 GROUP BY 1",
    "derived_measures": "SELECT event_type, sum(coalesce(try_cast(props->>'$.k' AS BIGINT), 0) + 1)::BIGINT AS tokens, round(sum(value) / 1000, 3) AS cost, round(avg(greatest(0.0::DOUBLE, least(100.0::DOUBLE, value))), 4) AS percent, round(avg(coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, try_cast(props->>'$.k' AS DOUBLE))), 0)), 4) AS unit FROM events GROUP BY 1",
    "keyword_recall": f"""WITH {catalogue_eval._ANSWERED}, k AS (SELECT *, {_WORDS} AS words FROM a) SELECT conv_id, turn, CASE WHEN answer <> '' AND len(words) > 0 THEN round(len(list_filter(words, lambda w: contains(lower(answer), lower(w)))) / len(words)::DOUBLE, 6) ELSE 0 END AS recall, CASE WHEN truth <> '' AND answer <> '' THEN 0.7::DOUBLE ELSE 0 END AS "precision" FROM k""",
    "calculated": "SELECT event_id, round(2 * value + sqrt(event_id) ** 2 / 4, 4) AS result FROM events",
    "iterative_search": f"WITH {_PAGES} SELECT query_id, page_id AS doc_id, min(round) AS round FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY 1, 2",
    "parent_sources": f"WITH {catalogue_search._SCORED}, g AS (SELECT query_id, label AS doc_id, id % 2 AS parent_idx, string_agg(id::VARCHAR, ',' ORDER BY id) AS chunk_ids, count(*) AS matched, 'dense' AS channels, min(rank) AS first_rank, greatest(0.0::DOUBLE, least(1.0::DOUBLE, max(score))) AS score FROM dense GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, parent_idx) AS place FROM g",
    "source_contexts": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), n AS (SELECT DISTINCT doc_id, unnest([quality, quality + toxic]) AS i FROM labels)
 SELECT doc_id, md5(context) AS digest FROM (SELECT DISTINCT doc_id, trim(lines[i + 1]) AS context FROM l JOIN n USING (doc_id) WHERE i >= 0 UNION SELECT doc_id, trim(substr(text, 1, 1200)) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n WHERE i >= 0)) WHERE context <> ''""",
    "knowledge_stats": "SELECT 'all' AS grouping, 'all' AS value, count(*) AS n, round(avg(coalesce(n_chars, 0)), 4) AS mean_n_chars FROM documents UNION ALL SELECT 'lang', coalesce(lang, 'unknown'), count(*), round(avg(coalesce(n_chars, 0)), 4) FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*), round(avg(coalesce(n_chars, 0)), 4) FROM documents GROUP BY 2",
    "reindexed_category": "SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN len(list_filter(regexp_split_to_array(text, '[ ' || chr(10) || chr(9) || ']+'), lambda w: w <> '')) ELSE length(text) END AS size FROM documents",
    "taxonomy_rows": "SELECT 'r:' || r_regionkey AS value, r_name AS label, '' AS parent FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name, 'r:' || n_regionkey FROM nation",
    "vector_profile": "SELECT 'embedding' AS field, 'dense' AS kind, count(embedding) AS n, min(len(embedding)) AS least, max(len(embedding)) AS most FROM embeddings UNION ALL SELECT 'terms', 'sparse', count(*), 1, 1 FROM embeddings",
}

QUERIES = {name: globals()[name] for name in [*SQL, "remembered_events", "answer_contexts"]}
