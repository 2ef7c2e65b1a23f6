"""Registered queries over ``documents``, ``pages``, ``benchmark`` and ``conversations``: chunks, terms, rules, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import chunking, operations, ranking, state
from weftline.tables import half_up, load


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")


def chunk_lines(spark, d):
    return chunking.pieces(_docs(spark, d), "text", r"\n+").select("doc_id", "pos", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))


def short_line_blocks(spark, d):
    """Lines merged to paragraphs, short ones together."""
    rows = chunking.blocks(chunking.pieces(_docs(spark, d), "text", r"\n+"), least=60)
    return rows.select("doc_id", "block", F.length("paragraph").alias("chars"), F.md5("paragraph").alias("digest"))


def sentence_counts(spark, d):
    parts = chunking.sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(parts).alias("sentences"), F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).alias("longest"))


def indexed_chunks(spark, d):
    """Sentences of every paragraph, short ones merged, numbered through the document."""
    rows = chunking.indexed(_docs(spark, d), separator=r"\n+")
    return rows.select("chunk_id", "doc_id", "parent_id", "parent_idx", "chunk_index", F.length("text").alias("chars"))


def packed_chunks(spark, d):
    """Documents packed to chunks of at most 500 characters, by paragraphs, sentences and windows."""
    return _docs(spark, d).select("doc_id", F.posexplode(chunking.packed(F.col("text"))).alias("pos", "chunk")).select("doc_id", "pos", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


def force_split(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(chunking.windows(F.col("text"))).alias("pos", "piece")).select("doc_id", "pos", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))


def length_profile(spark, d):
    """Line lengths by source: percentiles by floor index, and four classes."""
    lines = _docs(spark, d).select("source", F.explode(F.split("text", r"\n+")).alias("line")).select("source", F.length(F.trim("line")).alias("n")).where("n > 0")
    part = lambda low, high, name: F.count_if((F.col("n") >= low) & (F.col("n") < high)).alias(name)
    classes = lines.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), part(0, 10, "under_10"), part(10, 25, "under_25"), part(25, 100, "under_100"), part(100, 1 << 30, "longer"))
    return classes.join(operations.percentiles(lines, "source", "n", {f"p{int(p * 100)}": operations.floor_index(p) for p in (0.5, 0.9, 0.99)}), "source")


def proportional_allocation(spark, d):
    groups = _docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    return chunking.shares(groups, "docs", 100, "source")


def context_budget(spark, d):
    """Documents of each source in order while they fit in 6000 characters; the first that does not is cut."""
    return ranking.fit_budget(_docs(spark, d).select("source", "doc_id", "n_chars"), F.col("n_chars"), [F.col("doc_id")], "source")


def table_documents(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.count_if(chunking.table_like(F.col("text"))).alias("tables"), F.count(F.lit(1)).alias("docs"))


def keyword_search_snippet(spark, d):
    hit = text.snippet(F.col("text"), "license")
    return _docs(spark, d).select("doc_id", F.locate("license", F.lower("text")).alias("place"), hit.alias("snippet")).where("place > 0")


def speech_text_digest(spark, d):
    spoken = text.speech_text(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length(spoken).alias("chars"), F.md5(spoken).alias("digest"))


def category_infer(spark, d):
    words = {"law": ["license", "licensed", "rights", "copyright"], "english": [" the ", " of ", " and "], "german": [" der ", " die ", " und "], "romance": [" de ", " la ", " que "]}
    kind = rules.keyword_category(F.lower("text"), words)
    return _docs(spark, d).select("lang", F.coalesce(kind, F.lit("none")).alias("category")).groupBy("lang", "category").agg(F.count(F.lit(1)).alias("docs"))


def document_filter(spark, d):
    """Documents whose source is or begins with a group and whose text holds a word, counted by language."""
    rows = _docs(spark, d).where((F.col("source") == "src3") | F.col("source").startswith("src1"))
    return rows.where(F.contains(F.lower("text"), F.lit("the"))).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"))


def html_text_extract(spark, d):
    body = text.markup_removed(F.col("html"))
    return load(spark, d, "pages").select("page_id", F.length(body).alias("chars"), F.md5(body).alias("digest"))


def benchmark_terms(spark, d):
    """Hashed bigram counts of every benchmark text, as a sparse vector's entries."""
    rows = load(spark, d, "benchmark").select("item_id", F.explode(text.ngrams(F.lower(F.trim("text")), 2)).alias("g")).groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("n"))
    keyed = rows.select("item_id", (text.hash31(F.concat(F.lit("b:"), F.col("g"))) % 16777214).alias("key"), "n")
    return keyed.groupBy("item_id", "key").agg(F.sum("n").alias("tf"))


def turn_similarity(spark, d):
    """Bigram similarity of each turn to the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    return rows.select("conv_id", "turn", F.round(text.jaccard(text.distinct_bigrams(F.col("text")), text.distinct_bigrams(F.col("before"))), 6).alias("similarity"))


def intent_route(spark, d):
    """Routes of user turns under rules for Latin text."""
    said = load(spark, d, "conversations").where("role = 'user'")
    way = rules.route(F.col("text"), [r"(^|\s)the(\s|$)", r"(^|\s)der(\s|$)"], multi_step=r"(?s)(^|\s)(and|und)\s.*\s(and|und)(\s|$)", numeric=r"\d", calculate=r"[+*/^-]")
    return said.select("conv_id", "turn", way.alias("w")).select("conv_id", "turn", "w.intent", "w.route", F.coalesce("w.tool", F.lit("none")).alias("tool"), "w.confidence")


def question_types(spark, d):
    kind = rules.question_type(F.lower("text"), (("authoritative", r"(^|\s)of(\s|$)"), ("factual", r"\d"), ("knowledge", r"(^|\s)(is|was)(\s|$)")))
    rows = load(spark, d, "conversations").select("role", kind.alias("type"))
    return rows.groupBy("role", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(rules.type_settings(F.col("type"))["base"]), 2).alias("base"))


def query_terms(spark, d):
    said = load(spark, d, "conversations").where("role = 'user'")
    return said.select("conv_id", "turn", F.explode(text.query_terms(F.col("text"))).alias("term"))


def history_budget(spark, d):
    return state.history_within(load(spark, d, "conversations"), "conv_id", "turn", "text", 4, 300, 900).select("conv_id", "turn", "back", F.length("kept").alias("chars"))


def history_compaction(spark, d):
    return state.compaction(load(spark, d, "conversations"), "conv_id", "turn", "role", 3).groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


def session_digest(spark, d):
    return state.session_digest(load(spark, d, "conversations"), "conv_id", "turn", "role", "text").na.fill("")


def client_history(spark, d):
    return state.client_history(load(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "role")


def conversation_list(spark, d):
    """Conversations by last turn, with their number of turns and a title from the first user turn."""
    rows = load(spark, d, "conversations")
    out = rows.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("turns"), F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 20)), F.when(F.col("role") == "user", F.col("turn"))).alias("title"))
    return out.na.fill("")


def memory_ranking(spark, d):
    """Earlier turns of a conversation ranked for its last one, as memories."""
    rows = load(spark, d, "conversations")
    last = rows.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"), F.max("turn").alias("at"))
    held = rows.join(last, "conv_id").where(F.col("turn") < F.col("at"))
    near = text.jaccard(text.distinct_bigrams(F.col("text")), text.distinct_bigrams(F.col("query")))
    scored = held.withColumn("score", F.round(state.memory_score(F.col("query"), F.col("text"), near, F.col("turn")), 6))
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("conv_id", "turn", "score", "rank")


def share_of_roles(spark, d):
    n = F.count(F.lit(1))
    return load(spark, d, "conversations").groupBy("role").agg(n.alias("turns"), half_up(F.avg(F.length("text")), 2).alias("mean_chars"))


_LINES = r"lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, piece FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, trim(unnest(l), ' ' || chr(9) || chr(10) || chr(13)) AS piece FROM (SELECT doc_id, regexp_split_to_array(text, '\n+') AS l FROM documents)) WHERE piece <> '')"
_SENT = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({t}, '(?m)^([- ]*[A-D])\.\s', '\1' || chr(1), 'g'), '([。！？.!?\n])\s*', '\1' || chr(2), 'g'), chr(2)), lambda x: replace(trim(x, ' ' || chr(9) || chr(10) || chr(13)), chr(1), '. ')), lambda x: x <> '')"
_GRAMS = "list_distinct(list_transform(range(1, length({t})), lambda i: substring({t}, i::INT, 2)))"
_SQUEEZE = r"regexp_replace({t}, '\s+', '', 'g')"

SQL = {
    "chunk_lines": f"WITH {_LINES} SELECT doc_id, pos, length(piece) AS chars, md5(piece) AS digest FROM lines",
    "short_line_blocks": rf"""WITH {_LINES}, m AS (SELECT *, regexp_matches(piece, '(?i)^###\s+Q\d') AS q, NOT (regexp_matches(piece, '(?i)^###\s+Q\d') OR regexp_matches(piece, '^[- ]*[A-D]\.') OR regexp_matches(piece, '^\*\*答案')) AND length(piece) >= 60 AS alone FROM lines),
 b AS (SELECT *, sum(CASE WHEN q OR alone OR coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM (SELECT *, lag(alone) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM m))
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS block, length(p) AS chars, md5(p) AS digest FROM (SELECT doc_id, b, string_agg(piece, chr(10) ORDER BY pos) AS p FROM b GROUP BY 1, 2)""",
    "sentence_counts": f"SELECT doc_id, len(s) AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (SELECT doc_id, {_SENT.format(t='text')} AS s FROM documents)",
    "force_split": "SELECT doc_id, pos, length(piece) AS chars, md5(piece) AS digest FROM (SELECT doc_id, (i / 450)::INT AS pos, substring(text, (i + 1)::INT, 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS i FROM documents))",
    "length_profile": r"WITH l AS (SELECT source, length(trim(unnest(regexp_split_to_array(text, '\n+')))) AS n FROM documents), k AS (SELECT source, list_sort(list(n)) AS v FROM l WHERE n > 0 GROUP BY 1) SELECT source, len(v) AS lines, v[floor(len(v) * 0.5)::INT + 1] AS p50, v[floor(len(v) * 0.9)::INT + 1] AS p90, v[floor(len(v) * 0.99)::INT + 1] AS p99, len(list_filter(v, lambda x: x < 10)) AS under_10, len(list_filter(v, lambda x: x >= 10 AND x < 25)) AS under_25, len(list_filter(v, lambda x: x >= 25 AND x < 100)) AS under_100, len(list_filter(v, lambda x: x >= 100)) AS longer FROM k",
    "proportional_allocation": "WITH g AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1), p AS (SELECT *, greatest(1, floor(docs * 100 / sum(docs) OVER () + 0.5))::BIGINT AS part, row_number() OVER (ORDER BY source) AS n, count(*) OVER () AS m FROM g) SELECT source, docs, (part + CASE WHEN rest > 0 AND n = 1 THEN rest WHEN rest < 0 AND n = m THEN rest ELSE 0 END)::BIGINT AS part FROM (SELECT *, 100 - sum(part) OVER () AS rest FROM p)",
    "context_budget": "WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents), f AS (SELECT *, upto > 6000 AS partial, row_number() OVER (PARTITION BY source, upto > 6000 ORDER BY doc_id) AS k, 6000 - (upto - n_chars) AS room FROM r) SELECT source, doc_id, n_chars, partial, (CASE WHEN partial THEN room ELSE n_chars END)::BIGINT AS used FROM f WHERE NOT partial OR (k = 1 AND room > 200)",
    "table_documents": r"""WITH l AS (SELECT doc_id, source, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
 f AS (SELECT *, len(list_filter(l, lambda x: contains(x, '|'))) AS pipes, len(list_filter(l, lambda x: regexp_full_match(replace(x, ' ', ''), '[+\-=|]{4,}'))) AS rules, len(list_filter(l, lambda x: regexp_matches(x, '序号|名称|数量|金额|价格|单价|日期|姓名|学号|电话|部门|项目|备注|合计|成绩|编号|型号|规格') AND len(list_filter(regexp_split_to_array(x, '\s{2,}'), lambda y: y <> '')) >= 2)) AS heads, list_filter(list_transform(l, lambda x: len(list_filter(regexp_split_to_array(x, '\s{2,}'), lambda y: y <> ''))), lambda n: n >= 2) AS many FROM l)
 SELECT source, count_if(len(l) >= 3 AND (pipes >= 3 OR (rules >= 2 AND len(many) >= 3) OR (len(many) >= 5 AND len(list_filter(list_distinct(many), lambda n: len(list_filter(many, lambda m: m = n)) >= 4)) > 0) OR (heads >= 2 AND len(many) >= 4)))::BIGINT AS tables, count(*) AS docs FROM f GROUP BY 1""",
    "keyword_search_snippet": "SELECT doc_id, place, concat(CASE WHEN place - 10 > 1 THEN '...' ELSE '' END, substring(text, greatest(1, place - 10), least(n, place + 24) - greatest(1, place - 10) + 1), CASE WHEN place + 24 < n THEN '...' ELSE '' END) AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'license') AS place, length(text) AS n FROM documents) WHERE place > 0",
    "speech_text_digest": r"""SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' 代码内容已省略。 ', 'g'), '`([^`]+)`', '\1', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', '', 'g'), '(?m)^#{1,6}\s+', '', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '(?m)^\s*\d+[.)、]\s+', '', 'g'), '[>*_~|]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents)""",
    "category_infer": "WITH h AS (SELECT lang, t, (contains(t, 'license')::INT + contains(t, 'licensed')::INT + contains(t, 'rights')::INT + contains(t, 'copyright')::INT) AS a, (contains(t, ' the ')::INT + contains(t, ' of ')::INT + contains(t, ' and ')::INT) AS b, (contains(t, ' der ')::INT + contains(t, ' die ')::INT + contains(t, ' und ')::INT) AS c, (contains(t, ' de ')::INT + contains(t, ' la ')::INT + contains(t, ' que ')::INT) AS d FROM (SELECT lang, lower(text) AS t FROM documents)) SELECT lang, CASE WHEN greatest(a, b, c, d) < 2 THEN 'none' WHEN a = greatest(a, b, c, d) THEN 'law' WHEN b = greatest(a, b, c, d) THEN 'english' WHEN c = greatest(a, b, c, d) THEN 'german' ELSE 'romance' END AS category, count(*) AS docs FROM h GROUP BY 1, 2",
    "document_filter": "SELECT source, lang, count(*) AS docs FROM documents WHERE (source = 'src3' OR starts_with(source, 'src1')) AND contains(lower(text), 'the') GROUP BY 1, 2",
    "html_text_extract": r"""SELECT page_id, length(b) AS chars, md5(b) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS b FROM pages)""",
    "benchmark_terms": "WITH g AS (SELECT item_id, substring(t, unnest(range(1, length(t)))::INT, 2) AS g FROM (SELECT item_id, lower(trim(text)) AS t FROM benchmark)), c AS (SELECT item_id, g, count(*) AS n FROM g GROUP BY 1, 2), h AS (SELECT item_id, n, list_reduce(list_prepend(0::BIGINT, list_transform(string_split('b:' || g, ''), lambda c: unicode(c)::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296) AS u FROM c) SELECT item_id, abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) % 16777214 AS key, sum(n)::BIGINT AS tf FROM h GROUP BY 1, 2",
    "turn_similarity": f"WITH p AS (SELECT conv_id, turn, {_SQUEEZE.format(t='text')} AS a, {_SQUEEZE.format(t='before')} AS b FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL), g AS (SELECT conv_id, turn, {_GRAMS.format(t='a')} AS a, {_GRAMS.format(t='b')} AS b FROM p) SELECT conv_id, turn, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS similarity FROM g",
    "intent_route": r"""WITH u AS (SELECT conv_id, turn, lower(trim(text)) AS t FROM conversations WHERE role = 'user'), k AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)^(你好|您好|嗨|哈喽|hello|hi|hey|在吗|早上好|中午好|下午好|晚上好|晚安|谢谢|感谢|多谢|再见|拜拜|bye|goodbye|辛苦了|好的|好的吧)[!！.。~～]?$') THEN 1 WHEN regexp_matches(t, '(?s)(^|\s)(and|und)\s.*\s(and|und)(\s|$)') THEN 2 WHEN regexp_matches(t, '\d') AND regexp_matches(t, '[+*/^-]') THEN 3 WHEN regexp_matches(t, '(^|\s)the(\s|$)') OR regexp_matches(t, '(^|\s)der(\s|$)') THEN 4 ELSE 5 END AS k FROM u)
 SELECT conv_id, turn, CASE k WHEN 1 THEN 'general_chat' WHEN 2 THEN 'complex_task' WHEN 3 THEN 'calculation_task' WHEN 4 THEN 'knowledge_query' ELSE 'general_chat' END AS intent, CASE k WHEN 1 THEN 'chat' WHEN 2 THEN 'agent' WHEN 3 THEN 'agent' WHEN 4 THEN 'rag' ELSE 'chat' END AS route, CASE k WHEN 3 THEN 'calculate' ELSE 'none' END AS tool, (CASE k WHEN 1 THEN 0.95 WHEN 2 THEN 0.75 WHEN 3 THEN 0.9 WHEN 4 THEN 0.85 ELSE 0.3 END)::DOUBLE AS confidence FROM k""",
    "question_types": r"WITH t AS (SELECT role, CASE WHEN regexp_matches(lower(text), '(^|\s)of(\s|$)') THEN 'authoritative' WHEN regexp_matches(lower(text), '\d') THEN 'factual' WHEN regexp_matches(lower(text), '(^|\s)(is|was)(\s|$)') THEN 'knowledge' ELSE 'general' END AS type FROM conversations) SELECT role, type, count(*) AS n, (CASE type WHEN 'authoritative' THEN 0.5 WHEN 'factual' THEN 0.4 WHEN 'knowledge' THEN 0.25 ELSE 0.3 END)::DOUBLE AS base FROM t GROUP BY 1, 2",
    "query_terms": r"SELECT conv_id, turn, unnest(list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), regexp_extract_all(lower(text), '\d+')))) AS term FROM conversations WHERE role = 'user'",
    "history_budget": "WITH b AS (SELECT conv_id, turn, row_number() OVER w AS back, length(substring(text, 1, 300)) AS chars, sum(length(substring(text, 1, 300))) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM conversations WHERE length(trim(text)) > 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, back, chars FROM b WHERE back <= 4 AND (back = 1 OR total <= 900)",
    "history_compaction": "WITH p AS (SELECT conv_id, text, CASE WHEN role = 'system' THEN 'system' WHEN row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) <= 3 THEN 'recent' ELSE 'summarised' END AS part FROM conversations) SELECT conv_id, part, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM p GROUP BY 1, 2",
    "session_digest": r"WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, coalesce(substring(max_by(trim(regexp_replace(text, '\s+', ' ', 'g')), turn) FILTER (role = 'user'), 1, 60), '') AS last_user, coalesce(substring(max_by(trim(regexp_replace(text, '\s+', ' ', 'g')), turn) FILTER (role = 'assistant'), 1, 120), '') AS last_assistant FROM r WHERE k <= 6 GROUP BY 1",
    "client_history": "WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''), a AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM s WHERE k <= 20) SELECT conv_id, turn, role FROM a WHERE (after IS NULL OR after <> role) AND NOT (after IS NULL AND role = 'user')",
    "conversation_list": "SELECT conv_id, max(turn) AS last_turn, count(*) AS turns, coalesce(min_by(substring(text, 1, 20), turn) FILTER (role = 'user'), '') AS title FROM conversations GROUP BY 1",
    "memory_ranking": f"WITH l AS (SELECT conv_id, max_by(text, turn) AS query, max(turn) AS at FROM conversations GROUP BY 1), h AS (SELECT c.conv_id, c.turn, c.text, l.query, {_SQUEEZE.format(t='c.text')} AS a, {_SQUEEZE.format(t='l.query')} AS b FROM conversations c JOIN l ON l.conv_id = c.conv_id AND c.turn < l.at), g AS (SELECT *, {_GRAMS.format(t='a')} AS ga, {_GRAMS.format(t='b')} AS gb, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 1) AS words FROM h), s AS (SELECT conv_id, turn, round(0.3 * CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: contains(lower(text), w))) / len(words) ELSE 0 END + 0.7 * CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) ELSE 0 END + 0.01 * least(turn, 10), 6) AS score FROM g) SELECT * FROM (SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM s) WHERE rank <= 5",
    "share_of_roles": "SELECT role, count(*) AS turns, floor(avg(length(text)) * 100 + 0.5) / 100 AS mean_chars FROM conversations GROUP BY 1",
}

QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
