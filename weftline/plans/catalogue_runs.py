"""Registered queries of evaluation runs, alerts, quotas, recalled memories, streams in chunks and contexts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.rules import ADVICE, DETAIL, HARD_REFUSAL, REFUSAL
from weftline.operators import chunking, evaluation, memory, operations, ranking, runs, search, state
from weftline.plans import catalogue_eval, catalogue_search, catalogue_text
from weftline.streaming import events as streams
from weftline.tables import load, micros


# --- labels carried from run to run


def _runs(spark, d):
    """A first run of dense candidates, of which labels are saved for those whose id allows it, and a second one of sparse candidates."""
    first = catalogue_search._dense(spark, d, 10).select("query_id", F.col("id").alias("parent_id"), "rank")
    second = catalogue_search._sparse(spark, d, 10).select("query_id", F.col("id").alias("parent_id"), "rank")
    label = F.when(F.col("parent_id") % 3 != 0, F.col("parent_id") % 2 == 0)
    note = F.when(F.col("parent_id") % 5 == 0, F.concat(F.lit("seen "), F.col("rank").cast("string")))
    empty = spark.createDataFrame([], "query_id long, parent_id long, run int, rank int, is_relevant boolean, note string, state string")
    store = runs.collected(first, empty, 1).withColumn("is_relevant", label).withColumn("note", note)
    return store, runs.collected(second, store, 2)


def label_carryover(spark, d):
    """The second run's rows for the label store: labels kept, new pairs, vanished ones."""
    return _runs(spark, d)[1]


def label_progress(spark, d):
    """How far the labelling of each question of the second run is; questions whose id ends in 60 count as failed."""
    questions = load(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    return runs.label_status(questions, _runs(spark, d)[1], questions.where("query_id % 100 = 60"))


def question_selection(spark, d):
    """The first fifty questions of a language, as an evaluation takes them."""
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("seq"), F.col("text").alias("question"), F.col("lang").alias("category"))
    return runs.selected_questions(rows, 50, "en").select("query_id", F.length("question").alias("chars"))


# --- an evaluation from questions to scores


def _answer(rows: pd.DataFrame) -> pd.Series:
    """The stand-in for a model: the first passage; it fails at questions whose length is divisible by 7."""
    if (rows["question"].str.len() % 7 == 0).any():
        raise ValueError("no reply")
    return rows["context"].str.split("\n").str[0]


def _evaluated(spark, d):
    hits = catalogue_eval.hybrid_weighted(spark, d).where("rank <= 3")
    turns = load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.regexp_replace("text", r"\n", " ").alias("text"))
    contexts = hits.join(turns, "id").select(F.col("query_id").alias("id"), F.col("rank").alias("place"), F.col("id").alias("name"), "text")
    items = load(spark, d, "benchmark")
    category = F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")))
    cases = items.select(F.col("item_id").alias("id"), F.col("text").alias("question"), category.alias("category"), F.lit(None).cast("string").alias("difficulty"), F.substring("text", 1, 40).alias("ground_truth"))
    return runs.evaluated_cases(cases, contexts, _answer)


def evaluation_run(spark, d):
    """Every benchmark item as a question: its passages, answer and measures; planted failures have their error in the row."""
    return _evaluated(spark, d).select("id", "category", "difficulty", F.md5("answer").alias("answer"), F.size("contexts").alias("n_contexts"), F.array_join("contexts", ",").alias("contexts"), *runs.METRICS, "via", F.coalesce("error", F.lit("")).alias("error"))


def evaluation_summary(spark, d):
    return runs.run_summary(_evaluated(spark, d))


def case_rules(spark, d):
    """Every answered question held against rules made of its turn: words expected, patterns forbidden, refusals, sources."""
    turns = load(spark, d, "conversations").where("role = 'assistant'").withColumn("case_id", F.col("conv_id") * 1000 + F.col("turn"))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) >= 8))
    expected = F.when(F.col("turn") % 4 != 0, F.concat(F.slice(words, 1, 2), F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("zebra"))).otherwise(F.array().cast("array<string>"))))
    rule = lambda name, pattern, unless: F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern"), F.lit(unless).cast("string").alias("unless"))
    forbidden = F.array(rule("number", "[0-9]{3}", "@"), rule("question", r"\?", None))
    rules = turns.where("conv_id % 7 <> 3").select("case_id", expected.alias("expected"), forbidden.alias("forbidden"), (F.col("conv_id") % 2 == 0).alias("may_refuse"), F.lit(2).alias("least_sources"))
    answer = F.when(F.col("conv_id") % 11 == 5, F.concat(F.lit("抱歉 "), F.col("text"))).otherwise(F.col("text"))
    sources = F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("conv_id") % 4).cast("string"), (F.col("turn") % 4).cast("string")))
    issues = runs.case_issues(rules, turns.select("case_id", answer.alias("answer"), sources.alias("sources")))
    return issues.select("case_id", F.array_join("issues", "; ").alias("issues"))


# --- operations


def operational_alerts(spark, d):
    """Of every event: error rate and p95 of its five minutes, its day's cost so far, and the alerts that follow."""
    rows = load(spark, d, "events").select("event_id", "ts", (F.col("value") * 30).alias("ms"), (F.col("value") / 1000).alias("cost"), "event_type")
    return operations.operational_alerts(rows, "event_id", "ts", "ms", "cost", F.col("event_type") == "error", "Asia/Shanghai", 5.0).withColumn("p95", F.round("p95", 6))


def quota_balance(spark, d):
    """Requests against two a user and day, where errors give their reserve back and sign-ups do not count."""
    action = F.when(F.col("event_type") == "error", "release").when(F.col("event_type") != "signup", "reserve")
    rows = load(spark, d, "events").select("event_id", "user_id", micros(F.col("ts")).alias("us"), operations.local_day(F.col("ts"), "Asia/Shanghai").alias("day"), action.alias("action"))
    return operations.quota_balance(rows, ["user_id", "day"], "action", 2, "us", "event_id").select("event_id", "balance", "ok")


def quota_balance_all(spark, d):
    """The same with one quota of forty for all users: a single key holds every row."""
    action = F.when(F.col("event_type") == "error", "release").otherwise("reserve")
    rows = load(spark, d, "events").select("event_id", F.lit("all").alias("key"), micros(F.col("ts")).alias("us"), action.alias("action"))
    return operations.quota_balance(rows, ["key"], "action", 40, "us", "event_id").select("event_id", "balance", "ok")


# --- memories


def _memories(spark, d):
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return load(spark, d, "embeddings").join(texts, "vec_id", "left").select(F.col("label").cast("long").alias("user"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.substring("text", 1, 300).alias("content"), (F.col("vec_id") % 13).alias("accesses"))


def memory_recall(spark, d):
    """The five best memories of its own user for every row whose id is divisible by 20, by words, vector and accesses."""
    rows = _memories(spark, d)
    asked = rows.where("id % 20 = 0").select("user", F.col("id").alias("query_id"), F.substring("content", 1, 60).alias("query"), "vector")
    return memory.recalled(rows, asked, 5, digits=6)


def memory_accesses(spark, d):
    """All memories with the accesses that those searches add."""
    rows = _memories(spark, d)
    asked = rows.where("id % 20 = 0").select("user", F.col("id").alias("query_id"), F.substring("content", 1, 60).alias("query"), "vector")
    return memory.accessed(rows, memory.recalled(rows, asked, 5, digits=6), 0.3).select("user", "id", "accesses")


# --- streams and texts


def chunked_stream(spark, d):
    """Every conversation as an event stream that arrives in pieces of 37 bytes, and the turns that are read from it; the last turn comes after the end mark."""
    turns = load(spark, d, "conversations")
    event = F.concat(F.when(F.col("turn") % 3 == 0, F.lit(": ping\r\n")).otherwise(F.lit("")), F.lit("data: "), F.to_json(F.struct("turn", "text")), F.lit("\n\n"))
    last = F.max("turn").alias("last")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", event.alias("event")))).alias("events"), last)
    log = F.array_join(F.transform("events", lambda e: F.concat(F.when(e["turn"] == F.col("last"), F.lit("data: [DONE]\n\n")).otherwise(F.lit("")), e["event"])), "")
    data = whole.select("conv_id", F.encode(log, "UTF-8").alias("log"))
    seqs = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("log") - 1) / 37).cast("int")))
    chunks = data.withColumn("seq", seqs).select("conv_id", "seq", F.expr("substring(log, seq * 37 + 1, 37)").alias("data"))
    rows = streams.stream_payloads(streams.joined_lines(chunks, "conv_id", "seq", "data"))
    field = lambda name, kind: F.try_variant_get("payload", f"$.{name}", kind)
    return rows.select(F.col("stream").alias("conv_id"), field("turn", "int").alias("turn"), F.md5(field("text", "string")).alias("digest"))


def merge_simulation(spark, d):
    """What merging short sentences of paragraphs does to the documents: one row of totals, lengths and length classes."""
    parents = chunking.pieces(load(spark, d, "documents"), "text", r"\n\n+").select(F.col("piece").alias("text"))
    return chunking.merge_report(parents)


def keyed_fusion(spark, d):
    """Dense and sparse hits as one list of things found, rows without an id known by document and chunk."""
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    part = lambda hits, n: hits.join(texts, "id", "left").select("query_id", F.when(F.col("id") % 4 != 0, F.col("id").cast("string")).otherwise(F.lit("")).alias("id"), F.expr("id div 8").alias("doc_id"), (F.col("id") % 8).alias("chunk_index"), (F.col("score") * 3).alias("score"), "rank", F.when(F.col("id") % 2 == n, F.col("lang")).alias("title"))
    rows = search.fuse_keyed(part(catalogue_search._dense(spark, d), 0), part(catalogue_search._sparse(spark, d), 1), 20)
    return rows.select("query_id", "key", "score", "vector_score", "keyword_score", "channels", F.coalesce("title", F.lit("-")).alias("title"), "rank")


def parent_contexts(spark, d):
    """For every query the context of the documents that its hits name: headers, whole texts, the last one cut."""
    docs = load(spark, d, "documents")
    hits = catalogue_search._dense(spark, d).join(docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 2500).alias("text")), "id")
    parents = hits.select("query_id", F.col("id").alias("doc_id"), (F.col("id") % 5).cast("int").alias("parent_idx"), "score", "text")
    entries = ranking.context_entries(parents, docs.where("doc_id % 9 <> 4").select("doc_id", F.concat_ws("/", "source", "lang").alias("title")))
    return ranking.contexts(entries).select("query_id", F.length("context").alias("chars"), F.md5("context").alias("digest"), "sources")


# --- grids, probes, tools, feedback, row forms

_PAIRS_BY_CATEGORY = [(0.2, 0.8), (0.4, 0.6), (0.5, 0.5), (0.6, 0.4), (0.7, 0.3), (0.8, 0.2)]
_PAIRS_BY_PREFIX = [(0.0, 1.0), (0.2, 0.8), (0.4, 0.6), (0.5, 0.5), (0.6, 0.4), (0.7, 0.3), (0.8, 0.2), (1.0, 0.0)]


def _grid(spark, d, pairs):
    queries, rows = catalogue_search._tables(spark, d)
    labels = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    hits = search.weight_grid(queries, rows, pairs, 50).join(labels, "id")
    return hits.select("dense", "sparse", "query_id", F.concat(F.lit("l"), F.col("label").cast("string"), F.lit("-"), F.col("id").cast("string")).alias("id"), "rank"), labels


def weight_grid_by_category(spark, d):
    """Six pairs of weights, exact lists of fifty, measured by category of the query."""
    hits, labels = _grid(spark, d, _PAIRS_BY_CATEGORY)
    wanted = labels.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat(F.lit("l"), F.col("label").cast("string"), F.lit("-")).alias("prefix"), (F.col("label") % 3).alias("category"))
    return evaluation.grid_metrics(hits, wanted, ["dense", "sparse", "category"])


def weight_grid_prefixes(spark, d):
    """Eight pairs of weights over questions of several sets, whose relevant ids may be cut short."""
    hits, labels = _grid(spark, d, _PAIRS_BY_PREFIX)
    asked = labels.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat(F.lit("l"), F.col("label").cast("string"), F.lit("-")).alias("own"), F.concat(F.lit("l"), ((F.col("label") + 1) % 10).cast("string")).alias("next"))
    first = asked.select("query_id", F.col("own").alias("prefix"))
    second = asked.where("query_id % 40 = 0").select("query_id", F.col("next").alias("prefix"))
    third = asked.where("query_id % 60 = 0").select("query_id", F.lit("TODO").alias("prefix"))
    return evaluation.grid_metrics(hits, first.unionByName(second).unionByName(third), ["dense", "sparse"])


def badcase_probe(spark, d):
    """Answers to every question as probes: refusals and missing sources planted, details without context told."""
    rows = catalogue_eval._answered(spark, d)
    answer = F.when(F.col("conv_id") % 4 == 1, F.concat(F.lit("资料不足。"), F.col("answer"))).otherwise(F.concat("answer", F.lit(" 42")))
    sources = F.when(F.col("turn") % 3 == 0, 0).otherwise(F.col("turn") % 4)
    context = F.when(F.col("conv_id") % 3 == 0, F.substring("question", 1, 20)).otherwise(F.col("question"))
    expected = F.when(F.col("conv_id") % 2 == 1, "generation_refusal").otherwise("pass")
    probes = rows.select(expected.alias("expected"), evaluation.probe_result(answer, sources).alias("actual"), evaluation.unsupported(answer, context).alias("unsupported"))
    return evaluation.probe_summary(probes)


def tool_accuracy(spark, d):
    """Choices of tools, as events tell them, by user group: some without an expected tool, errors without a time."""
    rows = load(spark, d, "events").select(
        (F.col("user_id") % 5).alias("run"), F.when(F.col("event_id") % 3 == 0, "rag").otherwise("agent").alias("expected_route"), F.when(F.col("event_id") % 4 == 0, "rag").otherwise("agent").alias("route"),
        F.when(F.col("event_id") % 5 > 0, F.when(F.col("event_id") % 2 == 0, "search").otherwise("calculate")).alias("expected_tool"), F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "calculate").alias("tool"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("ms"),
    )
    return evaluation.tool_accuracy(rows, "run")


def feedback_search(spark, d):
    """The second page of ten of the likes that a word is found in, with the sums over all of them."""
    rating = F.when(F.col("event_type").isin("purchase", "signup"), "like").when(F.col("event_type") == "error", "dislike")
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("question"), "source")
    rows = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created"), "user_id", rating.alias("rating"), "event_type").where("rating IS NOT NULL").join(texts, "id", "left")
    rows = rows.withColumn("titles", F.array(F.coalesce("source", F.lit("")), F.col("event_type")))
    return operations.feedback_page(rows, ["user_id", "question"], "titles", "like", " SIGN", 2, 10).select("id", "place", "total", "likes", "dislikes")


def compact_payloads(spark, d):
    """What of a document may go to a log: no secrets, addresses masked, long texts and lists cut, trace ids checked."""
    rows = load(spark, d, "documents")
    payload = F.create_map(F.lit("text"), F.col("text"), F.lit("api_Key"), F.col("text"), F.lit("url"), F.concat(F.lit("see https://x.test/"), F.col("doc_id").cast("string"), F.lit(" now")))
    words = operations.redacted_list(F.split(F.substring("text", 1, 5000), "\n"))
    trace = operations.trace_id(F.concat(F.lit(" t-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "/x").otherwise("\n")))
    kept = operations.redacted(payload)
    return rows.select("doc_id", F.size(kept).alias("keys"), F.md5(kept["text"]).alias("text"), kept["url"].alias("url"), F.size(words).alias("lines"), F.md5(F.array_join(words, "|")).alias("words"), F.coalesce(trace, F.lit("-")).alias("trace"))


def usage_totals(spark, d):
    """Tokens and cost by kind of event, from usage told under several names, some of it broken."""
    v, n = F.col("value").cast("string"), F.col("event_id").cast("string")
    shape = F.col("event_id") % 5
    usage = (
        F.when(shape == 0, F.concat(F.lit('{"prompt_tokens": '), n, F.lit(', "completion_tokens": 7}')))
        .when(shape == 1, F.concat(F.lit('{"input_tokens": '), n, F.lit(', "output_tokens": 3, "total_tokens": 1000}')))
        .when(shape == 2, F.concat(F.lit('{"prompt_tokens": "many", "input_tokens": 5, "output_tokens": '), v, F.lit("}")))
        .when(shape == 3, F.lit("{broken"))
    )
    rows = operations.usage_rows(load(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("model"), usage.alias("usage")), "usage", 2.0, 8.0)
    return operations.usage_totals(rows, "model", 4).withColumn("completion_tokens", F.round("completion_tokens", 3)).withColumn("total_tokens", F.round("total_tokens", 3))


def feedback_log(spark, d):
    """The event log of ratings: the newest twenty of each user, and of all."""
    rating = F.when(F.col("event_type").isin("purchase", "signup"), "like").when(F.col("event_type") == "error", "dislike")
    rows = load(spark, d, "events").select("event_id", "ts", F.concat(F.lit("u"), (F.col("user_id") % 6).cast("string")).alias("user"), rating.alias("rating")).where("rating IS NOT NULL")
    own = operations.feedback_events(rows, "user", 20, F.desc("ts"), F.desc("event_id"))
    return own.select("event_id", "user", "rating", "own", "common")


def conversation_search(spark, d):
    """Conversations that hold a word, in their title (the first user turn's beginning) or a message."""
    turns = load(spark, d, "conversations")
    titles = turns.where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 20).alias("title"))
    return state.matched_conversations(turns.select("conv_id").distinct().join(titles, "conv_id", "left"), turns, " EN ").select("conv_id", F.md5("preview").alias("preview"))


def highlights(spark, d):
    """The beginnings of pages as HTML, the first hit of a word marked."""
    shown = text.highlighted(F.substring("html", 1, 400), "div")
    return load(spark, d, "pages").select("page_id", F.length(shown).alias("chars"), F.md5(shown).alias("digest"))


def document_matches(spark, d):
    """Documents of one language and source; an empty condition does not count."""
    return search.matching(load(spark, d, "documents"), {"lang": "en", "source": "src3", "text": "", "n_chars": None}).select("doc_id", "n_chars")


def packed_trimmed(spark, d):
    """Documents packed as the evaluation does: paragraphs trimmed, blank ones dropped. A fold over paragraphs, so there is no SQL."""
    return load(spark, d, "documents").select("doc_id", F.posexplode(chunking.packed(F.col("text"), trimmed=True)).alias("pos", "chunk")).select("doc_id", "pos", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


def candidate_rows(spark, d):
    """Hits as candidates: those without an id or a parent get one, missing fields their defaults."""
    hits = catalogue_search._dense(spark, d).join(load(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id", "left")
    rows = hits.select("query_id", "rank", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("id"), F.expr("id div 6").alias("doc_id"), F.when(F.col("id") % 5 > 0, F.lit("")).otherwise("p").alias("parent_id"), F.expr("CAST(id div 3 % 2 AS INT)").alias("parent_idx"), (F.col("id") % 6).cast("int").alias("chunk_index"), F.col("lang").alias("category"), "score")
    return ranking.candidate_rows(rows).select("query_id", "rank", "id", "doc_id", "parent_id", "parent_idx", "chunk_index", "title", "category", "score", "hybrid_score", "rerank_model")


def parent_candidates(spark, d):
    """The same hits as one candidate a parent, with their chunks."""
    hits = catalogue_search._dense(spark, d)
    rows = hits.select("query_id", "rank", F.col("id").cast("string").alias("id"), F.expr("id div 12").alias("doc_id"), F.expr("CAST(id div 3 % 4 AS INT)").alias("parent_idx"), (F.col("id") % 3 - 1).cast("int").alias("chunk_index"), "score", F.array(F.lit("dense"), F.when(F.col("id") % 2 == 0, "sparse").otherwise("dense")).alias("channels"))
    docs = load(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("category"))
    parents = ranking.parent_candidates(ranking.candidate_rows(rows), docs)
    return parents.select("query_id", "rank", "id", "title", "category", "matched", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"), "first_child_rank", "best_child_rank", F.col("matched_score").alias("score"), F.array_join("channels", ",").alias("channels"), F.array_join(F.transform("children", lambda c: c["id"]), ",").alias("children"))


_W = f"WITH {catalogue_search._SCORED}"
_STORE = f"""{_W}, store AS (SELECT query_id, id AS parent_id, CASE WHEN id % 3 <> 0 THEN id % 2 = 0 END AS is_relevant, CASE WHEN id % 5 = 0 THEN 'seen ' || rank END AS note FROM dense WHERE rank <= 10),
 known AS (SELECT query_id, parent_id, is_relevant, coalesce(note, '') AS note FROM store WHERE is_relevant IS NOT NULL), cand AS (SELECT query_id, id AS parent_id, rank FROM sparse WHERE rank <= 10),
 next AS (SELECT query_id, parent_id, 2 AS run, rank, is_relevant, coalesce(note, '') AS note, CASE WHEN rank IS NULL THEN 'vanished' WHEN is_relevant IS NOT NULL THEN 'kept' ELSE 'new' END AS state FROM cand FULL JOIN known USING (query_id, parent_id))"""

_KEYWORDS, _SHARE = catalogue_eval._keywords_sql, catalogue_eval._share_sql
_CASES = f"""WITH {catalogue_eval._PAIRS},
 top AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(0.6::DOUBLE * dense + 0.4::DOUBLE * sparse, 9) AS score FROM p)) WHERE rank <= 3),
 texts AS (SELECT conv_id * 1000 + turn AS id, replace(text, chr(10), ' ') AS text FROM conversations),
 found AS (SELECT query_id, list(id ORDER BY rank) AS names, list(text ORDER BY rank) AS texts FROM top JOIN texts USING (id) GROUP BY 1),
 k AS (SELECT item_id AS id, CASE WHEN item_id % 3 > 0 THEN 'c' || (item_id % 3) ELSE 'general' END AS category, text AS question, substring(text, 1, 40) AS truth, coalesce(names, []) AS names, coalesce(texts, []) AS texts, coalesce(texts[1], '') AS reply, length(text) % 7 = 0 AS failed FROM benchmark LEFT JOIN found ON item_id = query_id),
 w AS (SELECT *, {_KEYWORDS('truth')} AS wanted, {_KEYWORDS('question')} AS asked, array_to_string(texts, chr(10)) AS context FROM k),
 r AS (SELECT *, NOT failed AND truth <> '' AND reply <> '' AS ok, {_SHARE('wanted', 'reply')} AS faithfulness, {_SHARE('asked', 'reply')} AS answer_relevancy, {_SHARE('wanted', 'context')} AS context_recall, CASE WHEN len(texts) > 0 THEN len(list_filter(texts, lambda s: len(list_filter(wanted, lambda w: contains(lower(s), w))) > 0)) / len(texts)::DOUBLE ELSE 0 END AS context_precision FROM w),
 o AS (SELECT *, (context_recall + answer_relevancy + faithfulness + context_precision) / 4 AS overall FROM r),
 run AS (SELECT id, category, 'medium' AS difficulty, md5(CASE WHEN failed THEN '[错误: no reply]' ELSE reply END) AS answer, CASE WHEN failed THEN 0 ELSE len(names) END::INT AS n_contexts, CASE WHEN failed THEN '' ELSE array_to_string(names, ',') END AS contexts, {', '.join(f"CASE WHEN ok THEN floor({c} * 100 + 0.5) / 100 ELSE 0 END AS {c}" for c in runs.METRICS)}, 'rag' AS via, CASE WHEN failed THEN 'no reply' ELSE '' END AS error FROM o)"""

_TURN_RULES = rf"""t AS (SELECT *, conv_id * 1000 + turn AS case_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) >= 8) AS words, CASE WHEN conv_id % 11 = 5 THEN '抱歉 ' || text ELSE text END AS answer, conv_id % 7 <> 3 AS ruled FROM conversations WHERE role = 'assistant'),
 e AS (SELECT *, list_concat(list_slice(list_filter(words, lambda w, i: list_position(words, w) = i), 1, 2), CASE WHEN conv_id % 3 = 0 THEN ['zebra'] ELSE [] END) AS expected, CASE WHEN conv_id % 5 = 0 THEN 0 WHEN conv_id % 4 = turn % 4 THEN 1 ELSE 2 END AS n FROM t),
 m AS (SELECT *, CASE WHEN ruled AND turn % 4 <> 0 THEN list_filter(expected, lambda w: NOT contains(lower(answer), w)) ELSE [] END AS missing, CASE WHEN ruled THEN list_concat(CASE WHEN regexp_matches(answer, '[0-9]{{3}}') AND NOT contains(answer, '@') THEN ['number'] ELSE [] END, CASE WHEN contains(answer, '?') THEN ['question'] ELSE [] END) ELSE [] END AS broken FROM e)"""

_SENTENCES = catalogue_text._SENT.format(t="piece")
_MERGED = "list_reduce(s, lambda a, x: CASE WHEN length(regexp_extract(a, '[^\\x03]*$')) >= 25 THEN a || chr(3) || x ELSE a || x END)"

SQL = {
    "label_carryover": f"{_STORE} SELECT * FROM next",
    "label_progress": f"{_STORE}, c AS (SELECT query_id, count_if(state <> 'vanished')::BIGINT AS candidates, count_if(state <> 'vanished' AND is_relevant IS NOT NULL)::BIGINT AS labelled, count_if(state = 'vanished')::BIGINT AS vanished FROM next GROUP BY 1) SELECT vec_id AS query_id, coalesce(candidates, 0) AS candidates, coalesce(labelled, 0) AS labelled, coalesce(vanished, 0) AS vanished, CASE WHEN vec_id % 100 = 60 THEN 'error' WHEN coalesce(candidates, 0) = coalesce(labelled, 0) THEN 'complete' ELSE 'pending' END AS status FROM embeddings LEFT JOIN c ON vec_id = query_id WHERE vec_id % 20 = 0",
    "question_selection": "SELECT doc_id AS query_id, length(text) AS chars FROM documents WHERE text <> '' AND lang = 'en' ORDER BY doc_id LIMIT 50",
    "evaluation_run": f"{_CASES} SELECT * FROM run",
    "evaluation_summary": f"{_CASES} SELECT category, count(*) AS cases, count_if(error <> '')::BIGINT AS failed, {', '.join(f'coalesce(round(avg({c}) FILTER (error = {chr(39) * 2}), 4), 0) AS {c}' for c in runs.METRICS)} FROM run GROUP BY 1",
    "case_rules": f"WITH {_TURN_RULES} SELECT case_id, concat_ws('; ', CASE WHEN len(missing) > 0 THEN 'missing:' || array_to_string(missing, ',') END, CASE WHEN regexp_matches(lower(answer), '{HARD_REFUSAL}') AND NOT regexp_matches(lower(answer), '{ADVICE}') AND NOT (ruled AND conv_id % 2 = 0) THEN 'refusal' END, CASE WHEN len(broken) > 0 THEN 'forbidden:' || array_to_string(broken, ',') END, CASE WHEN n = 0 THEN 'no sources' END, CASE WHEN n = 1 AND ruled THEN 'few sources:1' END) AS issues FROM m",
    "operational_alerts": """WITH e AS (SELECT event_id, epoch_us(ts) AS us, value * 30 AS ms, event_type = 'error' AS failed, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, value / 1000 AS cost FROM events),
 l AS (SELECT *, list_filter(list({'us': us, 'ms': ms, 'failed': failed}) OVER (ORDER BY us, event_id ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW), lambda x: x.us > us - 300000000) AS w, round(sum(cost) OVER (PARTITION BY day ORDER BY us, event_id), 6) AS day_cost FROM e),
 r AS (SELECT event_id, day, day_cost, round(len(list_filter(w, lambda x: x.failed)) / len(w)::DOUBLE, 6) AS error_rate, list_sort(list_transform(w, lambda x: x.ms))[greatest(1, ceil(len(w) * 0.95::DOUBLE))::INT] AS p95 FROM l)
 SELECT event_id, error_rate, round(p95, 6) AS p95, day, day_cost, concat_ws(',', CASE WHEN error_rate >= 0.1 THEN 'error-rate' END, CASE WHEN p95 >= 3000 THEN 'latency' END, CASE WHEN day_cost >= 5 THEN 'daily-cost' END) AS alerts FROM r""",
    "quota_balance": """WITH e AS (SELECT event_id, user_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, ts, CASE event_type WHEN 'error' THEN -1 WHEN 'signup' THEN 0 ELSE 1 END AS step FROM events),
 l AS (SELECT event_id, step, list_prepend(0, list(step) OVER (PARTITION BY user_id, day ORDER BY ts, event_id)) AS steps FROM e),
 b AS (SELECT event_id, list_reduce(steps, lambda c, x: least(2, greatest(0, c + x))) AS balance, list_reduce(steps[:-2], lambda c, x: least(2, greatest(0, c + x))) AS before FROM l)
 SELECT event_id, balance::BIGINT AS balance, (balance <> before)::INT AS ok FROM b""",
    "quota_balance_all": """WITH RECURSIVE e AS (SELECT event_id, CASE event_type WHEN 'error' THEN -1 ELSE 1 END AS step, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
 b AS (SELECT n, event_id, least(40, greatest(0, step)) AS balance, (least(40, greatest(0, step)) <> 0)::INT AS ok FROM e WHERE n = 1 UNION ALL SELECT e.n, e.event_id, least(40, greatest(0, b.balance + e.step)), (least(40, greatest(0, b.balance + e.step)) <> b.balance)::INT FROM b JOIN e ON e.n = b.n + 1)
 SELECT event_id, balance::BIGINT AS balance, ok FROM b""",
    "memory_recall": """WITH m AS (SELECT label::BIGINT AS user, vec_id AS id, embedding::DOUBLE[] AS v, lower(coalesce(substring(text, 1, 300), '')) AS content, vec_id % 13 AS accesses FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
 q AS (SELECT user, id AS query_id, v, list_filter(regexp_split_to_array(substring(content, 1, 60), '\\s+'), lambda w: length(w) > 1) AS words FROM m WHERE id % 20 = 0),
 s AS (SELECT user, query_id, id, round(0.3 * CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: contains(content, w))) / len(words)::DOUBLE ELSE 0 END + 0.7::DOUBLE * list_cosine_similarity(q.v, m.v) + 0.01 * least(accesses, 10), 6) AS score FROM q JOIN m USING (user))
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user, query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""",
    "chunked_stream": "SELECT conv_id, turn, md5(text) AS digest FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn < last",
    "merge_simulation": f"""WITH p AS (SELECT unnest(regexp_split_to_array(text, '\\n\\n+')) AS piece FROM documents), s AS (SELECT {_SENTENCES} AS s FROM p WHERE trim(piece, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
 a AS (SELECT len(s) AS before, s, string_split({_MERGED}, chr(3)) AS m FROM s WHERE len(s) > 0),
 t AS (SELECT before, CASE WHEN before <= 1 THEN s WHEN len(m) > 1 AND length(m[-1]) < 10 THEN list_append(m[:-3], m[-2] || m[-1]) ELSE m END AS m FROM a),
 n AS (SELECT length(unnest(m)) AS n FROM t), l AS (SELECT list_sort(list(n)) AS v, count(*) AS after, round(avg(n), 1) AS mean FROM n)
 SELECT (SELECT sum(before) FROM t)::BIGINT AS before, after, mean, v[1] AS shortest, v[-1] AS longest, {', '.join(f'v[least(after, floor(after * {p}::DOUBLE) + 1)::INT] AS p{round(100 * p)}' for p in (0.1, 0.25, 0.5, 0.75, 0.9))},
 len(list_filter(v, lambda x: x < 10)) AS under_10, len(list_filter(v, lambda x: x >= 10 AND x < 30)) AS under_30, len(list_filter(v, lambda x: x >= 30 AND x < 100)) AS under_100, len(list_filter(v, lambda x: x >= 100)) AS longer, (SELECT sum(before) FROM t)::BIGINT - after AS fewer, round(100.0 * ((SELECT sum(before) FROM t)::BIGINT - after) / (SELECT sum(before) FROM t), 1) AS fewer_share FROM l""",
    "keyed_fusion": f"""{_W}, h AS (SELECT 0 AS channel, query_id, id, score, rank FROM dense UNION ALL SELECT 1, query_id, id, score, rank FROM sparse),
 k AS (SELECT h.*, CASE WHEN id % 4 <> 0 THEN id::VARCHAR ELSE (id // 8) || ':' || (id % 8) END AS key, CASE WHEN id % 2 = channel THEN lang END AS title FROM h LEFT JOIN documents ON doc_id = id),
 g AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, coalesce(max(least(greatest(score * 3, 0), 1)) FILTER (channel = 0), 0) AS vector_score, coalesce(max(least(greatest(score * 3, 0), 1)) FILTER (channel = 1), 0) AS keyword_score, concat_ws(',', max('vector') FILTER (channel = 0), max('keyword') FILTER (channel = 1)) AS channels, coalesce(first(title ORDER BY channel, rank) FILTER (title IS NOT NULL), '-') AS title, min(channel * 1000 + rank) AS first FROM k GROUP BY 1, 2)
 SELECT * EXCLUDE (first) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, key) AS rank FROM g) WHERE rank <= 20""",
    "parent_contexts": f"""{_W}, r AS (SELECT query_id, id, score, substring(text, 1, 2500) AS text, concat_ws('/', source, documents.lang) AS title, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM dense JOIN documents ON doc_id = id WHERE id % 9 <> 4 AND text <> ''),
 e AS (SELECT *, '【文档 ' || place || '】' || title || '（段落 ' || (id % 5 + 1) || '）' || chr(10) || text AS entry FROM r), u AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY place) AS upto FROM e),
 f AS (SELECT *, 6000 - (upto - length(entry)) AS room, row_number() OVER (PARTITION BY query_id, upto > 6000 ORDER BY place) AS k FROM u), kept AS (SELECT query_id, place, CASE WHEN upto > 6000 THEN substring(entry, 1, room::INT) || chr(10) || '...(截断)' ELSE entry END AS entry FROM f WHERE upto <= 6000 OR (k = 1 AND room > 200))
 SELECT query_id, length(c) AS chars, md5(c) AS digest, sources FROM (SELECT query_id, string_agg(entry, chr(10) || chr(10) || repeat('=', 40) || chr(10) || chr(10) ORDER BY place) AS c, count(*) AS sources FROM kept GROUP BY 1)""",
}
_GRID = lambda pairs: f"{_W}, w(dense, sparse) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in pairs)}), f AS (SELECT w.dense, w.sparse, query_id, id, label, qlabel, 'l' || label || '-' || id AS name, round(w.dense * s + w.sparse * t, 9) AS score FROM sims CROSS JOIN w), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dense, sparse, query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 50)"
_GRID_SUMS = "count(*) AS queries, round(avg(found / wanted::DOUBLE), 6) AS recall, round(avg((found > 0)::INT), 6) AS hit_rate, round(avg(CASE WHEN first > 0 THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr, round(avg(first), 6) AS mean_first"
_SLICED = "list_transform(list_slice(string_split(substring(text, 1, 5000), chr(10)), 1, 20), lambda x: CASE WHEN length(x) > 120 THEN substring(x, 1, 120) || '...' ELSE x END)"
_MASKED = "regexp_replace(text, 'https?://\\S+', '[url]', 'g')"
SQL |= {
    "weight_grid_by_category": f"{_GRID(_PAIRS_BY_CATEGORY)}, o AS (SELECT dense, sparse, query_id, max(qlabel) % 3 AS category, 1 AS wanted, max((label = qlabel AND rank <= 5)::INT) AS found, coalesce(min(rank) FILTER (label = qlabel), 0) AS first FROM h GROUP BY 1, 2, 3) SELECT dense, sparse, category, {_GRID_SUMS} FROM o GROUP BY 1, 2, 3",
    "weight_grid_prefixes": f"{_GRID(_PAIRS_BY_PREFIX)}, q AS (SELECT *, 'l' || qlabel || '-' AS own, CASE WHEN query_id % 40 = 0 THEN 'l' || ((qlabel + 1) % 10) END AS next FROM h), o AS (SELECT dense, sparse, query_id, 1 + max((next IS NOT NULL)::INT) AS wanted, max((starts_with(name, own) AND rank <= 5)::INT) + max((coalesce(starts_with(name, next), false) AND rank <= 5)::INT) AS found, coalesce(min(rank) FILTER (starts_with(name, own) OR coalesce(starts_with(name, next), false)), 0) AS first FROM q GROUP BY 1, 2, 3) SELECT dense, sparse, {_GRID_SUMS} FROM o GROUP BY 1, 2",
    "badcase_probe": f"WITH {catalogue_eval._ANSWERED}, p AS (SELECT CASE WHEN conv_id % 2 = 1 THEN 'generation_refusal' ELSE 'pass' END AS expected, CASE WHEN conv_id % 4 = 1 THEN '资料不足。' || answer ELSE answer || ' 42' END AS answer, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn % 4 END AS n, CASE WHEN conv_id % 3 = 0 THEN substring(question, 1, 20) ELSE question END AS context FROM a), r AS (SELECT expected, CASE WHEN n = 0 THEN 'no_retrieval' WHEN regexp_matches(answer, '{REFUSAL}') THEN 'generation_refusal' ELSE 'pass' END AS actual, length(context) < 50 AND regexp_matches(answer, '{DETAIL}') AND NOT regexp_matches(answer, '{REFUSAL}') AS unsupported FROM p) SELECT expected, count(*) AS n, count_if(expected = actual)::BIGINT AS match, floor(count_if(expected = actual) / count(*)::DOUBLE * 10000 + 0.5) / 10000 AS rate, count_if(unsupported)::BIGINT AS unsupported FROM r GROUP BY 1",
    "tool_accuracy": "WITH r AS (SELECT user_id % 5 AS run, CASE WHEN event_id % 3 = 0 THEN 'rag' ELSE 'agent' END AS er, CASE WHEN event_id % 4 = 0 THEN 'rag' ELSE 'agent' END AS ro, CASE WHEN event_id % 5 > 0 THEN CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'calculate' END END AS et, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'calculate' END AS tool, CASE WHEN event_type <> 'error' THEN value END AS ms FROM events), g AS (SELECT run, count_if(et IS NOT NULL AND ms IS NOT NULL)::BIGINT AS judged, count_if(et IS NOT NULL AND er = ro AND et IS NOT DISTINCT FROM tool AND ms IS NOT NULL)::BIGINT AS correct, floor(avg(ms) + 0.5) AS mean_ms, list_sort(list(ms) FILTER (ms IS NOT NULL)) AS v FROM r GROUP BY 1) SELECT run, judged, correct, round(correct / judged::DOUBLE, 4) AS accuracy, mean_ms, v[floor(len(v) * 0.95::DOUBLE)::INT + 1] AS p95_ms FROM g",
    "feedback_search": "WITH f AS (SELECT event_id AS id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'like' END AS rating, lower(concat_ws(' ', user_id::VARCHAR, coalesce(substring(text, 1, 200), ''), coalesce(source, ''), event_type)) AS t FROM events LEFT JOIN documents ON doc_id = event_id), m AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS place, count(*) OVER () AS total, count_if(rating = 'like') OVER () AS likes FROM f WHERE rating = 'like' AND contains(t, 'sign')) SELECT id, place, total, likes::BIGINT AS likes, 0::BIGINT + count_if(rating = 'dislike') OVER () AS dislikes FROM m WHERE place > 10 AND place <= 20",
    "compact_payloads": f"SELECT doc_id, 2 AS keys, md5(CASE WHEN length({_MASKED}) > 300 THEN substring({_MASKED}, 1, 300) || '...' ELSE {_MASKED} END) AS text, 'see [url] now' AS url, len({_SLICED}) AS lines, md5(array_to_string({_SLICED}, '|')) AS words, CASE WHEN doc_id % 3 = 0 THEN '-' ELSE 't-' || doc_id END AS trace FROM documents",
    "usage_totals": """WITH u AS (SELECT CASE WHEN event_type <> 'view' THEN event_type ELSE 'unknown' END AS model, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN 5 ELSE 0 END::DOUBLE AS p, CASE event_id % 5 WHEN 0 THEN 7 WHEN 1 THEN 3 WHEN 2 THEN value ELSE 0 END::DOUBLE AS c, event_id % 5 = 1 AS told FROM events)
 SELECT model, count(*) AS calls, sum(p) AS prompt_tokens, round(sum(c), 3) AS completion_tokens, round(sum(CASE WHEN told THEN 1000 ELSE p + c END), 3) AS total_tokens, round(sum((p * 2 + c * 8) / 1000000), 4) AS cost FROM u GROUP BY 1""",
    "feedback_log": "WITH f AS (SELECT event_id, ts, 'u' || (user_id % 6) AS \"user\", CASE WHEN event_type = 'error' THEN 'dislike' ELSE 'like' END AS rating FROM events WHERE event_type IN ('purchase', 'signup', 'error')), r AS (SELECT *, (row_number() OVER (PARTITION BY \"user\" ORDER BY ts DESC, event_id DESC) <= 20)::INT AS own, (row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 20)::INT AS common FROM f) SELECT event_id, \"user\", rating, own, common FROM r WHERE own + common > 0",
    "conversation_search": "WITH t AS (SELECT conv_id, first(substring(text, 1, 20) ORDER BY turn) FILTER (role = 'user') AS title, first(text ORDER BY turn) FILTER (contains(lower(text), 'en')) AS hit FROM conversations GROUP BY 1), p AS (SELECT *, strpos(lower(hit), 'en') AS pos FROM t) SELECT conv_id, md5(CASE WHEN contains(lower(title), 'en') THEN title ELSE CASE WHEN greatest(1, pos - 10) > 1 THEN '...' ELSE '' END || substring(hit, greatest(1, pos - 10), least(length(hit), pos + 2 + 18 - 1) - greatest(1, pos - 10) + 1) || CASE WHEN pos + 19 < length(hit) THEN '...' ELSE '' END END) AS preview FROM p WHERE contains(lower(title), 'en') OR hit IS NOT NULL",
    "highlights": """WITH e AS (SELECT page_id, replace(replace(replace(replace(substring(html, 1, 400), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS e FROM pages), h AS (SELECT page_id, CASE WHEN contains(lower(e), 'div') THEN substring(e, 1, strpos(lower(e), 'div') - 1) || '<mark class="search-hit">' || substring(e, strpos(lower(e), 'div'), 3) || '</mark>' || substring(e, strpos(lower(e), 'div') + 3) ELSE e END AS h FROM e) SELECT page_id, length(h) AS chars, md5(h) AS digest FROM h""",
    "document_matches": "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src3'",
    "candidate_rows": f"{_W} SELECT query_id, rank, CASE WHEN id % 3 > 0 THEN id::VARCHAR ELSE (id // 6) || ':' || (id % 6) END AS id, id // 6 AS doc_id, CASE WHEN id % 5 > 0 THEN (id // 6) || '_para_' || (id // 3 % 2) ELSE 'p' END AS parent_id, (id // 3 % 2)::INT AS parent_idx, (id % 6)::INT AS chunk_index, '' AS title, coalesce(lang, '') AS category, score, score AS hybrid_score, '' AS rerank_model FROM dense LEFT JOIN documents ON doc_id = id",
    "parent_candidates": f"{_W}, g AS (SELECT query_id, id // 12 AS doc_id, id // 3 % 4 AS parent_idx, count(*) AS n, list_sort(list_distinct(list(id % 3 - 1) FILTER (id % 3 > 0))) AS ids, min(rank) AS first_child_rank, max(score) AS score, first(rank ORDER BY score DESC, rank) AS best_child_rank, bool_or(id % 2 = 0) AS s, string_agg(id::VARCHAR, ',' ORDER BY rank) AS children FROM dense GROUP BY 1, 2, 3) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first_child_rank) AS rank, g.doc_id || '_para_' || parent_idx AS id, coalesce(source, '') AS title, CASE WHEN g.doc_id % 2 = 0 THEN coalesce(lang, '') ELSE '' END AS category, CASE WHEN len(ids) > 0 THEN len(ids) ELSE n END AS matched, coalesce(array_to_string(ids, ','), '') AS chunk_ids, first_child_rank, best_child_rank, score, CASE WHEN s THEN 'dense,sparse' ELSE 'dense' END AS channels, children FROM g LEFT JOIN documents USING (doc_id)",
}
SQL["memory_accesses"] = SQL["memory_recall"].replace("SELECT * FROM (SELECT *, row_number()", ", r AS (SELECT *, row_number()").replace("FROM s) WHERE rank <= 5", "FROM s), h AS (SELECT user, id, count(*) AS n FROM r WHERE rank <= 5 AND score > 0.3 GROUP BY 1, 2) SELECT user, id, accesses + coalesce(n, 0) AS accesses FROM m LEFT JOIN h USING (user, id)")

QUERIES = {name: globals()[name] for name in [*SQL, "packed_trimmed"]}
