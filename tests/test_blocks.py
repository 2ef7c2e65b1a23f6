"""Search in blocks, orders over whole tables, and what is worked out on them, against plain versions."""

import math
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import blocks, hybrid, memory, operations, order, ranking, runs, search
from weftline.plans import catalogue_eval, catalogue_search
from weftline.sources import datasets
from weftline.streaming import events as streams

from tests.test_catalogue import QUERIES, SQL, plain

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


# --- search in blocks


def test_blocks_give_what_a_broadcast_gives(spark, monkeypatch):
    queries, rows = catalogue_search._tables(spark, FOLDER, scoped=True)
    sent = rows_of(search.exact_cosine(queries, rows, 7))
    asked, corpus = catalogue_eval._asked(spark, FOLDER)
    text = rows_of(hybrid.weighted(asked, corpus, 6)), rows_of(hybrid.reciprocal(asked, corpus, 6))
    for name, value in (("SENT_QUERIES", 3), ("QUERY_BLOCK", 10), ("ROW_BLOCK", 97)):
        monkeypatch.setattr(blocks, name, value)
    assert rows_of(search.exact_cosine(queries, rows, 7)) == sent
    plan = search.exact_cosine(queries, rows, 7)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan
    assert (rows_of(hybrid.weighted(asked, corpus, 6)), rows_of(hybrid.reciprocal(asked, corpus, 6))) == text
    monkeypatch.setattr(blocks, "SENT_QUERIES", 1024)
    monkeypatch.setattr(blocks, "SENT_NUMBERS", 100)
    assert rows_of(search.exact_cosine(queries, rows, 7)) == sent


def test_blocks_meet_in_any_number_of_partitions(spark, monkeypatch):
    """Partitions are not merged, as with large tables: both sides of a pair of blocks must still go to the same one."""
    queries, rows = catalogue_search._tables(spark, FOLDER, scoped=True)
    sent = rows_of(search.exact_cosine(queries, rows, 7))
    for name, value in (("SENT_QUERIES", 3), ("QUERY_BLOCK", 10), ("ROW_BLOCK", 97)):
        monkeypatch.setattr(blocks, name, value)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(search.exact_cosine(queries, rows, 7)) == sent
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["knn_cosine_topk", "knn_filtered_by_label", "filter_fallback", "doc_max_score", "distinct_sources", "reliable_queries", "reranked", "parent_sources", "retrieval_metrics", "metrics_by_group", "rerank_advice", "run_summary"])
def test_query_over_blocks_same_as_sql(spark, monkeypatch, name):
    """As at 1 GB: two blocks of queries and two of rows, and more partitions than blocks, which are not merged."""
    for setting, value in (("SENT_QUERIES", 3), ("QUERY_BLOCK", 13), ("ROW_BLOCK", 250)):
        monkeypatch.setattr(blocks, setting, value)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    theirs = duck.execute(SQL[name]).df()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        ours = QUERIES[name](spark, FOLDER).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plain(ours) == plain(theirs)


def test_best_keeps_ties_by_id():
    rng = random.Random(4)
    for _ in range(30):
        k, n = rng.randint(1, 6), rng.randint(1, 30)
        scores = [[rng.choice([0.0, 0.5, 1.0, -math.inf]) for _ in range(n)] for _ in range(3)]
        ids = rng.sample(range(1000), n)
        best = blocks.Best(3, k, 1)
        for at in range(0, n, 7):
            part = np.array([s[at : at + 7] for s in scores])
            best.add(part, np.array(ids[at : at + 7]), part * 2)
        got = list(zip(*[x.tolist() for x in best.held]))
        want = [(q, s, i, 2 * s) for q in range(3) for s, i in sorted(((s, i) for s, i in zip(scores[q], ids) if s > -math.inf), key=lambda x: (-x[0], x[1]))[:k]]
        assert got == want


def plain_reciprocal(scores, k, constant):
    out = {}
    for q in {q for q, _ in scores}:
        own = {i: s for (p, i), s in scores.items() if p == q}
        fused = {}
        for c in (0, 1):
            for place, i in enumerate(sorted((i for i in own if own[i][c] > 0), key=lambda i: (-own[i][c], i)), 1):
                fused[i] = fused.get(i, 0) + 1 / (constant + place)
        out[q] = [(i, round(s, 9)) for i, s in sorted(((i, round(s, 9)) for i, s in fused.items()), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def test_reciprocal_against_all_pairs(spark):
    """Random texts of few words, so that ties are common and lists much longer than the depth that is looked at."""
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "x", "yz"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(300)]
    corpus = hybrid.indexed(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    queries = hybrid.indexed(spark.createDataFrame([(i, " ".join(rng.choices(words, k=2))) for i in range(12)], "query_id long, text string"), "query_id", "text")
    every = hybrid._search(queries, corpus, lambda dense, sparse: [("dense", dense)], 10_000, 9)
    scores = {(r["query_id"], r["id"]): (r["dense"], r["sparse"]) for r in every.collect()}
    for k, constant in ((3, 1), (5, 10)):
        got = {}
        for r in hybrid.reciprocal(queries, corpus, k, constant).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        want = plain_reciprocal(scores, k, constant)
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
        assert all(abs(a - b) < 2e-9 for q in got for (_, a), (_, b) in zip(got[q], want[q]))


def test_reciprocal_lists_no_pairs(spark):
    """What a task returns is bounded by queries times the depth, not by the rows it has read."""
    asked, corpus = catalogue_eval._asked(spark, FOLDER)
    listed = hybrid._search(asked, corpus.repartition(3), lambda dense, sparse: [("dense", dense), ("sparse", sparse)], 5, 9)
    assert listed.groupBy("query_id", "list", F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 5
    plan = hybrid.reciprocal(asked, corpus, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "NestedLoop" not in plan


def test_search_without_queries_or_rows(spark):
    queries, rows = catalogue_search._tables(spark, FOLDER)
    assert search.exact_cosine(queries.limit(0), rows, 3).count() == 0
    assert search.exact_cosine(queries, rows.limit(0), 3).count() == 0


# --- orders


def test_numbered_and_running_sums(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(-3, 9)) for i in range(500)]
    rng.shuffle(data)
    rows = order.numbered(spark.createDataFrame(data, "i long, g string, v long").repartition(5), "i", block=16)
    got = {r["i"]: r for r in order.running_sum(rows, "g", "v", "upto").collect()}
    sums = {}
    for place, (i, g, v) in enumerate(sorted(data)):
        sums[g] = sums.get(g, 0) + v
        assert (got[i]["idx"], got[i]["block"], got[i]["upto"]) == (place, place // 16, sums[g])
    with pytest.raises(ValueError):
        order.over_blocks(rows, lambda t: t, "i long", 20, 16)


def test_sliding_requests_with_a_hot_window(spark):
    """More events in five minutes than a window takes, events at the same time, missing values; blocks smaller than the table."""
    rng = random.Random(3)
    times = sorted(rng.choice([1_700_000_000_000_000 + rng.randint(0, 400) * 1_000_000, 1_700_000_000_000_000]) for _ in range(700))
    data = [(i, t, rng.choice([None, float(rng.randint(1, 50))]) if rng.random() < 0.2 else rng.random() * 100, rng.random() < 0.3) for i, t in enumerate(times)]
    events = spark.createDataFrame(data, "id long, us long, v double, bad boolean").withColumn("ts", F.timestamp_micros("us")).repartition(4)
    for most, p, block in ((50, 0.95, 64), (2000, 0.5, 8192)):
        block_now, order.BLOCK = order.BLOCK, block
        try:
            got = {r["event_id"]: r for r in operations.sliding_requests(events, "id", "ts", "v", F.col("bad"), 60, p, most).collect()}
        finally:
            order.BLOCK = block_now
        for n, (i, t, _, _) in enumerate(data):
            window = [x for x in data[max(0, n + 1 - most) : n + 1] if x[1] > t - 60_000_000]
            values = sorted(x[2] for x in window if x[2] is not None)
            found = values[max(1, math.ceil(len(values) * p)) - 1] if values else None
            assert (got[i]["in_window"], got[i]["failed_in_window"], got[i]["p95"]) == (len(window), sum(x[3] for x in window), found)


def test_quota_balance_against_a_fold(spark, monkeypatch):
    """One key holds most rows, over many blocks; keys may be null; other actions do nothing."""
    monkeypatch.setattr(operations, "QUOTA_BLOCK", 23)
    rng = random.Random(5)
    data = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice(["d1", "d2"]) if i % 9 == 0 else "d1", rng.choice(["reserve"] * 3 + ["release"] * 2 + ["look", None])) for i in range(600)]
    log = spark.createDataFrame(data, "i long, u string, day string, action string").repartition(6)
    got = {r["i"]: (r["balance"], r["ok"]) for r in operations.quota_balance(log, ["u", "day"], "action", 4, "i").collect()}
    held = {}
    for i, u, day, action in data:
        before = held.get((u, day), 0)
        after = min(4, before + 1) if action == "reserve" else max(0, before - 1) if action == "release" else before
        held[u, day] = after
        assert got[i] == (after, int(after != before))
    assert operations.quota_balance(log.limit(0), ["u", "day"], "action", 4, "i").count() == 0


# --- evaluation runs


def test_labels_over_three_runs(spark):
    """A label outlives a run in which its pair is no candidate; the newest label counts; nothing in the store is changed."""
    empty = spark.createDataFrame([], "query_id long, parent_id long, run int, rank int, is_relevant boolean, note string, state string")
    cand = lambda *rows: spark.createDataFrame(list(rows), "query_id long, parent_id long, rank int")
    first = runs.collected(cand((1, 10, 1), (1, 11, 2), (1, 11, 5)), empty, 1)
    assert rows_of(first.select("parent_id", "rank", "state")) == [(10, 1, "new"), (11, 2, "new")]
    store = first.withColumn("is_relevant", F.col("parent_id") == 10).withColumn("note", F.lit("by hand"))
    second = runs.collected(cand((1, 11, 1), (1, 12, 2)), store, 2)
    assert sorted((r["parent_id"], r["rank"], r["is_relevant"], r["note"], r["state"]) for r in second.collect()) == [(10, None, True, "by hand", "vanished"), (11, 1, False, "by hand", "kept"), (12, 2, None, "", "new")]
    store = store.unionByName(second.withColumn("is_relevant", F.when(F.col("parent_id") == 11, True).otherwise(F.col("is_relevant"))))
    third = {r["parent_id"]: r for r in runs.collected(cand((1, 10, 3), (1, 11, 1)), store, 3).collect()}
    assert (third[10]["is_relevant"], third[10]["state"], third[11]["is_relevant"]) == (True, "kept", True) and 12 not in third
    status = runs.label_status(spark.createDataFrame([(1,), (2,), (3,)], "query_id long"), second, spark.createDataFrame([(3,)], "query_id long"))
    assert rows_of(status) == [(1, 2, 1, 1, "pending"), (2, 0, 0, 0, "complete"), (3, 0, 0, 0, "error")]


def test_one_failing_row_costs_no_other_its_reply(spark):
    def answer(rows):
        if (rows["x"] == 13).any():
            raise RuntimeError("thirteen")
        return rows["x"] * 2

    out = spark.range(40).select("id", runs.guarded(answer, F.col("id").alias("x"), F.lit(1).alias("y")).alias("r")).collect()
    assert [(r["r"]["reply"], r["r"]["error"]) for r in out] == [(None, "thirteen") if i == 13 else (str(2 * i), None) for i in range(40)]
    short = spark.range(3).select(runs.guarded(lambda rows: rows["x"][:1], F.col("id").alias("x"), F.lit(1).alias("y")).alias("r")).collect()
    assert {r["r"]["reply"] for r in short} == {"0", "1", "2"}  # a batch with too few replies is halved like one that raises


def test_failed_case_has_no_measures(spark):
    cases = spark.createDataFrame([(1, "what is lime", "c", None, "lime stone"), (2, "boom", None, "hard", "x"), (3, None, None, None, None)], "id long, question string, category string, difficulty string, ground_truth string")
    contexts = spark.createDataFrame([(1, 2, "b", "stone"), (1, 1, "a", "lime is rock"), (2, 1, "z", "x")], "id long, place int, name string, text string")

    def answer(rows):
        if (rows["question"] == "boom").any():
            raise ValueError("no model")
        return rows["context"]

    got = {r["id"]: r for r in runs.evaluated_cases(cases, contexts, answer).collect()}
    assert (got[1]["answer"], got[1]["contexts"], got[1]["difficulty"], got[1]["context_recall"], got[1]["error"]) == ("lime is rock\nstone", ["a", "b"], "medium", 1.0, None)
    assert (got[2]["answer"], got[2]["contexts"], got[2]["category"], got[2]["overall"], got[2]["error"]) == ("[错误: no model]", [], "general", 0.0, "no model")
    assert (got[3]["answer"], got[3]["overall"]) == ("", 0.0)
    summary = {r["category"]: r for r in runs.run_summary(runs.evaluated_cases(cases, contexts, answer)).collect()}
    assert (summary["general"]["cases"], summary["general"]["failed"]) == (2, 1)


def test_case_issues(spark):
    rule = lambda n, p, u=None: (n, p, u)
    rules = spark.createDataFrame(
        [(1, ["Lime", "stone"], [rule("year", r"\d{4}年", "site"), rule("hours", "24小时")], False, 2), (2, None, None, True, None)],
        "case_id long, expected array<string>, forbidden array<struct<name: string, pattern: string, unless: string>>, may_refuse boolean, least_sources int",
    )
    answers = spark.createDataFrame([(1, "LIME in 2024年, 24小时", ["a", "a"]), (1, "lime stone 2024年 see site", ["a", "b"]), (2, "抱歉", ["a"]), (3, "抱歉", None), (3, "抱歉，建议咨询", ["a"]), (3, None, [])], "case_id long, answer string, sources array<string>")
    got = sorted((r["case_id"], r["issues"]) for r in runs.case_issues(rules, answers).collect())
    assert got == sorted([(1, ["missing:stone", "forbidden:year,hours", "few sources:1"]), (1, []), (2, []), (3, ["refusal", "no sources"]), (3, []), (3, ["no sources"])])


# --- memories


def test_recalled_blocks_of_one_user(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(1 if i % 5 else 2, i, rng.choice(["red apple", "Green pear", "blue", None]), None if i % 17 == 3 else [float(x) for x in rng.normal(size=4)], int(i % 14)) for i in range(300)]
    memories = spark.createDataFrame([*rows, (None, 999, "x", [0.0] * 4, 1)], "user long, id long, content string, vector array<double>, accesses long")
    queries = spark.createDataFrame([(u, q, w, [float(x) for x in rng.normal(size=4)]) for q, (u, w) in enumerate([(1, "red pear a"), (2, "blue"), (1, ""), (3, "red")] * 4)], "user long, query_id long, query string, vector array<double>")
    whole = rows_of(memory.recalled(memories, queries, 6))
    monkeypatch.setattr(memory, "RECALL_BLOCK", 5)
    assert rows_of(memory.recalled(memories, queries, 6)) == whole
    want = []
    for u, q, text, v in ((r["user"], r["query_id"], r["query"], np.array(r["vector"])) for r in queries.collect()):
        words = [w for w in text.lower().split() if len(w) > 1]
        scored = []
        for user, i, content, x, n in rows:
            if user == u:
                share = sum(w in (content or "").lower() for w in words) / len(words) if words else 0
                cosine = float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)) if x is not None else 0.0
                scored.append((round(0.3 * share + 0.7 * cosine + 0.01 * min(n, 10), 9), i))
        want += [(u, q, i, s, place) for place, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:6], 1)]
    assert [x[:3] for x in whole] == [x[:3] for x in sorted(want)]
    assert all(abs(a[3] - b[3]) < 2e-9 for a, b in zip(whole, sorted(want)))


def test_remembered_stream_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(6)
    words = ["likes tea", "likes tea a lot", "LIKES TEA", "lives in Rome", "lives in Rome since May", "has a cat", "runs", "runs fast", "x", "xy"]
    log = [(rng.choice(["u", "u", "u", "v", None]), i, rng.choice([*words, "", None])) for i in range(240)]
    for part in range(4):
        spark.createDataFrame(log[part * 60 : part * 60 + 60], "user string, seq long, content string").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema("user string, seq long, content string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        told = []
        stream = memory.remembered_stream(source, "user", "seq", "content", 4)
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: told.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    newest = {}
    for user, as_of, *_ in told:
        newest[user] = max(newest.get(user, -1), as_of)
    got = sorted((x[0], *x[2:]) for x in told if x[1] == newest[x[0]])
    want = rows_of(memory.remembered(spark.createDataFrame(log, "user string, seq long, content string"), "user", "seq", "content", 4))
    assert len({x[1] for x in told}) >= 4
    assert got == want


# --- streams and sinks


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_chunks_cut_anywhere(spark, size):
    logs = {"a": 'data: {"t": "é\U0001f600"}\r\n\r\n: ping\ndata:{"t": 2}\n\ndata: {broken\ndata: [DONE]\ndata: {"t": 3}\n', "b": 'data: {"t": "no end"}', "c": "", "d": "\n\n\ndata: 7\n"}
    chunks = [(k, i // size, bytearray(v.encode()[i : i + size])) for k, v in logs.items() for i in range(0, len(v.encode()), size)]
    random.Random(1).shuffle(chunks)
    df = spark.createDataFrame([*chunks, (None, 0, bytearray(b"data: 1\n")), ("c", 0, None)], "stream string, seq long, data binary").repartition(3)
    lines = streams.joined_lines(df, "stream", "seq", "data")
    want = [(k, n, line.removesuffix("\r")) for k, v in logs.items() for n, line in enumerate(v.split("\n")) if line]
    assert rows_of(lines) == sorted(want)
    found = streams.stream_payloads(lines).select("stream", "line", F.to_json("payload").alias("p"))
    assert rows_of(found) == [("a", 0, '{"t":"é\U0001f600"}'), ("a", 3, '{"t":2}'), ("b", 0, '{"t":"no end"}'), ("d", 3, "7")]


def test_vector_sink_is_the_same_after_a_replay(spark, tmp_path):
    write = datasets.vector_sink(str(tmp_path))
    batch = lambda *rows: spark.createDataFrame(list(rows), "id long, vector array<double>, text string")
    write(batch((1, [1.0], "a"), (2, None, "b"), (3, [], "c")), 0)
    write(batch((1, [2.0], "d"), (4, [1.0], "e")), 1)
    once = rows_of(datasets.vector_rows(spark, str(tmp_path), ["id"]))
    write(batch((1, [1.0], "a"), (2, None, "b"), (3, [], "c")), 0)
    write(batch((1, [2.0], "d"), (4, [1.0], "e")), 1)
    assert rows_of(datasets.vector_rows(spark, str(tmp_path), ["id"])) == once == [(1, [2.0], "d"), (4, [1.0], "e")]


# --- lists of things found, contexts


def test_keyed_fusion_of_odd_rows(spark):
    schema = "query_id long, id string, doc_id long, chunk_index long, score double, rank int, title string"
    a = spark.createDataFrame([(1, "x", 1, 0, 1.7, 1, ""), (1, "", 5, 2, 0.4, 2, None), (1, "x", 1, 0, 0.2, 3, "later")], schema)
    b = spark.createDataFrame([(1, None, 5, 2, -3.0, 1, "five"), (2, "y", 9, 9, 0.5, 1, "nine")], schema)
    got = {(r["query_id"], r["key"]): r for r in search.fuse_keyed(a, b, 10, constant=10).collect()}
    assert (got[1, "x"]["score"], got[1, "x"]["vector_score"], got[1, "x"]["keyword_score"], got[1, "x"]["title"], got[1, "x"]["channels"], got[1, "x"]["rank"]) == (round(1 / 11 + 1 / 13, 9), 1.0, 0.0, "later", "vector", 2)
    assert (got[1, "5:2"]["score"], got[1, "5:2"]["keyword_score"], got[1, "5:2"]["title"], got[1, "5:2"]["channels"], got[1, "5:2"]["rank"]) == (round(1 / 12 + 1 / 11, 9), 0.0, "five", "vector,keyword", 1)
    assert got[2, "y"]["rank"] == 1 and len(got) == 3


def test_context_entries(spark):
    parents = spark.createDataFrame([(1, 1, None, 0.5, "a" * 100), (1, 2, 3, 0.9, "b" * 50), (1, 3, 0, 0.8, ""), (1, 4, 0, 0.7, "no document"), (1, 5, 0, 0.1, "c" * 400), (1, 1, 7, 0.05, "d")], "query_id long, doc_id long, parent_idx int, score double, text string")
    docs = spark.createDataFrame([(1, "one"), (2, None), (3, "three"), (5, "five")], "doc_id long, title string")
    rows = {r["place"]: r for r in ranking.context_entries(parents, docs, 500).collect()}
    assert rows[1]["entry"] == "【文档 1】（段落 4）\n" + "b" * 50 and rows[2]["entry"].startswith("【文档 2】one（段落 1）\na")
    left = 500 - len(rows[1]["entry"]) - len(rows[2]["entry"])
    assert rows[3]["partial"] and rows[3]["entry"] == ("【文档 3】five（段落 1）\n" + "c" * 400)[:left] + "\n...(截断)"
    assert set(rows) == {1, 2, 3}
    text = ranking.contexts(ranking.context_entries(parents, docs, 500)).first()
    assert text["sources"] == 3 and text["context"].count("=" * 40) == 2


# --- n-grams of texts


def gram_sums(texts, grams):
    """Sums of weights by entry of the n-grams of several texts; ``grams``: length, mark, weight."""

    def hashed(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h)

    out = {}
    for t in (x.strip(" ").lower() for x in texts):
        for n, mark, weight, size in grams:
            for i in range(len(t) - n + 1):
                entry = hashed(mark + t[i : i + n]) % size
                out[entry] = out.get(entry, 0) + weight
    return out


def test_indexed_counts_a_keys_rows_together(spark):
    """Keys whose rows go on over several batches, characters beyond 16 bits, empty and null texts: one row a key, summed, as SQL groups by it."""
    rng = random.Random(6)
    texts = [(rng.choice([1, 1, 1, 2, 3, 4, None]), "".join(rng.choices("aB c\U0001f600é离", k=rng.randint(0, 30)))) for _ in range(60)] + [(5, ""), (6, None), (7, "x"), (8, " Ab ")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(4)
    dense, sparse = [(1, "", 0.5, 512), (2, "", 1.0, 512), (3, "", 1.5, 512)], [(2, "b:", 1, 0xFFFFFE), (3, "t:", 1, 0xFFFFFE)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = hybrid.indexed(df, "id", "text").collect()
        terms, slots = hybrid.sparse_terms(df, "id", "text").collect(), hybrid.dense_slots(df, "id", "text").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = {k for k, _ in texts}
    assert sorted(map(str, (r["id"] for r in rows))) == sorted(map(str, keys))
    for r in rows:
        own = [t or "" for k, t in texts if k == r["id"]]
        assert dict(zip(r["slots"], r["weights"])) == gram_sums(own, dense)
        assert dict(zip(r["terms"], r["tfs"])) == gram_sums(own, sparse)
        assert {x["term"]: x["tf"] for x in terms if x["id"] == r["id"]} == gram_sums(own, sparse)
        mine = [x for x in slots if x["id"] == r["id"]]
        assert {x["slot"]: x["weight"] for x in mine} == gram_sums(own, dense)
        assert all(x["norm"] == pytest.approx(math.sqrt(sum(v * v for v in gram_sums(own, dense).values()))) for x in mine)


def test_indexed_is_linear_in_a_text(spark):
    df = spark.createDataFrame([(1, " Ab" * 50_000)], "id long, text string")
    began = time.monotonic()
    assert hybrid.sparse_terms(df, "id", "text").count() == 6
    assert time.monotonic() - began < 15
