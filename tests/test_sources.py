"""Data sets, sinks, percentiles and small expressions, by fixed examples and brute force."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftline.functions import rules
from weftline.operators import evaluation, operations, ranking, search
from weftline.sources import datasets, documents


@pytest.mark.parametrize("body", ['[{"id": 1}, {"id": 2}]', '{"meta": 1, "samples": [{"id": 1}, {"id": 2}]}', '{"data": [{"id": 1}, {"id": 2}]}', '{"id": 1}\n\n{"id": 2}\n'])
def test_samples(spark, tmp_path, body):
    (tmp_path / "x.json").write_text(body)
    assert [r.id for r in datasets.read_samples(spark, str(tmp_path / "x.json"), "id: int").orderBy("id").collect()] == [1, 2]


def test_titled_texts(spark):
    df = spark.createDataFrame([("Head\nbody\n\n \n\nOther " + "x" * 50,)], "value string")
    assert [(r.title, r.text[:5]) for r in datasets.titled_texts(df).orderBy("pos").collect()] == [("Head", "Head\n"), ("Other " + "x" * 34, "Other")]


def test_normalised_samples(spark):
    df = spark.createDataFrame([("q", "a", ["c", " "], "t"), (" ", None, [], None)], "user_input string, response string, retrieved_contexts array<string>, reference string")
    good, bad = datasets.normalised_samples(df).collect()
    assert (good.question, good.answer, good.contexts, good.ground_truth, good.valid) == ("q", "a", ["c"], "t", True)
    assert bad.reasons == "no question; no answer; no contexts" and not bad.valid


def test_upsert_and_synchronised(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, datasets.upsert(now, changes, ["k"]).collect())) == [(1, "a"), (2, "y"), (3, "z")]
    kept = datasets.synchronised(now, spark.createDataFrame([(2, "n"), (5, "m")], "k int, v string"), spark.createDataFrame([(2,), (5,)], "k int"), "k")
    assert sorted(map(tuple, kept.collect())) == [(2, "n"), (5, "m")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc|d'), (2, None)], "k int, v string")
    datasets.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert (tmp_path / "csv").glob("*.csv").__next__().read_text().splitlines() == ['"k","v"', '"1","a ""b"" c|d"', '"2",""']
    datasets.append_jsonl(df, str(tmp_path / "lines"))
    datasets.append_jsonl(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 4
    datasets.write_snapshot(df, str(tmp_path / "snap"), "k")
    assert spark.read.parquet(str(tmp_path / "snap")).where("k = 1").count() == 1
    assert [r.line for r in datasets.markdown_rows(df, "k", "v").collect()] == ['| 1 | a "b"\nc\\|d |', "| 2 | - |"]
    turns = spark.createDataFrame([("user", "a<b"), ("welcome", "hi"), ("assistant", " ")], "role string, text string")
    assert [r.line for r in datasets.conversation_lines(turns, F.col("text"), F.col("role"), "html").collect()] == ["<p><b>User</b> a&lt;b</p>"]


def test_labels_and_scores(spark):
    row = spark.range(1).select(evaluation.valid_ids(F.array(F.lit("a"), F.lit(" "), F.lit("todo: x"))).alias("ids"), *[evaluation.label_value(F.lit(x)).alias(f"l{i}") for i, x in enumerate(("Yes", " irrelevant ", "maybe"))], *[evaluation.judge_score(F.lit(x)).alias(f"s{i}") for i, x in enumerate(('So: {"score": 0.4}', '```json\n{"score": 85}\n```', "about 85", '{"score": "0.9"}', '{"score": -3}', None))], evaluation.coverage(F.lit("Alpha b"), F.array(F.lit("alpha"), F.lit("z"))).alias("c")).first()
    assert row == Row(ids=["a"], l0=True, l1=False, l2=None, s0=0.4, s1=0.85, s2=0.0, s3=0.0, s4=0.0, s5=0.0, c=0.5)


def test_reliable_rewrite_sources(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, 1), (2, 1, 0.01, 1)], "query_id int, id int, score double, rank int")
    assert dict(map(tuple, search.reliable(hits).collect())) == {1: True, 2: False}
    asked = spark.createDataFrame([("那个呢", True), ("那个呢", False), ("a long and complete question", True)], "q string, had boolean")
    assert [r[0] for r in asked.select(rules.needs_rewrite(F.col("q"), F.col("had"))).collect()] == [True, False, False]
    rows = spark.createDataFrame([(1, 7, "a", 2), (1, 7, "b", 1), (1, None, "t", 3), (1, None, "t", 4), (1, None, None, 5)], "query_id int, doc_id int, title string, rank int")
    assert sorted(r.rank for r in ranking.distinct_sources(rows).collect()) == [1, 3, 5]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, i, 1.0 / i, i, "a b", t) for i, t in enumerate(("x", "a", "a b"), 1)] + [(2, 9, 0.3, 1, "q", "z")], "query_id int, id int, score double, rank int, query string, text string")
    got = ranking.rerank(hits, ranking.overlap_scorer(F.col("query"), F.col("text")), 2).collect()
    assert sorted((r.query_id, r.new_rank, r.id) for r in got) == [(1, 1, 3), (1, 2, 2), (2, 1, 9)]
    assert next(r.rerank_score for r in got if r.query_id == 2) == 0.3


def test_traces(spark):
    rows = [("t", False, [("a", 5.0, True, None), ("total", 9.0, True, None)]), ("u", True, [("a", 1.0, True, None)]), ("v", True, [("a", 1.0, False, "x")])]
    df = spark.createDataFrame(rows, "trace_id string, fallback boolean, stages array<struct<name string, duration_ms double, success boolean, error string>>")
    assert [(r.status, r.total_ms) for r in operations.trace_summary(df).orderBy("trace_id").collect()] == [("ok", 5.0), ("fallback", 1.0), ("error", 1.0)]


def test_percentiles_against_sorted_lists(spark):
    draw = random.Random(3)
    groups = {"many": [draw.lognormvariate(0, 3) for _ in range(3000)], "few": [1.0, 2.0], "same": [5.0] * 500, None: [draw.randrange(9) * 1.0 for _ in range(200)], "skew": [0.0] * 900 + [draw.random() for _ in range(101)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("few", None), ("none", None)], "g string, v double")
    got = {r.g: r for r in operations.percentiles(df, "g", "v", {"p50": operations.nearest_rank(50), "p99": operations.nearest_rank(99), "f95": operations.floor_index(0.95)}).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = sorted(vs)
        assert (got[g].p50, got[g].p99, got[g].f95) == (s[math.ceil(len(s) / 2) - 1], s[-(-len(s) * 99 // 100) - 1], s[math.floor(len(s) * 0.95)])
    summary = {r.g: r for r in operations.latency_summary(df, "g", "v").collect()}
    assert summary["none"].n == 1 and summary["none"].p50 is None and summary[None].n == 200


def test_scanned_pages_and_page_choice(spark):
    df = spark.createDataFrame([("  short ", "a\fb\fc", {1: "B", 2: " "}, [3, 1, 3, 9, 0]), (None, "x", {}, []), ("y" * 40, "", None, None)], "t string, pages string, new map<int,string>, asked array<int>")
    # Places in the map count from 0.
    rows = df.select(documents.needs_ocr(F.col("t")).alias("ocr"), documents.pages_replaced(F.col("pages"), F.col("new")).alias("pages"), documents.page_choice(F.col("asked"), F.lit(3)).alias("choice")).collect()
    assert [r["ocr"] for r in rows] == [True, True, False]
    assert [r["pages"] for r in rows[:2]] == ["a\fB\fc", "x"]
    assert [r["choice"] for r in rows] == [[1, 3], [], None]


def test_uploads_and_images(spark):
    df = spark.createDataFrame([("a/b.TXT", "text/plain", 10), ("a.txt", "image/png", 10), ("a.pdf", "application/pdf", 1 << 40), ("noext", "text/plain", 1)], "path string, kind string, size long")
    assert [r[0] for r in df.select(documents.allowed(F.col("path"), F.col("kind"), F.col("size"))).collect()] == [True, False, False, False]
    uri = spark.createDataFrame([("data:image/JPEG;base64,aGk=",), ("data:image/svg+xml;base64,aGk=",), ("http://x",), (None,)], "t string").select(documents.data_uri(F.col("t")).alias("u")).collect()
    assert [(r["u"]["ext"], bytes(r["u"]["data"])) if r["u"] else None for r in uri] == [("jpg", b"hi"), ("svg", b"hi"), None, None]


def test_categories_from_paths(spark):
    df = spark.createDataFrame([("/x/Exam/a.md",), ("/x/other.md",)], "path string")
    assert [r["category"] for r in documents.with_category(df, [("exams", "exam"), ("rest", "zzz")]).collect()] == ["exams", "general"]


def test_payloads_for_logs(spark):
    df = spark.createDataFrame([({"Token": "x", "a": "see http://h/p?q now", "b": "y" * 400}, ["z" * 200] * 30, " ab-1:2.3_ ")], "p map<string,string>, l array<string>, t string")
    row = df.select(operations.redacted(F.col("p")).alias("p"), operations.redacted_list(F.col("l")).alias("l"), operations.trace_id(F.col("t")).alias("t"), operations.trace_id(F.lit("a b")).alias("bad"), operations.trace_id(F.lit("x" * 129)).alias("long"), operations.trace_id(F.lit(" ")).alias("none")).first()
    assert row["p"] == {"a": "see [url] now", "b": "y" * 300 + "..."} and row["l"] == ["z" * 120 + "..."] * 20
    assert (row["t"], row["bad"], row["long"], row["none"]) == ("ab-1:2.3_", None, None, None)


def test_feedback_pages(spark):
    rows = spark.createDataFrame([(i, i // 2, "like" if i % 3 else "dislike", f"Word{i % 4}", ["T"] if i % 5 else None) for i in range(40)], "id long, created long, rating string, text string, titles array<string>")
    page = lambda **o: operations.feedback_page(rows, ["text"], "titles", **o).orderBy("place").collect()
    want = sorted((i for i in range(40) if i % 3 and i % 4 == 1), key=lambda i: (-(i // 2), -i))
    assert [r["id"] for r in page(rating="like", keyword=" wORD1 ", page=2, size=3)] == want[3:6]
    got = page(keyword="word1", size=0)
    assert len(got) == 1 and (got[0]["total"], got[0]["likes"], got[0]["dislikes"]) == (10, sum(i % 3 > 0 for i in range(40) if i % 4 == 1), sum(i % 3 == 0 for i in range(40) if i % 4 == 1))
    assert page(page=9) == []
