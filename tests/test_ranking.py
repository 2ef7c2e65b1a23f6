"""Cut-offs, fusion, diversity and budgets on cases worked out by hand."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import evaluation, operations, ranking, search, state


def hits(spark, scores):
    return spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], "query_id long, id long, score double")


@pytest.mark.parametrize(
    ("scores", "options", "kept"),
    [
        ([0.95, 0.90, 0.42, 0.40, 0.38], {"cap": 10}, [0.95, 0.90, 0.42]),
        ([0.70, 0.66, 0.62, 0.20, 0.10], {}, [0.70, 0.66, 0.62]),
        ([0.90, 0.85, 0.10], {"cap": 1}, [0.90, 0.85]),
        ([0.40, 0.95, 0.60], {}, [0.95, 0.60]),
        ([0.70, 0.55, 0.50, 0.20], {"floor": 0.6}, [0.70]),
        ([0.60, 0.58, 0.55], {}, [0.60, 0.58, 0.55]),
        ([0.60, 0.58, 0.55], {"drop": 0.01}, [0.60, 0.58]),
        ([0.1], {}, [0.1]),
    ],
)
def test_adaptive_cut(spark, scores, options, kept):
    got = ranking.adaptive_cut(hits(spark, scores), **options).orderBy("kept_rank").collect()
    assert [r["score"] for r in got] == kept


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2)], "query_id long, id long, score double, rank int")
    b = spark.createDataFrame([(1, 2, 0.7, 1)], "query_id long, id long, score double, rank int")
    got = {r["id"]: (r["score"], r["channels"]) for r in search.fuse_reciprocal(a, b, 5).collect()}
    assert got[2] == (pytest.approx(1 / 61 + 1 / 62, abs=1e-8), "dense,sparse")
    assert got[1][0] == pytest.approx(1 / 61, abs=1e-8)
    first = search.fuse_weighted(a, b, 5).where("rank = 1").first()
    assert (first["id"], first["score"]) == (2, pytest.approx(0.76))


def test_diverse(spark):
    rows = [(1, 1, 1, 0.9, "the quick brown fox"), (1, 1, 2, 0.89, "the quick brown fox"), (1, 2, 3, 0.88, "the quick brown fox"), (1, 1, 4, 0.5, "something else entirely")]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, id long, score double, text string")
    assert [r["id"] for r in ranking.diverse(df).orderBy("pick").collect()] == [1, 3, 4]
    assert [r["id"] for r in ranking.diverse(df, keep=2).orderBy("pick").collect()] == [1, 3]
    assert ranking.diverse(df, most=1.01).count() == 4


def test_parents_and_budget(spark):
    rows = [(1, "p", 1, 1, 0.5, "a"), (1, "p", 2, 2, 0.5, "aaa"), (1, "q", 3, 3, 0.9, "b")]
    df = spark.createDataFrame(rows, "query_id long, parent_id string, id long, rank int, score double, parent_text string")
    got = {r["parent_id"]: r for r in ranking.to_parents(df).collect()}
    assert (got["p"]["best_id"], got["p"]["parent_text"], got["p"]["children"], got["p"]["first_rank"]) == (1, "aaa", [1, 2], 1)
    assert [r["parent_id"] for r in ranking.top_parents(ranking.to_parents(df)).orderBy("rank").collect()] == ["q", "p"]


def test_metrics(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 11, 3), (2, 99, 1)], "query_id long, doc_id long, rank int")
    wanted = spark.createDataFrame([(1, 11), (2, 5), (3, 7)], "query_id long, doc_id long")
    m = evaluation.query_metrics(found, wanted)
    got = {r["query_id"]: r for r in m.collect()}
    assert (got[1]["first_rank"], got[1]["rr"], got[1]["precision"], got[1]["recall_at_1"]) == (2, 0.5, 0.5, 0.0)
    assert got[3]["retrieved"] == 0 and got[3]["recall"] == 0
    kinds = {r["query_id"]: r["k"] for r in m.select("query_id", evaluation.bad_case(m).alias("k")).collect()}
    assert kinds == {1: "pass", 2: "recall_miss", 3: "no_retrieval"}


def test_state(spark):
    rows = spark.createDataFrame([("a", i, "u", "x" * 10) for i in range(1, 8)], "c string, t int, r string, s string")
    assert state.history_within(rows, "c", "t", "s", 12, 2000, 35).count() == 3
    assert state.history_within(rows, "c", "t", "s", 12, 2000, 5).count() == 1
    assert [r["t"] for r in state.list_range(rows, ["c"], -3, -2, *[rows.t]).orderBy("t").collect()] == [5, 6]


def test_day_in_zone(spark):
    rows = spark.sql("SELECT timestamp'2026-08-18 15:59:00' AS ts, 1.0 AS v UNION ALL SELECT timestamp'2026-08-18 16:01:00', 0.5")
    got = {r["d"]: r["v"] for r in rows.groupBy(operations.local_day(rows.ts, "Asia/Shanghai").alias("d")).agg({"v": "sum"}).withColumnRenamed("sum(v)", "v").collect()}
    assert got == {"2026-08-18": pytest.approx(1.0), "2026-08-19": pytest.approx(0.5)}


def test_sliding_errors_of_events_at_one_time(spark):
    """Against a count over all pairs, and in time linear in what a window holds: old code added up each window anew."""
    width = 300_000_000
    times = sorted(random.Random(8).choice([0, 1, width - 1, width, width + 1, 2 * width - 1, 2 * width, 3 * width + 5, -1, -width]) for _ in range(80))
    rows = [(i, t, "error" if i % 3 == 0 else "view") for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, us long, event_type string").select("event_id", F.timestamp_micros("us").alias("ts"), "event_type")
    got = {r["event_id"]: (r["in_window"], r["failed_in_window"]) for r in operations.sliding_errors(df, "ts", F.col("event_type") == "error").collect()}
    assert got == {i: (sum(t - width < u <= t for _, u, _ in rows), sum(t - width < u <= t and e == "error" for _, u, e in rows)) for i, t, _ in rows}
    many = spark.range(150_000).select(F.timestamp_micros(F.col("id") * 1000).alias("ts"), (F.col("id") % 2 == 0).alias("failed"))
    began = time.monotonic()
    assert operations.sliding_errors(many, "ts", F.col("failed")).agg(F.max("in_window")).first()[0] == 150_000
    assert time.monotonic() - began < 20
