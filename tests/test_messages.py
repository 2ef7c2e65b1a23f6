"""Messages, replies, memories and tool calls: fixed examples, and brute force where there is no SQL."""

import math
import random

from pyspark.sql import functions as F

from weftline.functions import messages
from weftline.operators import memory, ranking, state
from weftline.plans import catalogue_dialogue, retrieval


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_procedure_card(spark):
    replies = [
        ('```json\n{"summary":"s","steps":[{"title":" a ","detail":"b"},{"title":"","detail":""}],"materials":["x",""," "]}\n```',),
        ('Here {"location":"hall","notes":""} ok',), ('{"summary":"only"}',), ("{ broken",), ("none",), (None,),
    ]
    got = [r[0] for r in values(spark, replies, "r string", messages.procedure_card(F.col("r")))]
    assert [(s.title, s.detail) for s in got[0].steps] == [("a", "b")] and got[0].materials == ["x"] and got[0].summary == "s"
    assert got[1].location == "hall" and got[1].notes is None and got[1].steps == []
    assert got[2:] == [None] * 4


def test_reply_intent(spark):
    fallback = F.struct(F.lit("general_chat").alias("intent"), F.lit("chat").alias("route"), F.lit(0.3).alias("confidence"))
    replies = [('x {"intent":"calculation_task","confidence":0.9}',), ('{"intent":"other"}',), ('{"intent":"complex_task","confidence":0}',), ("{bad}",), ("",), (None,)]
    got = [tuple(r[0]) for r in values(spark, replies, "r string", messages.reply_intent(F.col("r"), fallback))]
    assert got == [("calculation_task", "agent", 0.9), ("general_chat", "chat", 0.5), ("complex_task", "agent", 0.5)] + [("general_chat", "chat", 0.3)] * 3


def test_profile_and_rewrites(spark):
    (facts,) = values(spark, [("我叫王小明，我在计算机学院 专业是软件工程 学号 202400001234",)], "m string", messages.profile_facts(F.col("m")))
    assert {f.field: f.value for f in facts[0]} == {"name": "王小明", "studentId": "202400001234", "college": "，我在计算机学院", "major": "软件工程"}
    rows = [("q", '"better question"'), ("same", " same "), ("q", "x"), ("q", None)]
    assert [r[0] for r in values(spark, rows, "q string, r string", messages.accepted_rewrite(F.col("q"), F.col("r")))] == ["better question", None, None, None]
    turns = [{"role": "user", "content": "a" * 120}, {"role": "assistant", "content": None}]
    keys = values(spark, [(" Q ", turns), ("Q", [])], "q string, h array<struct<role string, content string>>", messages.rewrite_key(F.col("q"), F.col("h")))
    assert keys == [("q|user:" + "a" * 100 + "|assistant:",), (None,)]


def test_memories_from_a_turn(spark):
    answer = "这里是考试安排的说明" * 4
    rows = [("我喜欢短的", answer), ("什么", answer), ("我喜欢", "short"), ("", answer), (None, None)]
    got = [[m.type for m in r[0]] for r in values(spark, rows, "m string, a string", messages.memories(F.col("m"), F.col("a")))]
    assert got == [["qa", "preference"], ["qa"], ["preference"], [], []]


def test_calculate(spark):
    cases = {"2+3*4": 14.0, "sqrt(16)": 4.0, "2^10": 1024.0, "-(1-3)/4": 0.5, "sin(pi/2)": 1.0, "9^9^9^9": None, "1/0": None, "(-8)^0.5": None, "__import__('os')": None, "a.b": None, "": None, "1" * 201: None}
    got = dict(values(spark, [(c,) for c in [*cases, None]], "e string", "e", messages.calculate(F.col("e"))))
    assert got.pop(None) is None
    for expression, wanted in cases.items():
        assert (got[expression] is None) if wanted is None else math.isclose(got[expression], wanted), expression


def test_remembered_against_brute_force(spark):
    draw = random.Random(5)
    words = ["Tea", "tea", "tea at", "green tea", "coffee", "black coffee", "black coffe", "milk", "milk and more of it"]
    log = [(draw.randrange(3), i, draw.choice(words) + draw.choice(["", "", " x"])) for i in range(300)] + [(None, 999, "tea"), (1, 1000, None), (1, 1001, "")]
    wanted = {}
    for user in range(3):
        held = []
        for _, at, text in [r for r in log if r[0] == user and r[2]]:
            low = text.lower()
            near = [h for h in held if h[2].lower() == low] or [h for h in held if (low in h[2].lower() or h[2].lower() in low) and abs(len(h[2]) - len(low)) < len(low) / 2]
            if near:
                near[0][1], near[0][3] = at, near[0][3] + 1
            else:
                held.append([at, at, text, 0])
                held = held[-4:]
        wanted[user] = [tuple(h) for h in held]
    df = spark.createDataFrame(log, "user long, seq long, content string").repartition(5)
    got = memory.remembered(df, "user", "seq", "content", most=4).orderBy("first_seq").collect()
    assert {u: [tuple(r)[1:] for r in got if r.user == u] for u in range(3)} == wanted
    assert memory.remembered(df.where("false"), "user", "seq", "content").count() == 0


def test_tool_calls(spark):
    parts = [("s", 1, 0, "a", "search", '{"q":'), ("s", 2, 1, "b", "", "{}"), ("s", 3, 0, None, None, '"x"}'), ("t", 1, None, "c", "calc", '{"e":')]
    got = memory.tool_calls(spark.createDataFrame(parts, "stream_id string, seq int, index int, id string, name string, arguments string"))
    assert sorted(map(tuple, got.collect())) == [("s", 0, "a", "search", '{"q":"x"}'), ("t", 0, "c", "calc", "{}")]


def test_context_and_tree(spark):
    row = spark.createDataFrame([([{"field": "n", "value": "1"}], [{"score": 0.9, "type": "fact", "content": "c"}, {"score": 0.1, "type": "qa", "content": "low"}], "")], "p array<struct<field string, value string>>, m array<struct<score double, type string, content string>>, r string")
    assert row.select(memory.memory_context(F.col("p"), F.col("m"), F.col("r"))).first()[0] == "[用户信息]\n- n: 1\n\n[相关记忆]\n- [fact] c"
    assert row.select(memory.memory_context(F.col("p"), F.col("m"), F.col("r"), most=5)).first()[0] == "[用户信息\n..."
    tree = spark.createDataFrame([("a", "A", [("b", "B")]), ("c", "C", [])], "value string, label string, children array<struct<value string, label string>>")
    assert sorted(map(tuple, state.flattened(tree).na.fill("-").collect())) == [("a", "A", "-"), ("b", "B", "a"), ("c", "C", "-")]


def test_parent_sources_edges(spark):
    rows = [(1, "d", None, None, 2, float("nan"), ["x"], None), (1, "d", None, None, 1, 1.7, ["y", "x"], "t" * 9), (1, "e", 3, 4, 3, float("inf"), ["x"], "u")]
    df = spark.createDataFrame(rows, "query_id long, doc_id string, parent_idx int, chunk_index int, rank int, score double, channels array<string>, text string")
    got = {r.doc_id: r for r in ranking.parent_sources(df, 5).collect()}
    assert (got["d"].parent_idx, got["d"].chunk_ids, got["d"].matched, got["d"].channels, got["d"].first_rank, got["d"].score, got["d"].snippet) == (0, [], 2, ["x", "y"], 1, 1.0, "ttttt")
    assert (got["e"].chunk_ids, got["e"].score) == ([4], 0.0)


def test_answer_contexts(spark):
    folder = "/root/testdata/sf0.001"
    got = catalogue_dialogue.answer_contexts(spark, folder).collect()
    turns = {r.conv_id * 1000 + r.turn: r for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()}
    asked = {}
    for r in got:
        asked.setdefault(r.query_id, []).append(r)
    assert asked
    for rows in asked.values():
        rows.sort(key=lambda r: r.place)
        assert [(r.doc_id, r.id) for r in rows] == sorted((r.doc_id, r.id) for r in rows) and len(rows) <= 6
        assert sum(r.used for r in rows) <= 6000 and all(r.used == len(turns[r.id].text) or r.partial for r in rows)


def test_exact_passage_is_found(spark):
    passages = spark.createDataFrame([(i, i // 3, i % 3, f"passage number {i} about {w}", "a" if i % 2 else "b") for i, w in enumerate("library canteen dormitory scholarship bus map course exam".split())], "id long, doc_id long, parent_idx int, text string, category string")
    queries = spark.createDataFrame([(7, "passage about scholarship")], "query_id long, query string")
    got = retrieval.search_knowledge(queries, passages).collect()
    assert 3 in {r.id for r in got}
    assert {r.id % 2 for r in retrieval.search_knowledge(queries, passages, "a").collect()} == {1}


def test_a_card_is_parsed_once(spark):
    """Each field used to parse the reply again: the plan held over twenty parsers."""
    reply = '```json\n{"summary": "s", "steps": [{"title": " a "}, {"title": ""}], "materials": [" m ", " "], "duration": "1 d"}\n```'
    df = spark.createDataFrame([(reply,), ("none",), (None,), ('{"summary": "s", "steps": [{"detail": ""}]}',)], "t string")
    rows = df.select("t", messages.procedure_card(F.col("t")).alias("c")).where("c IS NOT NULL").select("t", "c.*")
    assert [tuple(r)[1:] for r in rows.collect()] == [("s", [("a", "")], ["m"], None, "1 d", None)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 2
