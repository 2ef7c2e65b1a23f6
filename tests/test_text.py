"""Chunking and text functions against plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from weftline.functions import rules, text, vectors
from weftline.operators import chunking
from weftline.sources import documents


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def merged(parts, target=25, tail=10):
    out, held = [], ""
    if len(parts) <= 1:
        return parts
    for p in parts:
        held += p
        if len(held) >= target:
            out.append(held)
            held = ""
    if held:
        if len(held) < tail and out:
            out[-1] += held
        else:
            out.append(held)
    return out


def test_merged_sentences(spark):
    for t in ["A. B. C.", "Short. " * 9, "One long sentence that stands alone. Tiny.", "x", ""]:
        got = one(spark, t, lambda c: chunking.merged_sentences(chunking.sentences(c)))
        parts = [s.strip() for s in re.split(r"(?<=[.!?\n])\s*", t) if s.strip()]
        if "A. B" not in t:
            assert got == merged(parts)


def test_windows(spark):
    assert [len(x) for x in one(spark, "a" * 1000, chunking.windows)] == [500, 500, 100]
    assert one(spark, "", chunking.windows) == []


def packed_by_hand(text, size, overlap):
    """The rule, step by step."""

    def cut(sentence):
        return [sentence[i : i + size] for i in range(0, len(sentence), size - overlap)]

    def by_sentence(paragraph):
        out, held = [], ""
        for s in re.split(r"(?<=[。！？.!?])\s*", paragraph):
            if len(held) + len(s) > size:
                if held:
                    out.append(held.strip())
                held = "" if len(s) > size else s
                out += cut(s) if len(s) > size else []
            else:
                held += s
        return out + ([held.strip()] if held.strip() else [])

    out, held = [], ""
    for p in re.split(r"\n\n+", text):
        if len(p) > size:
            if held:
                out.append(held.strip())
            held = ""
            out += by_sentence(p)
        elif len(held) + len(p) > size:
            out.append(held.strip())
            held = held[-overlap:] + p
        else:
            held += ("\n\n" if held else "") + p
    return [c for c in [*out, held.strip()] if c]


def test_packed(spark):
    rnd = random.Random(4)
    piece = lambda: "".join(rnd.choices("ab cd。!?.\n", k=rnd.choice([3, 20, 60, 130])))
    texts = ["", "a" * 300, "x. " * 40, *["\n\n".join(piece() for _ in range(rnd.randint(1, 9))) for _ in range(80)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.packed(F.col("t"), 50, 8).alias("x")).collect()
    assert [r["x"] for r in sorted(rows)] == [packed_by_hand(t, 50, 8) for t in texts]
    got = one(spark, "a" * 300 + "\n\n" + " " * 9 + "\n\n" + "b" * 150, lambda c: chunking.packed(c, trimmed=True))
    assert got == ["a" * 300 + "\n\n" + "b" * 150]


def test_table_heads(spark):
    page = "姓名  学号\n数量  金额\na  b\nc  d  e"
    assert one(spark, page, chunking.table_like) and not one(spark, page.replace("金额", "x").replace("数量", "y"), chunking.table_like)


def test_blocks(spark):
    df = spark.createDataFrame([(1, "short\n\nalso short\n\n" + "long " * 20 + "\n\nend")], "doc_id long, text string")
    got = [r["paragraph"] for r in chunking.blocks(chunking.pieces(df, "text")).orderBy("block").collect()]
    assert got == ["short\nalso short", ("long " * 20).strip(), "end"]
    df = spark.createDataFrame([(1, "intro\n\n一、first\n\nbody\n\n二、second")], "doc_id long, text string")
    assert [r["paragraph"] for r in chunking.blocks(chunking.pieces(df, "text")).orderBy("block").collect()] == ["intro", "一、first\nbody", "二、second"]


def test_tables(spark):
    page = "| a | b |\n| 1 | 2 |\n| 3 | 4 |"
    assert one(spark, f"plain\fx\ny\nz\f{page}", chunking.table_pages) == [2]
    assert one(spark, page, chunking.table_pages) == []


def test_hash31(spark):
    def plain(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h)

    for s in ["", "a", "b:he", "ñandú", "the quick brown fox"]:
        assert one(spark, s, text.hash31) == plain(s)


def test_terms_and_rules(spark):
    assert set(one(spark, "GPU 2024 离散数学", text.query_terms)) == {"gpu", "2024", "离散", "散数", "数学", "离散数", "散数学", "离散数学"}
    assert one(spark, "奖学金申请条件", rules.question_type) == "authoritative"
    assert one(spark, "什么是离散数学", rules.question_type) == "knowledge"
    assert one(spark, "离散数学 期末 复习", lambda c: rules.keyword_category(c, rules.CATEGORY_WORDS)) == "专业课程"
    assert one(spark, "你好", lambda c: rules.route(c, ["知识库"])["route"]) == "chat"
    assert one(spark, "计算 3+4", lambda c: rules.route(c, ["知识库"])["tool"]) == "calculate"
    assert one(spark, "Request timed out", rules.error_type) == "timeout"


def test_vectors(spark):
    row = spark.sql("SELECT array(1.0D, 0.0D) a, array(1.0D, 1.0D) b, array(0.0D, 0.0D) z, map(1, 2.0D, 3, 1.0D) m, map(3, 4.0D, 2, 0.0D) n")
    got = row.select(vectors.cosine(F.col("a"), F.col("b")).alias("x"), vectors.cosine(F.col("a"), F.col("z")).alias("y"), vectors.sparse_cosine(F.col("m"), F.col("n")).alias("s"), vectors.sparse_arrays(F.col("n")).alias("v")).first()
    assert abs(got["x"] - 0.5**0.5) < 1e-12 and got["y"] == 0 and abs(got["s"] - 1 / 5**0.5) < 1e-12
    assert got["v"]["indices"] == [3]


def test_parsers(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.doc").write_text("x")
    (tmp_path / "c.docx").write_text("not a zip")
    with zipfile.ZipFile(tmp_path / "d.pptx", "w") as z:
        for n in (10, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:t>slide {n}</a:t></p>')
    got = {r["title"]: (r["text"], r["status"]) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a"] == ("hello", "ok") and got["b"] == (None, "unsupported") and got["c"][1].startswith("error")
    assert got["d"][0].index("page 2") < got["d"][0].index("page 10")


def test_ngrams_of_a_long_text(spark):
    """Linear in the text: the clean-up before the n-grams is not repeated for each of them."""
    s = "".join(random.Random(5).choices("ab c\U0001f600é", k=60_000))
    bare = re.sub(r"\s+", "", s)
    began = time.monotonic()
    assert set(one(spark, s, text.distinct_bigrams)) == {bare[i : i + 2] for i in range(len(bare) - 1)}
    assert time.monotonic() - began < 15
    for n in (1, 2, 3):
        for t in ("", "a", "ab", "a\U0001f600c d"):
            assert one(spark, t, lambda c, n=n: text.ngrams(c, n)) == [t[i : i + n] for i in range(len(t) - n + 1)]
        assert one(spark, None, lambda c, n=n: text.ngrams(c, n)) is None


def test_merge_report_merges_once(spark):
    """What is asked of the lengths is read from what was written: the report's plan cuts no text."""
    df = spark.createDataFrame([("Short. " * 9,), ("One long sentence that stands alone. Tiny.",), ("x",), ("",), (None,)], "text string")
    report = chunking.merge_report(df)
    assert "regexp_replace" not in report._jdf.queryExecution().optimizedPlan().toString()
    parts = [["Short."] * 9, ["One long sentence that stands alone.", "Tiny."], ["x"]]
    lengths = sorted(len(p) for x in parts for p in merged(x))
    row = report.first()
    assert (row["before"], row["after"], row["shortest"], row["longest"], row["p50"]) == (12, len(lengths), lengths[0], lengths[-1], lengths[len(lengths) // 2])
    assert chunking.merge_report(df.where("text = ''")).count() == 0
