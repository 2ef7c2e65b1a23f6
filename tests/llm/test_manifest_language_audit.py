"""Filter audit, language identification and Merkle manifest against plain versions, SQL, held-out accuracy and on odd tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, FOLDER, empty, odd
from weftline.llm import filter_audit, language_nb, merkle, queries
from weftline.llm.common import held_out, table

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    told = lambda df: sorted(map(repr, df.astype(str).itertuples(index=False, name=None)))
    assert told(got) == told(want)


# --- filter audit


def plain_masks(rows):
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            least[r["text"] or ""] = min(least.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    for r in rows:
        body = r["text"] or ""
        words = re.findall("[^\x20\x09-\x0d]+", body)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", body)) > 3 * len(body), bool(re.search("[#$%&*|]", body)), r["doc_id"] is not None and least[body] < r["doc_id"]]
        yield r["doc_id"], r["lang"] or "", sum(f << i for i, f in enumerate(fails))


def plain_audit(rows, labels):
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1} - {None} for c in ("quality", "toxic"))
    masks, out, shapley = list(plain_masks(rows)), {}, Counter()
    for part in {p for _, p, _ in masks}:
        for order in itertools.permutations(range(5)):
            left = [(i, m) for i, p, m in masks if p == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [x for x in left if x[1] >> f & 1]
                redundant = sum(m >> f & 1 for _, m in gone)
                left = [x for x in left if not x[1] >> f & 1]
                gone += lost
                shapley[part, f] += len(lost)
                out[part, "".join("ABCDE"[i] for i in order), step] = (f, len(left), len(lost), redundant, sum(m == 1 << f for _, p, m in masks if p == part), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost))
    return {k: (*v[1:], shapley[k[0], v[0]]) for k, v in out.items()}


def test_audit_of_odd_rows(spark):
    docs = odd(spark).unionByName(spark.createDataFrame([(7, "# TWICE the same", "en", "s", 1), (6, "# TWICE the same", None, "s", 1), (8, "# TWICE the same", "", "s", 1), (None, "# TWICE the same", "en", "s", 1), (9, "\U0001d400\U0001d401 Aé \x85word\xa0x\x1cy", "en", "s", 1)], DOCS), allowMissingColumns=True).withColumn("mask", F.lit("clash")).withColumn("part", F.lit(1))
    labels = spark.createDataFrame([(7, 1, 0), (7, None, 1), (6, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").withColumn("lang", F.lit("clash"))
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in filter_audit.audit(docs, labels).collect()}
    assert got == plain_audit(docs.collect(), labels.collect())
    assert filter_audit.audit(empty(spark), labels).count() == 0
    assert len(got) == 2 * 600


def test_audit_sketch_clears_only_single_texts(spark):
    """Every text that stands twice is a possible repeat, however small the sketch; nearly all others are cleared."""
    rng = np.random.default_rng(3)
    single, twice = rng.integers(-(1 << 62), 1 << 62, 20_000), rng.integers(-(1 << 62), 1 << 62, 500)
    hot = np.full(15_000, 12345)
    hashes = spark.createDataFrame([(int(x),) for x in rng.permutation(np.concatenate([single, twice, twice, hot]))], "h long").repartition(7)
    for rows, cleared in ((36_000, 0.95), (100, 0.0)):
        sketch = filter_audit.sketch(hashes, rows)
        assert sketch.possible(twice).all() and sketch.possible(hot[:1]).all()
        assert 1 - sketch.possible(single).mean() >= cleared


def test_audit_shuffles_possible_repeats_only(spark):
    docs = table(spark, FOLDER, "documents")
    rows = {(r["doc_id"], r["part"], r["mask"]) for r in filter_audit.masks(docs).collect()}
    assert rows == set(plain_masks(docs.collect()))


# --- language


def plain_language(train, texts, buckets):
    def grams(text):
        codes = [ord(c) for c in " " + " ".join("".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in re.findall(r"[^\W\d_]+", text)) + " "]
        for n in language_nb.GRAMS:
            for i in range(len(codes) - n + 1):
                h = n
                for c in codes[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c) % (1 << 64)
                h ^= h >> 30
                h = h * 0xBF58476D1CE4E5B9 % (1 << 64)
                h ^= h >> 27
                h = h * 0x94D049BB133111EB % (1 << 64)
                h ^= h >> 31
                yield (h >> 32) % buckets

    counts, shares = defaultdict(Counter), Counter()
    for text, lang in train:
        shares[lang] += 1
        counts[lang].update(grams(text))
    for text in texts:
        own = list(grams(text))
        logs = {x: math.log(shares[x] / sum(shares.values())) + sum(math.log((counts[x][g] + language_nb.ALPHA) / (counts[x].total() + language_nb.ALPHA * buckets)) for g in own) for x in sorted(shares)}
        best = max(logs, key=logs.get)
        yield best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())


def test_language_against_a_plain_version(spark):
    docs = table(spark, SMALL, "documents").where("doc_id < 60")
    model = language_nb.train(docs, where=~held_out("doc_id"))
    got = {r["doc_id"]: r for r in language_nb.predict(docs, "text", model).collect()}
    rows = [r for r in docs.collect() if re.search(r"[^\W\d_]", r["text"])]
    train = [(r["text"], r["lang"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    short = [r for r in rows if len(r["text"]) < 3000]
    for r, (lang, score) in zip(short, plain_language(train, [r["text"] for r in short], len(model.logs))):
        assert got[r["doc_id"]]["lang_pred"] == lang
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-6


def test_language_of_held_out_rows(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "lang")
    held = queries.op12_language_nb(spark, FOLDER).where("held_out").join(docs, "doc_id").collect()
    # Texts without letters are nobody's language.
    told = [r for r in held if r["lang_pred"] != "und"]
    assert len(told) > 0.9 * len(held)
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 0.97 * len(told)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_of_odd_rows(spark):
    docs = odd(spark).withColumn("lang_pred", F.lit("clash")).unionByName(spark.createDataFrame([(7, "12 + 34 = 46 ...", "fr", "s", 1), (8, "Straße über Öl", "de", "s", 1), (9, "İstanbul été \U0001d400", "fr", "s", 1)], DOCS), allowMissingColumns=True)
    model = language_nb.train(docs)
    assert model.languages == ["de", "en", "fr"]
    out = language_nb.predict(docs, "text", model)
    assert out.columns.count("lang_pred") == 1
    rows = {r["doc_id"]: r for r in out.collect()}
    assert {k: (rows[k]["lang_pred"], rows[k]["score"]) for k in (1, 2, 3, 7)} == {k: ("und", 0.0) for k in (1, 2, 3, 7)}
    assert rows[8]["lang_pred"] == "de" and rows[9]["lang_pred"] == "fr" and rows[None]["lang_pred"] in model.languages
    none = language_nb.train(empty(spark))
    assert {r["lang_pred"] for r in language_nb.predict(docs, "text", none).collect()} == {"und"}
    assert language_nb.predict(empty(spark), "text", model).count() == 0


def test_language_blocks_do_not_matter(spark, monkeypatch):
    """The same sums whether all n-grams of a batch are taken at once or a few at a time; any number of languages."""
    rng = np.random.default_rng(1)
    model = language_nb.Model([f"l{i:02}" for i in range(40)], rng.normal(size=40), rng.normal(size=(1 << 10, 40)))
    texts = ["", None, "a", "words of some length " * 40, "123", "é b"]
    has, want = language_nb.likelihoods(texts, model)
    monkeypatch.setattr(language_nb, "CELLS", 40 * 7)
    has2, got = language_nb.likelihoods(texts, model)
    assert list(has) == list(has2) == [False, False, True, True, False, True]
    assert np.allclose(got, want)


def test_language_many_values(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {chr(97 + i % 26)} {i}", f"l{i % 50}", "s", 1) for i in range(200)], DOCS)
    monkeypatch.setattr(language_nb, "MATRIX", 1 << 10)
    assert language_nb.train(docs).logs.shape == (16, 50)
    monkeypatch.setattr(language_nb, "MOST_LANGUAGES", 49)
    with pytest.raises(ValueError):
        language_nb.train(docs)


# --- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def plain_tree(leaves):
    """The root, and for each leaf the (before, after) siblings level by level."""
    row, paths, of = list(leaves), [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(row) > 1:
        up, up_of = [], []
        for at in range(0, len(row), 3):
            run = row[at : at + 3]
            for j in range(len(run)):
                for i in of[at + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(digest(*run))
            up_of.append(sum(of[at : at + 3], []))
        row, of = up, up_of
    return row[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[b"" if r["source"] is None else b"=" + r["source"].encode()].append(r)
    names, trees, tops = sorted(groups), {}, []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
        trees[name] = own, *plain_tree([plain_leaf(r, r["text"]) for r in own])
        tops.append(trees[name][1])
    root, above = plain_tree(tops)
    for name, upper in zip(names, above):
        own, subroot, paths = trees[name]
        for r, path in zip(own, paths):
            path = path + upper
            tampered = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            folded = plain_leaf(r, r["text"].replace("\n", "") if tampered else r["text"])
            for before, after in path:
                folded = digest(before, folded, after)
            yield (r["doc_id"], plain_leaf(r, r["text"]), subroot, root, digest(*(b + a for b, a in path)), folded, folded == root)


def manifest(docs, height=merkle.HEIGHT):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, tampered, height)


def same(docs, height=merkle.HEIGHT):
    got = [tuple(r) for r in manifest(docs, height).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(docs.collect())))
    return got


def test_manifest_of_odd_rows(spark):
    more = [(i, f"line {i}\nnext\n", "en", s, i) for i in range(40) for s in (None, "", "é", "z", "\U0001f600", "￮")]
    docs = odd(spark).unionByName(spark.createDataFrame([*more, *[(None, "no id\n", None, "only", None)] * 5], DOCS), allowMissingColumns=True).withColumn("leaf", F.lit(1)).withColumn("idx", F.lit("clash"))
    got = same(docs)
    assert {r[6] for r in got} == {True, False}
    assert manifest(empty(spark)).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 27, 28, 30])
def test_manifest_of_few_rows(spark, rows):
    got = same(spark.createDataFrame([(i, f"a\n{i}", "en", "s", 1) for i in range(rows)], DOCS))
    assert rows > 1 or got[0][1] == got[0][2] == got[0][3]


def test_manifest_over_several_tiers(spark):
    """Trees of leaves and of groups that are several spans high; one group holds most rows."""
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\n"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 500, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 95).cast("string"))).alias("source"), F.lit(1).cast("long").alias("n_chars"))
    same(docs, 2)


def test_manifest_folding_reads_the_right_siblings_only():
    span = merkle.Span([digest(str(i)) for i in range(20)], merkle.levels(20))
    for i in range(20):
        assert span.folded(i, span.rows[0][i]) == span.top
        assert span.folded(i, "x") != span.top
    changed = [digest(str(i)) for i in range(20)]
    changed[7] = "x"
    assert merkle.Span(changed, merkle.levels(20)).top == span.folded(7, "x")
