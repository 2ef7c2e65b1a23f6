"""The pipeline's stages against brute-force versions of their decisions."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from weftline.llm import byte_bpe, queries, secret_scan
from weftline.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    from tests.llm.test_operators import brute_classes

    docs = table(spark, FOLDER, "documents")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, FOLDER)
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.columns == docs.columns and set(rows) <= set(held)
        if name == "near-duplicates":
            assert set(rows) == {i for i, c in brute_classes(list(held.items())).items() if i == c}
        if name == "decontamination":
            items = [r["text"] for r in table(spark, FOLDER, "benchmark").collect()]
            assert not any(x in t for t in rows.values() for x in items)
        if name == "secrets":
            assert set(rows) == set(held) and not any(secret_scan.find_spans(t) for t in rows.values())
        held, kept = rows, out
    with open(public_tokenizers.path(queries.RANKS), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(f.read()), special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER).collect()
    assert {r["doc_id"] for r in last} == set(held)
    for r in last:
        assert r["ids"] == library.encode_ordinary(held[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(held[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark):
    from tests.llm.test_operators import empty, odd

    docs = odd(spark).drop("score", "ids")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() >= 0
        assert stage(spark, empty(spark), FOLDER).count() == 0
    assert [stage(spark, docs, FOLDER).count() for _, stage in corpus_pipeline.STAGES[2:]] == [7, 7, 7]
    item = table(spark, FOLDER, "benchmark").first()["text"]
    leaking = spark.createDataFrame([(None, f"before {item} after", None, None, None), (9, None, None, None, None), (9, f"x {item}", None, None, None)], docs.schema)
    assert [r["doc_id"] for r in corpus_pipeline.decontaminated(spark, leaking.union(table(spark, FOLDER, "documents").limit(50)), FOLDER).where("doc_id is null or text is null").collect()] == [9]
    once = corpus_pipeline.deduplicate(spark, docs, FOLDER).collect()
    assert sorted((r["doc_id"] or 0) for r in once) == [0, 1, 4, 5]
