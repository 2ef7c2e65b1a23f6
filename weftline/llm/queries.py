"""The registered queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import ann_ivfpq, byte_bpe, decontaminate, filter_audit, language_nb, merkle, near_dup, pii_surrogates, quality_gam, secret_scan, sharding, toxicity_zstd, unigram_count
from weftline.llm.common import held_out, table

#: The rank file of the encoding query, from the installed package of public vocabularies.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The model whose pieces the counting query takes.
PIECES = "piece_bpe_32k.model"
#: The key of the surrogate query; a deployment gives its own secret.
KEY = b"weftline-demonstration-key"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in secret_scan.BASE_KINDS], F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("secrets")).alias("spans"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op1_secret_scan`` SQL can tell: the spans that patterns alone find."""
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op2_ann_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_ivfpq.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 24)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = pii_surrogates.replace(docs, "text", KEY)
    places = F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string")))
    return new.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(places, ",").alias("entities"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_gam.score(docs, "text", model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_unigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram_count.count_tokens(docs, "text", public_tokenizers.path(PIECES), ["doc_id"])


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = byte_bpe.encode(docs, "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True, split=True, keep=["doc_id"])
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


def op9_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_zstd.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity_zstd.score(docs, "text", model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_language_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_nb.train(docs, where=~F.coalesce(held_out("doc_id"), F.lit(True)))
    return language_nb.predict(docs, "text", model, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, tampered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, secret_base_spans, op2_ann_ivfpq, op3_near_dup, op4_sharding, op5_pii_surrogates, op6_quality_gam, op7_unigram_count, op8_byte_bpe, op9_toxicity_zstd, op10_decontaminate, op11_filter_audit, op12_language_nb, op13_merkle_manifest)}

_LETTERS = "ABCDE"
_ORDERS = [("".join(o), i + 1, o[i], o[:i]) for o in permutations(_LETTERS) for i in range(len(_LETTERS))]
_AUDIT_SQL = f"""
WITH steps(filter_order, step, bit, earlier) AS (VALUES {", ".join(f"('{o}', {s}, {1 << _LETTERS.index(f)}, {sum(1 << _LETTERS.index(x) for x in e)})" for o, s, f, e in _ORDERS)}),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
marked AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(marked.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN marked USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY part, mask),
told AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (bit | earlier) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM counts CROSS JOIN steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM told
"""


def _tree_sql(name: str, nodes: str, height: int) -> str:
    """Levels ``{name}0`` to ``{name}{height}`` of the trees over ``nodes`` (grp, idx, digest), enough for ``3 ** height`` nodes; a single node is carried up as it is."""
    out = [f"{name}0 AS (SELECT grp, idx, digest, count(*) OVER (PARTITION BY grp) AS total FROM ({nodes}))"]
    for k in range(height):
        out.append(
            f"{name}{k + 1} AS (SELECT grp, idx // 3 AS idx, CASE WHEN max(total) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE max(digest) END AS digest, (max(total) + 2) // 3 AS total FROM {name}{k} GROUP BY grp, idx // 3)"
        )
    return ",\n".join(out)


def _climb_sql(rows: str, name: str, height: int) -> tuple[str, str]:
    """Views that fold ``rows`` (row, grp, idx, digest, proof) through the levels ``name``; and the last one's name."""
    out, last = [], rows
    for k in range(height):
        one = f"{rows}_{name}{k}"
        sides = "coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx {} r.idx), '')"
        out.append(
            f"{one} AS (SELECT r.row, r.grp, r.idx // 3 AS idx, CASE WHEN max(s.total) > 1 THEN sha256({sides.format('<')} || r.digest || {sides.format('>')}) ELSE r.digest END AS digest, r.proof || {sides.format('<>')} AS proof "
            f"FROM {last} r JOIN {name}{k} s ON r.grp = s.grp AND r.idx // 3 = s.idx // 3 GROUP BY r.row, r.grp, r.idx, r.digest, r.proof)"
        )
        last = one
    return ",\n".join(out), last


#: Levels that the SQL below has for the leaves of a source and for the sources.
_LEAF_LEVELS, _SOURCE_LEVELS = 9, 5


def _merkle_sql() -> str:
    value = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END"
    leaf = lambda text: "sha256(" + " || ".join(value(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"
    climbed, ends = _climb_sql("start", "l", _LEAF_LEVELS)
    folded, last = _climb_sql("upper", "g", _SOURCE_LEVELS)
    return f"""
WITH leaves AS (SELECT doc_id, coalesce('=' || source, '') AS name, {leaf("text")} AS leaf, CASE WHEN xor({crc}, 4294967295::UBIGINT) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS new FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS row FROM leaves),
{_tree_sql("l", "SELECT name AS grp, idx, leaf AS digest FROM numbered", _LEAF_LEVELS)},
tops AS (SELECT grp AS name, digest, row_number() OVER (ORDER BY grp) - 1 AS idx FROM l{_LEAF_LEVELS}),
{_tree_sql("g", "SELECT '' AS grp, idx, digest FROM tops", _SOURCE_LEVELS)},
start AS (SELECT row, name AS grp, idx, new AS digest, '' AS proof FROM numbered),
{climbed},
upper AS (SELECT row, '' AS grp, tops.idx, c.digest, c.proof FROM {ends} c JOIN tops ON c.grp = tops.name),
{folded}
SELECT doc_id, leaf, tops.digest AS subroot, root.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = root.digest AS verified
FROM numbered JOIN tops USING (name) JOIN {last} f USING (row) CROSS JOIN g{_SOURCE_LEVELS} AS root
"""


def _secrets_sql() -> str:
    """Places of matches from the texts between them: RE2 tells what matches, not where."""
    kinds = [
        ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, '{p}', 1)) >= 8"),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
        ("hex", "[0-9a-f]+", "length(m) >= 32"),
    ]
    parts = []
    for place, (kind, pattern, rule) in enumerate(kinds):
        rule = rule.replace("{p}", pattern)
        parts.append(
            f"SELECT doc_id, {place} AS place, '{kind}' AS kind, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length(m) AS size, {rule} AS good "
            f"FROM (SELECT doc_id, unnest(regexp_extract_all(body, '{pattern}')) AS m, unnest(list_slice(regexp_split_to_array(body, '{pattern}'), 1, len(regexp_extract_all(body, '{pattern}')))) AS gap, unnest(range(len(regexp_extract_all(body, '{pattern}')))) AS i FROM texts) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in kinds)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS (SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE good)
SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, place), '')) AS base_sha256
FROM texts LEFT JOIN found USING (doc_id) GROUP BY doc_id
"""


#: The other operators cannot be written in SQL; tests/llm holds each against a brute-force version, a round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"secret_base_spans": _secrets_sql(), "op11_filter_audit": _AUDIT_SQL, "op13_merkle_manifest": _merkle_sql()}
