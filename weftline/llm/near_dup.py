"""Near-duplicates by DartMinHash signatures of weighted word shingles.

Every shingle of five words is an element whose weight is how often it occurs. An element owns strips of unit
width (a last one narrower, if its weight is not whole); along each strip a hashed Poisson process throws darts, each
with a rank, a place across the strip and one of ``K`` coordinates. Only darts below a rank bound that falls with the
total weight are thrown, so the work is linear in the shingles and not in shingles times ``K``; the earliest dart of
each coordinate is the signature, and the share of equal coordinates estimates the weighted Jaccard similarity.

Signatures are joined by bands. Copies are collapsed first. All pairs of a small bucket are verified on the shingles
themselves. In a large one all members first meet a leader, chosen by a hash that differs by band. Classes that still
share a large bucket are then compared in full, every text with every text of another class, in blocks: a product of
two blocks counts the shingles that all their pairs share, and only links that join classes leave a task. Of each group
its widest class meets the others only, not itself; the products grow with the square of what no leader joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from weftline.llm.common import materialise, mix, slices, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 24, 4
K = BANDS * BAND_ROWS
#: Up to so many members, all pairs of a bucket are verified; in larger ones members meet a leader, then all of other classes.
SMALL = 8
#: Texts and shingles of a block at most (a longer text is a block of its own); shingles of a product at a time.
BLOCK_TEXTS, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 17, 4096
#: Blocks of a tile, about; every two tiles of a group meet in a task of their own.
TILE = 8

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, their counts, and where each text's begin and end.

    A text shorter than a shingle is one shingle, one without words none.
    """
    sizes = np.diff(bounds)
    made = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), made)
    at = bounds[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    h = np.zeros(len(owner), np.uint64)
    for k in range(SHINGLE):
        inside = at + k < bounds[owner + 1]
        word = words[np.minimum(at + k, max(0, len(words) - 1))] if len(words) else h
        h = np.where(inside, (h ^ word) * _GOLD + np.uint64(k), h)
        h ^= h >> np.uint64(29)
    h = mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(h)))
    return h[new], counts, np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(sizes)))]).astype(np.int64)


def signatures(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int = K) -> np.ndarray:
    """For each set (a range of ``elements`` between bounds) the earliest dart, as a 64-bit name, of each of ``k`` coordinates.

    Sets without weight get zeros.
    """
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    total = np.bincount(owner, weights, n)
    whole = np.ceil(weights).astype(np.int64)
    strip = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    width = np.minimum(1.0, np.repeat(weights, whole) - strip)
    seed = mix(np.repeat(elements, whole) + strip.astype(np.uint64) * _GOLD)
    owner = np.repeat(owner, whole)
    bound = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    first, name = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    open_sets = total > 0
    while open_sets.any():
        on = np.flatnonzero(open_sets[owner])
        alive, whose, room, rank, throw = seed[on], owner[on], width[on], np.zeros(len(on)), 1
        while len(alive):
            h = mix(alive + np.uint64(throw * 0xD1342543DE82EF95 & (1 << 64) - 1))
            rank = rank - np.log((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            on = np.flatnonzero(rank < bound[whose])
            alive, whose, room, rank, h = alive[on], whose[on], room[on], rank[on], h[on]
            other = mix(h)
            hit = (other >> np.uint64(32)).astype(np.float64) * 2.0**-32 < room
            place = whose * k + ((other & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
            hit &= rank < first[place]
            place, r, h = place[hit], rank[hit], h[hit]
            last = np.argsort(-r, kind="stable")  # of several darts on a place, the earliest is written last
            first[place[last]], name[place[last]] = r[last], h[last]
            throw += 1
        filled = np.isfinite(first).reshape(n, k).all(axis=1)
        open_sets &= ~filled
        bound = bound * 2
    return name.reshape(n, k)


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the smaller weights over sum of the larger; 0 if both are empty. Elements are sorted."""
    total = wa.sum() + wb.sum()
    if not total:
        return 0.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = b[at] == a if len(b) else np.zeros(len(a), bool)
    low = np.minimum(wa[same], wb[at[same]]).sum()
    return float(low / (total - low))


def _pack(elements: np.ndarray, weights: np.ndarray) -> bytes:
    """Shingles as 32-bit names and counts, counts left out where all are one."""
    short, at = np.unique((elements >> np.uint64(32)).astype("<u4"), return_inverse=True)
    counts = np.bincount(at, weights, len(short)).astype("<u4")
    return short.tobytes() if (counts == 1).all() else b"w" + short.tobytes() + counts.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(data) % 4 == 0:
        names = np.frombuffer(data, "<u4")
        return names, np.ones(len(names), np.int64)
    n = (len(data) - 1) // 8
    return np.frombuffer(data, "<u4", n, 1), np.frombuffer(data, "<u4", n, 1 + 4 * n).astype(np.int64)


def _signed(df: DataFrame) -> DataFrame:
    """(id, th, text) to (id, th, copy, bands): a name of the words, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                hashes, bounds = word_hashes(part.column(2).to_pylist())
                sets = np.split(hashes, bounds[1:-1])
                copies = [xxhash.xxh3_128_digest(w.tobytes()) for w in sets]
                elements, weights, ends = shingles(hashes, bounds)
                names = signatures(elements, weights.astype(np.float64), ends)
                key = np.zeros((len(names), BANDS), np.uint64)
                for row in range(BAND_ROWS):
                    key = mix(key ^ names.reshape(-1, BANDS, BAND_ROWS)[:, :, row])
                key = (key + np.arange(BANDS, dtype=np.uint64) * _GOLD).view(np.int64)
                bands = [b if len(w) else b[:0] for b, w in zip(key, sets)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(copies, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "th", "copy", "bands"])

    return df.mapInArrow(run, "id long, th long, copy binary, bands array<long>")


def _sets(df: DataFrame) -> DataFrame:
    """(id, text) to (id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                hashes, bounds = word_hashes(part.column(1).to_pylist())
                elements, weights, ends = shingles(hashes, bounds)
                packed = [_pack(elements[a:b], weights[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["id", "shingles"])

    return df.mapInArrow(run, "id long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingles are similar enough."""
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                keep = [weighted_jaccard(*_unpack(x), *_unpack(y)) >= THRESHOLD for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in part.columns[:2]], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each connected component of ``edges`` (a, b), by alternating large and small stars.

    Every round is a minimum by key and a join back; no neighbour list is ever gathered.
    """
    star = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(star)
    while before[0]:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        star = materialise(small.where("u != v").distinct())
        after = _mark(star)
        if after == before:
            break
        before = after
    return star.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")


_BLOCK = "comp long, rest boolean, no long, roots binary, sizes binary, names binary"


def _blocks(members: DataFrame) -> DataFrame:
    """(comp, rest, root, id, shingles) to blocks of texts of one ``comp`` and ``rest``; a shingle that counts n is n names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, head, roots, names, held = TaskContext.get().partitionId() << 32, 0, None, [], [], 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in names], np.int64)
            row = [*head, part + made, np.array(roots, np.int64).tobytes(), sizes.tobytes(), np.concatenate(names).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["comp", "rest", "no", "roots", "sizes", "names"])

        for batch in batches:
            for comp, rest, root, data in zip(*(c.to_pylist() for c in batch.columns)):
                short, counts = _unpack(data)
                strip = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                own = np.repeat(short.astype(np.uint64), counts) << np.uint64(32) | strip.astype(np.uint64)
                if roots and (head != (comp, rest) or len(roots) == BLOCK_TEXTS or held + len(own) > BLOCK_SHINGLES):
                    yield block()
                    made, roots, names, held = made + 1, [], [], 0
                head, held = (comp, rest), held + len(own)
                roots.append(root)
                names.append(own)
        if roots:
            yield block()

    order = ["comp", "rest", "root", "id"]
    return members.repartitionByRange(*order).sortWithinPartitions(*order).select("comp", "rest", "root", "shingles").mapInArrow(run, _BLOCK)


def _shared_names(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """How many names each text of one block shares with each of another."""
    common, out = np.intersect1d(a, b), np.zeros((len(sizes_a), len(sizes_b)), np.float32)
    sides = []
    for names, sizes in ((a, sizes_a), (b, sizes_b)):
        place = np.searchsorted(common, names)
        on = place < len(common)
        on[on] = common[place[on]] == names[on]
        owner, place = np.repeat(np.arange(len(sizes)), sizes)[on], place[on]
        order = np.argsort(place, kind="stable")
        sides.append((owner[order], place[order], len(sizes)))
    for at in range(0, len(common), COLUMNS):
        both = []
        for owner, place, n in sides:
            low, high = np.searchsorted(place, [at, at + COLUMNS])
            one = np.zeros((n, min(COLUMNS, len(common) - at)), np.float32)
            one[owner[low:high], place[low:high] - at] = 1
            both.append(one)
        out += both[0] @ both[1].T
    return out


def _joining(left: tuple, right: tuple) -> list[tuple[int, int]]:
    """Pairs of classes that links between two blocks (roots, sizes, names) join; a pair that others imply is left out."""
    (ra, na, a), (rb, nb, b) = ([np.frombuffer(x, t) for x, t in zip(side, (np.int64, np.int64, np.uint64))] for side in (left, right))
    low = _shared_names(a, na, b, nb).astype(np.float64)
    i, j = np.nonzero((low / (na[:, None] + nb[None, :] - low) >= THRESHOLD) & (ra[:, None] != rb[None, :]))
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for x, y in np.unique(np.stack([ra[i], rb[j]], axis=1), axis=0).tolist():
        if (p := top(x)) != (q := top(y)):
            parent[p] = q
            out.append((x, y))
    return out


def _between(large: DataFrame, final: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes to join: of all links between members of classes that share a large bucket, directly or by way of others."""
    rooted = large.join(final, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    seen = materialise(rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")))
    low = seen.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key", "low")
    comps = materialise(components(seen.join(low, "key").where("root != low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct()))
    comps = materialise(comps.select(F.col("id").alias("root"), F.col("root").alias("comp")).union(comps.select(F.col("root").alias("root"), F.col("root").alias("comp"))).distinct())
    members = materialise(rooted.select("id", "root").distinct().join(comps, "root"))
    widest = members.groupBy("comp", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("comp").agg(F.max_by("root", F.struct("n", "root")).alias("widest"), F.sum("n").alias("n"))
    told = members.join(widest, "comp").withColumn("rest", (F.col("root") != F.col("widest")) | (F.col("n") <= BLOCK_TEXTS)).join(sets, "id")
    blocks = materialise(_blocks(told.select("comp", "rest", "root", "id", "shingles")))
    # Blocks meet tile by tile: a tile holds some TILE blocks, so a block is sent once for each tile of its group.
    tags = materialise(blocks.select("comp", "rest", "no"))
    tiles = tags.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("n"))
    tags = tags.join(tiles, "comp").withColumn("own", F.pmod(F.xxhash64("no"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    columns = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("rest", "no", "roots", "sizes", "names")]
    sent = lambda of, side, a, b: of.select("no", "comp", F.col(a).alias("ta"), F.col(b).alias("tb")).join(blocks.drop("comp"), "no").select("comp", "ta", "tb", *columns(side))
    pairs = sent(tags.where("rest"), "a", "own", "other").join(sent(tags, "b", "other", "own").hint("merge"), ["comp", "ta", "tb"]).where("NOT b_rest OR a_no <= b_no")
    pairs = pairs.select(*[f"{side}_{c}" for side in "ab" for c in ("roots", "sizes", "names")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = [c[at].as_py() for c in batch.columns]
                found = _joining(row[:3], row[3:])
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def _grouped(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, th, copy); nodes (copy, node, least, bands), one for each different sequence of words; classes (node, root) of linked nodes, roots too.

    ``th`` is a hash of the text, so a row is told apart by its id and text; ``least`` is a node's first row: ids before
    null, then by id and hash.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast(LongType()).alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))
    signed = materialise(_signed(docs))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("least")
    nodes = signed.groupBy("copy").agg(least, F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))
    buckets = nodes.select(F.col("node").alias("id"), F.posexplode("bands").alias("band", "key"))
    leaders = buckets.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "band")).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(buckets.select("id", "key").join(leaders, "key"))
    small = shared.where(F.col("n") <= SMALL)
    every = small.select("key", F.col("id").alias("a")).join(small.select("key", F.col("id").alias("b")), "key").where("a < b")
    star = shared.where((F.col("n") > SMALL) & (F.col("a") != F.col("id"))).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    pairs = materialise(every.select("a", "b").union(star).distinct())
    wanted = shared.select("id").distinct().join(nodes.select(F.col("node").alias("id"), F.col("least.id").alias("row_id"), F.col("least.th").alias("th")), "id")
    # The wanted rows grow with the documents, so they are never broadcast, however few they are in a small run.
    texts = docs.withColumnRenamed("id", "row_id").hint("merge")
    held = texts.join(wanted, (texts["row_id"].eqNullSafe(wanted["row_id"])) & (texts["th"] == wanted["th"])).select(wanted["id"], texts["text"])
    sets = materialise(_sets(held).dropDuplicates(["id"]))
    links = materialise(_verified(pairs, sets))
    final = materialise(components(links))
    large = shared.where(F.col("n") > SMALL).select("key", "id")
    between = materialise(_between(large, final, sets))
    if not between.isEmpty():
        # Classes that the new links join: components of a graph of class names only.
        renamed = materialise(components(between))
        onward = final.join(renamed.select(F.col("id").alias("root"), F.col("root").alias("now")), "root", "left").select("id", F.coalesce("now", "root").alias("root"))
        final = materialise(onward.unionByName(renamed))
    final = final.union(final.select("root", "root")).distinct().select(F.col("id").alias("node"), "root")
    return signed.select("id", "th", "copy"), nodes, final


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (``doc_id``, ``class_id``) for each row of ``df``: the least id of its class of near-duplicates.

    Texts are compared by their lower-cased words (split at ASCII white space); texts with equal words are copies, all
    texts without words (null, empty, blank) among them. Different ones are linked from a weighted Jaccard similarity of
    0.8 on; classes are the connected components. A text under five words is one shingle. Rows without an id link texts
    as others do, but do not name a class; if no row of a class has an id, its class is null. Repeated rows stay and
    share a class; several texts under one id each have a class of their own. Columns besides the two are not looked at.
    """
    rows, nodes, final = _grouped(df, doc_id, text)
    linked = final.join(nodes.select("node", "least"), "node")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", "first")
    by_copy = nodes.select("copy", "node", "least").join(named, "node", "left").select("copy", F.coalesce("first", "least")["id"].alias("class_id"))
    return rows.select("id", "copy").join(by_copy, "copy", "left").select(F.col("id").alias(doc_id), "class_id")


def representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each class (as in ``classes``) the one with the least id, of equal ids that with the least hash of its text.

    A row with an id goes before rows without; a class without ids keeps one row. Of repeated rows (equal id and text)
    the one of the least hash of all columns stays. All columns stay as they are.
    """
    rows, nodes, final = _grouped(df, doc_id, text)
    linked = final.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("least")).select("least")
    alone = nodes.join(final.select("node"), "node", "left_anti").select("least")
    kept = alone.union(linked).select(F.col("least.id").alias("__kept_id"), F.col("least.th").alias("__kept_th"))
    often = rows.groupBy("id", "th").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    twice = often.join(kept, F.col("id").eqNullSafe(F.col("__kept_id")) & (F.col("th") == F.col("__kept_th")))
    told = df.withColumn("__th", F.xxhash64(F.col(f"`{text}`"))).hint("merge")
    same = F.col(f"`{doc_id}`").cast(LongType()).eqNullSafe(F.col("__kept_id")) & (F.col("__th") == F.col("__kept_th"))
    out = told.join(materialise(kept), same, "left_semi")
    if not twice.isEmpty():
        # Rows equal in id and text may differ elsewhere: the same one stays whichever task is run again.
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        out = out.groupBy(F.col(f"`{doc_id}`").alias("__id"), "__th").agg(F.min_by(whole, F.xxhash64(whole)).alias("__row")).select("__row.*")
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
