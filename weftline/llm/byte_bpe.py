"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

Each match of the split pattern is encoded by itself. Bytes are first mapped to printable characters, as the
library's byte-level vocabularies want; every way to cut a token into two known tokens becomes a merge with the
rank of the token, which gives the merges of a rank file. Distinct matches are encoded once and remembered up to
a bound, so a batch costs one library call for what it has not seen before.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import map_texts

#: Distinct matches that a task remembers, and the longest (in characters) that it does.
REMEMBERED, LONGEST = 300_000, 64


def _alphabet() -> list[str]:
    """The printable character of each byte: itself where it is one, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the content of a rank file (base64 token, space, rank)."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class Characters:
    """The printable characters of every token, one for each byte, and the byte of each character: the byte table both ways."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        to_char = dict(enumerate(_alphabet()))
        self.of = {r: t.decode("latin-1").translate(to_char) for t, r in ranks.items()}
        self.byte_of = np.zeros(0x200, np.uint8)
        self.byte_of[[ord(c) for c in _alphabet()]] = np.arange(256)
        most = max(self.of, default=-1) + 1
        self.size, self.first = np.zeros(most, np.int64), np.zeros(most, np.int64)
        order = sorted(self.of)
        self.size[order] = [len(self.of[r]) for r in order]
        self.first[order] = np.cumsum(self.size[order]) - self.size[order]
        self.flat = np.frombuffer("".join(self.of[r] for r in order).encode("utf-16-le"), "<u2")

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other: their characters joined, and the byte table read backwards."""
        n = self.size[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[ids] - (ends - n), n)
        return self.byte_of[self.flat[at]]

    def joined(self, ids: list | None) -> bytes | None:
        """The bytes of a list of ids; None if there is none, or one of them is null or no token's."""
        if ids is None or None in ids:
            return None
        at = np.array(ids, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= len(self.size) or not self.size[at].all()):
            return None
        return self.bytes_of(at).tobytes()


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.find = regex.compile(pattern).findall
        self.to_char, self.characters = dict(enumerate(_alphabet())), Characters(ranks)
        chars = lambda token: token.decode("latin-1").translate(self.to_char)
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(chars(a), chars(b)) for a, b in sorted(cuts, key=lambda cut: (ranks[cut[0]], ranks[cut[1]]))]
        self.library = Tokenizer(models.BPE(vocab={chars(t): r for t, r in ranks.items()}, merges=merges, cache_capacity=0))
    def encode(self, texts: list[str], known: dict[str, bytes]) -> list[np.ndarray]:
        """The ids (32-bit) of each text. ``known`` has the ids of matches seen before and gets the new ones, up to its bounds."""
        split = [self.find(t) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set().union(*split).difference(known))
        for at in range(0, len(new), 4096):
            few = new[at : at + 4096]
            chars = [piece.encode().decode("latin-1").translate(self.to_char) for piece in few]
            for piece, out in zip(few, self.library.encode_batch_fast(chars, add_special_tokens=False)):
                known[piece] = np.array(out.ids, "<i4").tobytes()
        out = [np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<i4") for pieces in split]
        for piece in new:
            if len(piece) > LONGEST:
                del known[piece]
        return out

    def decoded(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts' ids, one after the other, and where each text's begin and end."""
        whole = np.concatenate([np.zeros(0, np.int64), *ids])
        ends = np.concatenate([[0], np.cumsum(self.characters.size[whole])])
        return self.characters.bytes_of(whole), ends[np.cumsum([0, *map(len, ids)])]

    def offsets(self, ids: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text the first and the last-plus-one character of its tokens; a token that holds part of a character covers the whole of it."""
        raw, bounds = self.decoded(ids)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        size = self.characters.size[np.concatenate([np.zeros(0, np.int64), *ids])]
        ends = np.cumsum(size)
        many = np.array(list(map(len, ids)), np.int64)
        # Characters are counted through all texts; those before a text are taken off.
        before = np.repeat(np.concatenate([char, [0]])[np.minimum(bounds[:-1], len(char))], many)
        cuts = np.cumsum(many)[:-1]
        return np.split(char[ends - size] - before, cuts), np.split(char[ends - 1] + 1 - before, cuts)


@lru_cache(maxsize=1)
def _codec(data: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(data), pattern)


def _file(spark: SparkSession, path: str):
    """The rank file, read once on the driver and sent as a broadcast of its (fixed, under 1 MB) size."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)], dtype=np.int32), np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32))


def encode(df: DataFrame, text: str, ranks_path: str, pattern: str, offsets: bool = False, decoded: bool = False, split: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``ids`` (array of int) and, if asked for, ``starts`` and ``ends`` (characters of each token) and ``decoded`` (binary).

    ``decoded`` is what the ids stand for, as ``decode`` has it, worked out in the same pass over the data; ``n_split``
    (long; ``split``) is how many tokens begin inside a character, by their offsets, which stay in the task.

    A null text counts as empty and gets empty arrays. Rows stay as they are otherwise, repeated ones too; columns
    that have the names of the new ones are replaced. Whole texts are encoded, whatever their length.
    """
    file = _file(df.sparkSession, ranks_path)

    def make():
        codec = _codec(file.value, pattern)
        known: dict[str, bytes] = {}

        def work(values: list) -> list:
            texts = [t or "" for t in values]
            ids = codec.encode(texts, known)
            starts, ends = codec.offsets(ids) if offsets or split else ([], [])
            back = []
            if decoded:
                raw, bounds = codec.decoded(ids)
                back = [[raw[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]]
            cut = [[int((s[1:] < e[:-1]).sum()) for s, e in zip(starts, ends)]] if split else []
            return [_lists(ids), *([_lists(starts), _lists(ends)] if offsets else []), *back, *cut]

        return work

    schema = ["ids array<int>", *(["starts array<int>", "ends array<int>"] if offsets else []), *(["decoded binary"] if decoded else []), *(["n_split long"] if split else [])]
    return map_texts(df, text, make, ", ".join(schema), keep, 256)


def decode(df: DataFrame, ids: str, ranks_path: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``decoded`` (binary): the bytes of an array of ids; null where that is null, or holds a null or an id that no token has.

    Tokens are printable characters, one for each byte; the byte table, read the other way round, gives the bytes.

    A character whose bytes several tokens hold is whole again once they are joined. An empty array gives no bytes; an
    empty table an empty one. A column named ``decoded`` is replaced.
    """
    file = _file(df.sparkSession, ranks_path)

    def make():
        characters = Characters(read_ranks(file.value))
        return lambda values: [list(map(characters.joined, values))]

    return map_texts(df, ids, make, "decoded binary", keep, 256)
