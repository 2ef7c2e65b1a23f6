"""Token counts of a unigram vocabulary by dynamic programming over a trie of pre-tokens.

The best segmentation of a pre-token has the largest sum of piece scores. Its forward scores depend on a prefix alone,
so the distinct new pre-tokens of a few texts are put in a trie, level by level: sorted, those that share a prefix stand
together, and each distinct prefix is one node with the best score that reaches it and the number of tokens on that way,
worked out once for all pre-tokens that begin with it. All nodes of a level are worked out at once from those of the
level before, together with the pieces that each may be in the middle of. The node where a pre-token ends holds its
count, which is remembered for later texts of the task up to a bound.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from weftline.llm.common import map_texts

#: Pre-tokens that a task remembers, the longest that is put in a trie, and bytes of text that share one.
REMEMBERED, LONGEST, TRIE_BYTES = 300_000, 64, 4 << 20
#: The mark that pieces use for a space.
SPACE = "▁"

_PRE = re.compile(r"\s*\S+|\s+")
#: A character takes 21 bits of a key.
_CHAR = 21


@dataclass
class Pieces:
    """A unigram vocabulary: score of each piece, that of a character without one, and the pieces' own trie.

    The trie is three arrays: ``keys`` (state and character, sorted), the state that follows (``states``), and by state
    ``value`` (the score of the piece that ends there, NaN if none does). State 0 is the root.
    """

    score: dict[str, float]
    unknown: float

    def __post_init__(self) -> None:
        prefixes = sorted({name[:i] for name in self.score for i in range(len(name) + 1)} | {""})
        number = {p: i for i, p in enumerate(prefixes)}
        pairs = sorted((number[p[:-1]] << _CHAR | ord(p[-1]), i) for p, i in number.items() if p)
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.states = np.array([i for _, i in pairs], np.int64)
        self.value = np.array([self.score.get(p, math.nan) for p in prefixes])
        self.longest = max(map(len, self.score), default=0)

    def after(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The state after each pair of state and character, -1 if no piece goes on so."""
        if not len(self.keys):
            return np.full(len(states), -1)
        key = states << _CHAR | chars
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.states[at], -1)


def read_pieces(path: str) -> Pieces:
    """The normal pieces of a sentencepiece model, with log-probabilities by Zipf's law over their order.

    The model at hand orders its pieces but has no probabilities of its own; nothing is trained here. A character
    without a piece costs one token for each of its UTF-8 bytes.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    base = math.log(sum(1 / (r + 1) for r in range(len(names))))
    score = {name: -math.log(r + 1) - base for r, name in enumerate(names)}
    return Pieces(score, -math.log(len(names) + 1) - base - 10.0)


def _utf8(chars: np.ndarray) -> np.ndarray:
    """Bytes of each character."""
    return 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)


def _spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``many`` places from ``first`` on: the range of each place, and the place."""
    owner = np.repeat(np.arange(len(many)), many)
    return owner, np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(owner))


def trie_counts(words: list[str], pieces: Pieces) -> np.ndarray:
    """Tokens of each of ``words``, which are distinct and sorted; of segmentations with equal scores the one with fewer tokens."""
    size = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    begin = np.cumsum(size) - size
    out = np.zeros(len(words), np.int64)
    rows = np.flatnonzero(size > 0)
    node = np.zeros(len(rows), np.int64)  # of each row, that of its prefix
    score, tokens = np.zeros(1), np.zeros(1, np.int64)  # of each node
    # Pieces that a node may be in the middle of, by node: state, and score and tokens before the piece.
    many, state, before, count = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    depth = 0
    while len(rows):
        char = chars[begin[rows] + depth]
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (char[1:] != char[:-1])])
        parent, own = node[new], char[new]
        node = np.cumsum(new) - 1
        first = np.cumsum(many) - many
        child, place = _spread(first[parent], many[parent])
        # A piece may go on, or begin at this character.
        child = np.concatenate([child, np.arange(len(own))])
        going = np.concatenate([state[place], np.zeros(len(own), np.int64)])
        before = np.concatenate([before[place], score[parent]])
        count = np.concatenate([count[place], tokens[parent]])
        state = pieces.after(going, own[child])
        on = np.flatnonzero(state >= 0)
        on = on[np.argsort(child[on], kind="stable")]
        child, state, before, count = child[on], state[on], before[on], count[on]
        score, tokens = score[parent] + pieces.unknown, tokens[parent] + _utf8(own)
        value = pieces.value[state] + before
        ends = np.flatnonzero(~np.isnan(value))
        if len(ends):
            starts = np.flatnonzero(np.diff(child[ends], prepend=-1))
            best = np.maximum.reduceat(value[ends], starts)
            group = np.cumsum(np.diff(child[ends], prepend=-1) != 0) - 1
            fewest = np.minimum.reduceat(np.where(value[ends] == best[group], count[ends] + 1, np.iinfo(np.int64).max), starts)
            at = child[ends][starts]
            better = (best > score[at]) | (best == score[at]) & (fewest < tokens[at])
            score[at[better]], tokens[at[better]] = best[better], fewest[better]
        many = np.bincount(child, minlength=len(own))
        depth += 1
        done = size[rows] == depth
        out[rows[done]] = tokens[node[done]]
        rows, node = rows[~done], node[~done]
    return out


def one_count(word: str, pieces: Pieces) -> int:
    """Tokens of one (long) word, by the same rule."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        value, n = best[-1]
        found = (value + pieces.unknown, n + len(word[end - 1].encode("utf-8", "surrogatepass")))
        for start in range(max(0, end - pieces.longest), end):
            piece = pieces.score.get(word[start:end])
            if piece is not None:
                value, n = best[start]
                if value + piece > found[0] or value + piece == found[0] and n + 1 < found[1]:
                    found = (value + piece, n + 1)
        best.append(found)
    return best[-1][1]


def count_tokens(df: DataFrame, text: str, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``n_tokens`` (long) and ``n_words`` (long, pre-tokens).

    Null and empty texts have none; an empty table gives an empty one. Whole texts are counted, whatever their length;
    repeated rows get equal counts. Columns named like the new ones are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_pieces(model_path))

    def make():
        known: dict[str, int] = {}

        def mark(word: str) -> str:
            tail = word.lstrip()
            return SPACE * (len(word) - len(tail)) + tail

        def work(texts: list) -> list:
            found = [_PRE.findall(t or "") for t in texts]
            if len(known) > REMEMBERED:
                known.clear()
            new = list(set().union(*found).difference(known))
            marked = sorted({m for m in map(mark, new) if len(m) <= LONGEST})
            count = dict(zip(marked, trie_counts(marked, sent.value).tolist()))
            known.update((w, count[m] if (m := mark(w)) in count else one_count(m, sent.value)) for w in new)
            sums = [sum(map(known.__getitem__, words)) for words in found]
            for w in new:  # long ones are not remembered: in texts without spaces each may be a whole line
                if len(w) > LONGEST:
                    del known[w]
            return [sums, [len(words) for words in found]]

        return work

    return map_texts(df, text, make, "n_tokens long, n_words long", keep, 2048, TRIE_BYTES)
