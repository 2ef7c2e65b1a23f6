"""Text expressions: hashes, n-grams, clean-up, terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash31(s: Column) -> Column:
    """The 31-multiplier hash of a string's characters in 32 bits, as a non-negative long."""
    unsigned = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % 4294967296)
    return F.abs(F.when(unsigned >= 2147483648, unsigned - 4294967296).otherwise(unsigned))


def ngrams(s: Column, n: int) -> Column:
    """All character n-grams, in order; none for a shorter string.

    Shifted lists of the characters are put side by side, so ``s`` is worked out a few times for the text and not once a gram.
    """
    chars = F.split(s, "")
    shifted = lambda i: F.slice(chars, i + 1, F.greatest(F.length(s) - n + 1, F.lit(0)))
    out = shifted(0)
    for i in range(1, n):
        out = F.zip_with(out, shifted(i), lambda a, b: F.concat(a, b))
    return F.when(F.length(s) < n, F.array().cast("array<string>")).otherwise(out)


def distinct_bigrams(s: Column) -> Column:
    """Distinct bigrams of the text without its white space."""
    return F.array_distinct(ngrams(F.regexp_replace(s, r"\s+", ""), 2))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def squeezed(s: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def entities_decoded(s: Column) -> Column:
    """The five XML entities decoded (the ampersand last, so that nothing is decoded twice), white space squeezed."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    return squeezed(s)


def markup_removed(html: Column) -> Column:
    """Visible text of an HTML page: scripts, styles and tags removed, entities decoded."""
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return entities_decoded(F.regexp_replace(body, r"(?s)<[^>]*>", " "))


#: What is taken out of Markdown before it is read aloud, in this order (pattern, replacement).
SPEECH_STEPS = (
    (r"(?s)```.*?```", " 代码内容已省略。 "),
    (r"`([^`]+)`", r"$1"),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]+)\]\([^)]*\)", r"$1"),
    (r"https?://\S+", ""),
    (r"(?m)^#{1,6}\s+", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+[.)、]\s+", ""),
    (r"[>*_~|]", ""),
)


def speech_text(markdown: Column) -> Column:
    """Markdown as text for speech."""
    out = F.coalesce(markdown, F.lit(""))
    for pattern, new in SPEECH_STEPS:
        out = F.regexp_replace(out, pattern, new)
    return squeezed(out)


def query_terms(query: Column) -> Column:
    """Distinct search terms: Latin words and numbers of two or more, 2- to 4-grams of CJK runs, all digit runs."""
    q = F.lower(F.coalesce(query, F.lit("")))
    runs = F.regexp_extract_all(q, F.lit(r"([\x{4e00}-\x{9fff}]+)"), 1)
    grams = F.flatten(F.transform(runs, lambda r: F.concat(ngrams(r, 2), ngrams(r, 3), ngrams(r, 4), F.when(F.length(r) <= 4, F.array(r)).otherwise(F.array().cast("array<string>")))))
    return F.array_distinct(F.concat(F.regexp_extract_all(q, F.lit(r"([a-z0-9]{2,})"), 1), grams, F.regexp_extract_all(q, F.lit(r"(\d+)"), 1)))


def shortened(s: Column, n: int, mark: str = "...") -> Column:
    """At most ``n`` characters, with a mark where some went."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(mark))).otherwise(s)


def html_escaped(s: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(char), F.lit(name))
    return s


def snippet(s: Column, word: str, before: int = 10, after: int = 18) -> Column:
    """The surroundings of the first hit of ``word`` (any case), with dots where text was cut; null without a hit."""
    at = F.locate(word.lower(), F.lower(s))
    start, end = F.greatest(F.lit(1), at - before), F.least(F.length(s), at + len(word) + after - 1)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), s.substr(start, end - start + 1), F.when(end < F.length(s), "...").otherwise(""))
    return F.when(at > 0, cut)


def highlighted(s: Column, word: str) -> Column:
    """The text as HTML, its first hit of ``word`` (any case, looked for in the escaped text) marked; quotes in single form stay. Null is empty."""
    out = F.coalesce(s.cast("string"), F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    at = F.locate(word.lower(), F.lower(out)) if word else F.lit(0)
    n = len(word)
    marked = F.concat(out.substr(F.lit(1), at - 1), F.lit('<mark class="search-hit">'), out.substr(at, F.lit(n)), F.lit("</mark>"), out.substr(at + n, F.length(out)))
    return F.when(at > 0, marked).otherwise(out)
