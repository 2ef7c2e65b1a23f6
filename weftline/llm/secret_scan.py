"""Secret scan: patterns first, then structural confirmation of base64 and hex candidates.

A candidate run is decoded and reported only if what comes out has the build of a key or a signed token: DER whose
nested lengths fill each other exactly and whose fields are those of a private key, the length-prefixed fields of an
OpenSSH key, or a token whose first part is a JSON header with an algorithm. A run that only looks random is not.
Runs are decoded whole, once for each way to count their characters, whatever their length; keys are looked for at
every place in them where one may begin, and the length in a key's head tells where it ends.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_texts

#: Kinds in the order of ties: what patterns alone find, then what decoding confirms.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "openssh", "token")

_ASSIGN = re.compile(r"(?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}+={0,2}")
#: Where in a run a key may begin: at its start or after a mark that paths and names are joined with.
_KEY_START = re.compile(r"(?:^|(?<=[+/_-]))(?=M[C-I]|b3B)")
#: What base64 of armour holds, by where its first byte falls in a group of three; what a run of lines of base64 looks like.
_ARMOUR = [base64.b64encode(b"\0" * i + b"-----BEGIN ").decode()[-(-i * 4 // 3) : -4] for i in range(3)]
_BLOCK = re.compile(r"[A-Za-z0-9+/_-]{40,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
#: Hex in any case, with or without colons; it is no base kind.
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{32,}+")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:(?:[ \t]*+\r?\n)?[ \t]*+){15,}+[0-9A-Fa-f]{2}(?![0-9A-Fa-f])")
#: Where in bytes a key may begin: a sequence that begins with a version, or with a sequence that names an algorithm, or the OpenSSH magic.
_DER_START = re.compile(rb"(?=\x30(?:[\x00-\x7f]|\x81.|\x82..|\x83...)(?:\x02\x01[\x00-\x03]|\x30(?:[\x00-\x7f]|\x81.|\x82..)\x06)|openssh-key-v1\0)", re.S)
#: Where a key over several lines may begin, its pieces, and the line ends between them: escaped or not, quoted or not.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[C-I]|b3)[A-Za-z0-9+/_-]{14,}+(?=[ \t]*+[\"']?[ \t]*+[+,]?[ \t]*+[\r\n\\])")
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
_PAD = re.compile("={0,2}")
_BREAK = re.compile(r"(?:(?:\\r)?\\n)?[\"']?[ \t]*+[+,]?[ \t]*+\r?\n[ \t>]*+[\"']?|[ \t]*+(?:\\r)?\\n[ \t]*+")
#: What quotes a line of armoured text, at its beginning and end.
_QUOTING = re.compile(r"^[ \t>\"'#*|]+|[\"']?[ \t]*[+,;]?[ \t]*$")
#: A token may begin at each part of a dotted run.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=(e[yw][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*))")
#: Fields of a private key at most.
MOST_FIELDS = 64
#: Object identifiers of PKCS#5 and PKCS#12 encryption, without their last numbers.
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _from_base64(run: str) -> bytes | None:
    run = run.rstrip("=").translate({0x2D: "+", 0x5F: "/"})
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value that begins at ``at``; None if its length does not fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _fields(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill ``at`` to ``end`` exactly; None if they do not, or are more than a key has."""
    out = []
    while at < end:
        if (field := _tlv(data, at, end)) is None or len(out) == MOST_FIELDS:
            return None
        out.append(field)
        at = field[2]
    return out


def is_private_der(data: bytes, at: int = 0, end: int | None = None) -> bool:
    """Whether ``data`` from ``at`` to ``end`` is exactly one PKCS#1, PKCS#8 (plain or encrypted), DSA or SEC1 private key."""
    end = len(data) if end is None else end
    outer = _tlv(data, at, end)
    if outer is None or outer[0] != 0x30 or outer[2] != end:
        return False
    fields = _fields(data, *outer[1:])
    if fields and [t for t, _, _ in fields] == [0x30, 0x04]:
        inner = _fields(data, *fields[0][1:])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(_ENCRYPTION)
    if not fields or fields[0][0] != 0x02 or fields[0][2] - fields[0][1] != 1:
        return False
    tags = [t for t, _, _ in fields]
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True
    if tags == [0x02] * 6 and fields[1][2] - fields[1][1] >= 64:
        return True
    if len(tags) >= 3 and tags[1:3] == [0x30, 0x04]:
        inner = _fields(data, *fields[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    return len(tags) >= 2 and tags[1] == 0x04 and all(t & 0xE0 == 0xA0 for t in tags[2:])


def is_openssh_key(data: bytes, at: int = 0, end: int | None = None) -> bool:
    """Whether ``data`` from ``at`` to ``end`` is an OpenSSH private key: magic, three strings, a count, and keys whose lengths fit."""
    magic, end = b"openssh-key-v1\0", len(data) if end is None else end
    if not data.startswith(magic, at):
        return False
    at, seen = at + len(magic), 0
    while at < end:
        if at + 4 > end:
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        if seen == 3 and not 1 <= size <= 64:
            return False
        at, seen = at + 4 + (size if seen != 3 else 0), seen + 1
        if at > end:
            return False
    return seen >= 6


def is_signed_token(token: str) -> bool:
    """Whether the first two of three parts are JSON objects and the first names an algorithm."""
    first, second = token.split(".")[:2]
    coded = _from_base64(first) or b""
    if b'"alg"' not in coded or not coded.rstrip().endswith(b"}"):  # no object: told before anything is parsed
        return False
    try:
        head, body = json.loads(coded), json.loads(_from_base64(second) or b"")
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _of_key(data: bytes | None, at: int = 0, end: int | None = None) -> str | None:
    if not data:
        return None
    return "der" if is_private_der(data, at, end) else "openssh" if is_openssh_key(data, at, end) else None


def _key_size(data: bytes, at: int) -> int:
    """Bytes of the key that may begin at ``at``, as its head or length fields tell; 0 if none can."""
    if data[at : at + 1] == b"\x30" and at + 6 < len(data):
        n = data[at + 1] & 0x7F if data[at + 1] & 0x80 else 0
        if n > 4 or data[at + 2 + n] not in (0x02, 0x30):
            return 0
        return 2 + n + (int.from_bytes(data[at + 2 : at + 2 + n], "big") if n else data[at + 1])
    if not data.startswith(b"openssh-key-v1\0", at):
        return 0
    end, seen, most = at + 15, 0, 4
    while seen < most:
        if end + 4 > len(data):
            return 0
        size = int.from_bytes(data[end : end + 4], "big")
        if seen == 3:
            if not 1 <= size <= 64:
                return 0
            most, size = 4 + size + 1, 0
        end, seen = end + 4 + size, seen + 1
    return end - at


def _within(data: bytes, starts) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the keys that begin at some of the given places of ``data``, without overlap; nothing is copied."""
    last = 0
    for at in starts:
        if at < last:
            continue
        size = _key_size(data, at)
        if size and at + size <= len(data) and (kind := _of_key(data, at, at + size)):
            yield kind, at, at + size
            last = at + size


def _lines(text: str, at: int) -> Iterator[tuple[str, int]]:
    """The pieces of base64 that line ends join from ``at`` on, and where each ends."""
    while piece := _PIECE.match(text, at):
        yield piece[0], piece.end()
        if not (end := _BREAK.match(text, piece.end())):
            return
        at = end.end()


def _wrapped_keys(text: str) -> Iterator[tuple[int, str, int]]:
    """Start, kind and end of keys over several lines; their length fields tell where they end, which must be where a line does.

    Lines that follow each other are joined and decoded once for each way to count their characters by fours.
    """
    past = 0
    for m in _WRAPPED.finditer(text):
        if m.start() < past:
            continue
        pieces = [(end - len(piece), piece, end) for piece, end in _lines(text, m.start())]
        past = pieces[-1][2]
        whole, held = "".join(piece for _, piece, _ in pieces), 0
        begins: dict[int, int] = {}
        ends: dict[int, int] = {}
        starts: dict[int, list[int]] = {}
        for i, (start, piece, end) in enumerate(pieces):
            if len(piece) >= 16 and piece[0] in "Mb":
                starts.setdefault(held % 4, []).append(held)
                begins[held] = i
            held += len(piece)
            ends[held] = i
        for shift, places in starts.items():
            data = _from_base64(whole[shift : held - ((held - shift) % 4 == 1)]) or b""
            for kind, begin, stop in _within(data, [(at - shift) // 4 * 3 for at in places]):
                at = shift + begin // 3 * 4
                last = ends.get(at - (-(stop - begin) * 4 // 3), -1)
                if last > begins[at]:
                    yield pieces[begins[at]][0], kind, _PAD.match(text, pieces[last][2]).end()


def _armoured(text: str) -> list[tuple[int, int]]:
    """Frames of armour around a private key, in one pass: what was looked for in vain is not looked for again."""
    out, ends = [], {}
    for m in _BEGIN.finditer(text):
        mark = f"-----END {m[1]}-----"
        if ends.get(mark, 0) < m.end():
            found = text.find(mark, m.end())
            ends[mark] = found if found >= 0 else len(text) + 1
        end = ends[mark]
        if end > len(text) or text.find("-----BEGIN", m.end(), end) >= 0:
            continue
        body = text[m.end() : end]
        lines = [_QUOTING.sub("", x) for x in re.split(r"[\r\n]+|(?:\\[nr])+", body)]
        # Old encrypted keys name their cipher in header lines; what follows is no plain structure.
        locked = any(x.startswith("Proc-Type:") and x.endswith("ENCRYPTED") for x in lines) and any(x.startswith("DEK-Info:") for x in lines)
        if locked:
            good = len(_from_base64("".join(x.strip() for x in lines if ":" not in x)) or b"") >= 32
        else:
            good = _of_key(_from_base64(re.sub(r"\s+", "", "".join(lines)))) is not None
        if good:
            out.append((m.start(), end + len(mark)))
    return out


def _embedded(run: str) -> list[tuple[str, int, int]]:
    """Keys inside a run of base64: (kind, start, end). The length in a key's head tells where it ends; the run is decoded once for each way to count its characters by fours."""
    body = run.rstrip("=")
    starts: dict[int, list[int]] = {}
    for m in _KEY_START.finditer(body):
        starts.setdefault(m.start() % 4, []).append(m.start())
    out = []
    for shift, places in starts.items():
        data = _from_base64(body[shift : len(body) - ((len(body) - shift) % 4 == 1)]) or b""
        for kind, begin, stop in _within(data, [(at - shift) // 4 * 3 for at in places]):
            start, end = shift + begin // 3 * 4, shift + begin // 3 * 4 - (-(stop - begin) * 4 // 3)
            out.append((kind, start, len(run) if end == len(body) else end))
    return out


def _hex_keys(digits: str) -> Iterator[tuple[str, int, int]]:
    """Keys inside a run of hex digits: (kind, start, end), whichever digit their first byte begins at."""
    for shift in (0, 1):
        data = bytes.fromhex(digits[shift : len(digits) - (len(digits) - shift) % 2])
        for kind, begin, stop in _within(data, (m.start() for m in _DER_START.finditer(data))):
            yield kind, shift + 2 * begin, shift + 2 * stop


def _coded_armour(text: str) -> Iterator[tuple[int, int]]:
    """Runs of base64, on one line or several, that hold armour around a private key once they are decoded, wherever it begins in them."""
    for m in _BLOCK.finditer(text):
        pieces = [(p.start(), p.end()) for p in _PIECE.finditer(m[0])]
        whole = "".join(m[0][a:b] for a, b in pieces)
        if not any(x in whole for x in _ARMOUR):
            continue
        # Words that follow on the last line may have joined in; what they decode to stands after the armour.
        found = _armoured((_from_base64(whole[: len(whole) - (len(whole) % 4 == 1)]) or b"").decode("latin-1"))
        if not found:
            continue
        need, end, held = -(-found[-1][1] * 4 // 3), 0, 0
        for a, b in pieces:
            held, end = held + b - a, b
            if held >= need:
                break
        yield m.start(), _PAD.match(text, m.start() + end).end()


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind's place in KINDS, end)`` of every finding, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for m in _HEX_RUN.finditer(text):
        out += [(m.start() + a, KINDS.index(kind), m.start() + b) for kind, a, b in _hex_keys(m[0])]
    for m in _COLONS.finditer(text):
        if found := next(_hex_keys(re.sub("[^0-9A-Fa-f]", "", m[0])), None):
            out.append((m.start(), KINDS.index(found[0]), m.end()))
    if "-----BEGIN" in text:
        out += [(start, 3, end) for start, end in _armoured(text)]
    out += [(start, 3, end) for start, end in _coded_armour(text)]
    for m in _RUN.finditer(text):
        out += [(m.start() + start, KINDS.index(kind), m.start() + end) for kind, start, end in _embedded(m[0])]
    out += [(start, KINDS.index(kind), end) for start, kind, end in _wrapped_keys(text)]
    if "ey" in text or "ew" in text:
        out += [(m.start(), 6, m.end(1)) for m in _TOKEN.finditer(text) if is_signed_token(m[1])]
    return sorted(set(out))


def scan(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``secrets``: array of struct (kind, start, end), ends exclusive, in code points.

    Findings are ordered by start, then by ``KINDS``; spans of several kinds may overlap. A null or empty text has an
    empty array. Repeated rows get equal arrays; a column named ``secrets`` is replaced.
    """

    def work(texts: list) -> list:
        return [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t)] if t else [] for t in texts]]

    return map_texts(df, text, lambda: work, "secrets array<struct<kind string, start int, end int>>", keep)


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: str | None, mark: str) -> str | None:
    spans = find_spans(text) if text else []
    if not spans:
        return text
    parts, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, text: str, mark: str = "[secret]") -> DataFrame:
    """``df`` with each found span of ``text`` replaced by ``mark``; overlapping spans become one. Null texts stay null."""
    new = map_texts(df, text, lambda: lambda texts: [[_masked(t, mark) for t in texts]], f"`{text}` string")
    return new.select(*[F.col(f"`{c}`") for c in df.columns])
