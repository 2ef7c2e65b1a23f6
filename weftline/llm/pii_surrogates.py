"""PII surrogates: detected entities get keyed, type-consistent replacements.

A surrogate is drawn from HMAC-SHA256 of the entity's kind and canonical form under a secret key, so the same entity
gets the same surrogate in every document (coreference) without a shared table. Names are drawn part by part: a surname
has one surrogate, whatever title or first name goes with it, and a first name one for each gender; the gender is that
of the title or, where the title tells none, that of the name itself (a listed one or its ending). A surrogate keeps the entity's format:
digits for digits in the same places, a card number's validity, an e-mail's build, a name's script, case, number of
parts and the gender that its title tells. Two entities must not share a surrogate, and no surrogate may be a real
entity of the corpus: distinct entities are checked for both in Spark, and those that lose are drawn again until
none is left. Only the entities that were drawn again are looked up when texts are rewritten.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_texts, materialise, slices

#: Most redrawn entities that are sent to the tasks whole; beyond, they are joined to the documents that hold them.
SENT = 100_000
#: Attempts after which a form of fixed length (digits) is drawn one longer, so that no format's values are ever used up.
WIDER = 4

#: Titles with their gender, and names by script and gender to draw from.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Professor": "n", "Doctor": "n", "Sir": "m", "Lord": "m", "Lady": "f", "Dame": "f", "Madam": "f", "Signor": "m", "Signora": "f", "Docteur": "n", "Professeur": "n", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f"}
FIRST = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noah Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sara Teresa Vera".split(),
    ("latin", "n"): "Alex Ariel Casey Charlie Dana Eden Finley Jamie Jordan Kim Lee Morgan Noel Parker Quinn Robin Sage Sasha Taylor Val".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Дмитрий Егор Иван Кирилл Леонид Михаил".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Лариса Мария Ольга".split(),
    ("cyrillic", "n"): "Саша Женя Валя Шура Слава".split(),
}
#: Given names that are known for a person without a title, besides those above, by gender.
GIVEN = {
    "m": "John James Michael William David Richard Joseph Charles Daniel Matthew Anthony Mark George Kevin Brian Edward Peter Ian Henry Jack José Juan Luis Carlos Pedro Miguel Javier Antonio Diego Jean Pierre Michel Jacques François Louis Hans Klaus Wolfgang Jürgen Stefan Andreas Matthias Uwe Ahmed Ali Omar".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Jane Alice Grace Lucy Ana Carmen Lucia Sofia Isabel Elena Marta Marie Sophie Camille Claire Chloé Nathalie Isabelle Ursula Monika Petra Sabine Katrin Heike Fatima Aisha Priya".split(),
}
#: Small words inside a surname; they are no part of what is drawn.
PARTICLES = "von van der den de del della di da la le du dos ter ten zu zur bin al".split()
#: Words beside a name that tell a person.
CUES = frozenset("said says wrote writes signed called calls asked told contact author by from with named sincerely regards name met born lives works dit écrit appelle por dijo escribió llama sagte schrieb heißt von".split())
#: Surnames, letters of given names and titles in Chinese.
HAN_SURNAMES, HAN_GIVEN = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林郑", "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超霞平刚"
HAN_TITLES = {"先生": "m", "女士": "f", "小姐": "f", "教授": "n", "老师": "n", "医生": "n", "博士": "n"}
#: Endings of first names that are put together, by script and gender.
ENDINGS = {("latin", "f"): "a ia ina ella".split(), ("latin", "m"): "o us ard win".split(), ("latin", "n"): "i en y".split(), ("cyrillic", "f"): "а ия ина".split(), ("cyrillic", "m"): "ан ор ислав".split(), ("cyrillic", "n"): "и ко".split()}
#: Surnames, and first names where the list is used up, are put together from these syllables.
SYLLABLES = {"latin": "ba ber bo dal den der el fen gar hal han ka kel lan lin mar mer nor pel ran ros sal sen tal tor val ver wen wil zan".split(), "cyrillic": "ба вер гор дан ев жар зан ил кар лен мар нов ор пет ров сер тал фед хар ян".split()}

_NUMBER = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\w]|\.\d)"
    r"|(?P<card>\d(?:[ -]?\d){12,18})(?!\w)"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) \d{3}-\d{4}|\d{3}(?P<gap>[-. ])\d{3}(?P=gap)\d{4}|0\d{2,4} \d{3,4} \d{3,4})(?!\w)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?!\w))"
)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Patterns that begin with a set of characters are scanned fast; what stands before a hit is looked at afterwards.
_RUN = re.compile(r"[+(0-9][0-9 .()+-]{6,}")
_IBAN = re.compile(r"[A-Z][A-Z]\d\d(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_LETTER = "[A-ZÀ-ÖØ-ÞЀ-Я]"
_CAP = rf"(?:{_LETTER}\.(?= {_LETTER})|{_LETTER}[\w'’-]*)"
_PARTICLE = r"(?:(?:" + "|".join(PARTICLES) + r") ){0,3}"
_MORE = rf"(?: {_PARTICLE}{_CAP})"
_PERSON = re.compile(r"(" + "|".join(sorted(TITLES, key=len, reverse=True)) + rf")(\.?\s)({_CAP}{_MORE}{{0,4}})")
_NAME = re.compile(rf"{_CAP}{_MORE}{{1,5}}")
_HAN = re.compile(rf"[{HAN_SURNAMES}][\u4e00-\u9fff]{{1,2}}?(?={'|'.join(HAN_TITLES)})")
_WORD = re.compile(r"\w+")
_POSSESSIVE = re.compile(r"['’]s?$")
_NOT_DIGIT = re.compile(r"\D")


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _iban_valid(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _in_word(text: str, at: int) -> bool:
    return at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_")


_GENDER = {name.lower(): gender for (_, gender), names in FIRST.items() for name in names} | {name.lower(): gender for gender, names in GIVEN.items() for name in names}
_SMALL = frozenset(PARTICLES)


def _gender(title: str | None, name: str) -> str:
    """The gender that a title tells, or else the first name; n if neither does."""
    known = TITLES[title] if title else "n"
    if known != "n" or " " not in name:
        return known
    first = name.split(" ")[0].lower()
    return _GENDER.get(first, "f" if first[-1] in "aая" else "n")


def _script(name: str) -> str:
    return "cyrillic" if "Ѐ" <= name[0] <= "ӿ" else "latin"


def _likely(text: str, start: int, end: int, name: str) -> bool:
    """Whether capitalised words without a title are a person: points for a known given name, a surname of letters that is no given name, and a word beside it that tells a person; less for a long run of capitals, as headings have."""
    words = [w for w in name.split(" ") if w not in _SMALL]
    score = 2 if words[0].lower() in _GENDER else 0
    last = words[-1]
    score += last[1:].isalpha() and last.lower() not in _GENDER and not last.isupper()
    before, after = text[max(0, start - 24) : start].lower().split(), text[end : end + 16].lower().split()
    score += bool(CUES.intersection(w.strip(".,:;") for w in (*before[-2:], *after[:1])))
    return score - 2 * (len(words) > 4) >= 3


def words_of(kind: str, canonical: str) -> list[tuple[str | None, str]]:
    """The words of an entity with the kind that each is drawn as; a particle of a name has none and stays."""
    if kind.startswith("given"):
        _, script, gender = kind.split("-")
        return [(f"first-{script}-{gender}", canonical)]
    if not kind.startswith("person"):
        return [(kind, canonical)]
    _, script, gender = kind.split("-")
    if script == "han":
        return [(f"name-han-{gender}", canonical)]
    *first, last = canonical.split(" ")
    return [*((None if name in _SMALL else f"initial-{script}" if name.endswith(".") else f"first-{script}-{gender}", name) for name in first), (f"last-{script}", last)]


def parts(kind: str, canonical: str) -> list[tuple[str, str]]:
    """What of an entity must stay distinct from others: (kind, canonical form) of each name of a person (initials may meet), else the entity."""
    return [(k, w) for k, w in words_of(kind, canonical) if k and not k.startswith("initial")]


def _mentions(text: str, named: dict[str, tuple[str, str]]) -> Iterator[tuple[int, int, str, str]]:
    """Where the text has one of the names, the longest at each place; the text is read once, however many names there are."""
    ends = max(len(_WORD.findall(name)) for name in named)
    first = {_WORD.match(name)[0] for name in named}
    runs = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    past = 0
    for i, (start, end) in enumerate(runs):
        if start < past or text[start:end] not in first or (start and text[start - 1] in "'’-"):
            continue
        for _, stop in reversed(runs[i : i + ends]):
            if (name := named.get(text[start:stop])) is not None:
                yield start, stop, *name
                past = stop
                break


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of every entity, in order and without overlap.

    The kind of a person tells script and gender; a canonical form is what all spellings of an entity share. Persons are
    found by a title, or by a score where there is none (``_likely``), and then at each other mention in the text, by the
    same name, the surname (with its particles or without) or the first name alone.
    """
    named: dict[str, tuple[str, str]] = {}
    out, at = [], text.find("@")
    while at >= 0:
        start = at
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _MAIL.match(text, start)) and m.end() > at:
            out.append((m.start(), m.end(), "email", m[0].lower()))
        at = text.find("@", at + 1)
    for run in _RUN.finditer(text):
        for m in _NUMBER.finditer(text, run.start(), run.end() + 2):
            kind = m.lastgroup
            out.append((m.start(), m.end(), kind, m[0] if kind == "ip" else _NOT_DIGIT.sub("", m[0])))
    for m in _IBAN.finditer(text):
        if not _in_word(text, m.start()) and _iban_valid(code := m[0].replace(" ", "")):
            out.append((m.start(), m.end(), "iban", code))
    titled = []
    for m in _PERSON.finditer(text):
        if not _in_word(text, m.start()):
            name = _POSSESSIVE.sub("", m[3])
            titled.append((m.start(3), m.start(3) + len(name), m[1], name))
    # Starts and ends grow along both lists, so one pointer tells whether a run of capitals overlaps a titled name.
    at, persons = 0, list(titled)
    for m in _NAME.finditer(text):
        while at < len(titled) and titled[at][1] <= m.start():
            at += 1
        name = _POSSESSIVE.sub("", m[0])
        if (at == len(titled) or titled[at][0] >= m.end()) and not _in_word(text, m.start()) and _likely(text, m.start(), m.start() + len(name), name):
            persons.append((m.start(), m.start() + len(name), None, name))
    for start, end, title, name in persons:
        script, gender = _script(name), _gender(title, name)
        kind = f"person-{script}-{gender}"
        out.append((start, end, kind, name.lower()))
        words = name.split(" ")
        last = words[-1]
        named.setdefault(name, (kind, name.lower()))
        named.setdefault(last, (kind, last.lower()))
        if len(words) > 1:
            surname = next(i for i in range(1, len(words)) if words[i] in _SMALL or i == len(words) - 1)
            named.setdefault(" ".join(words[surname:]), (kind, " ".join(words[surname:]).lower()))
            if not words[0].endswith("."):
                named.setdefault(words[0], (f"given-{script}-{gender}", words[0].lower()))
    for m in _HAN.finditer(text):
        gender = next(g for t, g in HAN_TITLES.items() if text.startswith(t, m.end()))
        out.append((m.start(), m.end(), f"person-han-{gender}", m[0]))
    if named:
        # A name with a title of its own keeps that (the sort below is stable).
        out += _mentions(text, named)
    kept, end = [], 0
    for x in sorted(out, key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            kept.append(x)
            end = x[1]
    return kept


class _Draws:
    """An endless stream of keyed numbers for one entity."""

    def __init__(self, key: bytes, *what: str) -> None:
        self.key, self.what, self.block, self.pool = key, "\0".join(what).encode("utf-8", "surrogatepass"), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < n << 32:
            self.pool = int.from_bytes(hmac.digest(self.key, self.what + self.block.to_bytes(4, "big"), hashlib.sha256), "big")
            self.left, self.block = 1 << 256, self.block + 1
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of the entity's surrogate at the given attempt."""
    draw = _Draws(key, kind, canonical, str(attempt))
    wider = attempt // WIDER
    more = lambda: "".join(str(draw.below(10)) for _ in range(wider))
    letter = lambda c: chr(ord("a") + draw.below(26)) if c.isalpha() else str(draw.below(10)) if c.isdigit() else c
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        name, dot, top = domain.rpartition(".")
        host = _Draws(key, "domain", name)  # people of one domain stay together
        kept = "".join(chr(ord("a") + host.below(26)) if c.isalpha() else str(host.below(10)) if c.isdigit() else c for c in name)
        return "".join(map(letter, local)) + ("x%d" % attempt if attempt > 8 else "") + f"@{kept}{dot}{top}"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4 + wider))
    if kind == "card":
        body = canonical[0] + "".join(str(draw.below(10)) for _ in canonical[2:]) + more()
        check = next(str(d) for d in range(10) if _luhn(body + str(d)))
        return body + (check if _luhn(canonical) else str((int(check) + 1 + draw.below(9)) % 10))
    if kind == "iban":
        body = "".join(chr(ord("A") + draw.below(26)) if c.isalpha() else str(draw.below(10)) for c in canonical[4:]) + more()
        return canonical[:2] + "%02d" % (98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97) + body
    pick = lambda of: of[draw.below(len(of))]
    if kind.startswith("last-"):
        return "".join(pick(SYLLABLES[kind[5:]]) for _ in range(3 + attempt // 4))
    if kind.startswith("initial-"):
        return chr(ord("a" if kind.endswith("latin") else "а") + draw.below(26)) + "."
    if kind.startswith("first-"):
        _, script, gender = kind.split("-")
        if attempt < 2:
            return pick(FIRST[script, gender]).lower()
        return "".join(pick(SYLLABLES[script]) for _ in range(1 + attempt // 3)) + pick(ENDINGS[script, gender])
    if kind.startswith("name-han"):
        return pick(HAN_SURNAMES) + "".join(pick(HAN_GIVEN) for _ in range(len(canonical) - 1 + wider))
    return "".join(map(letter, canonical)) + more()


def render(kind: str, original: str, canonical: str) -> str:
    """A surrogate's canonical form in the original's format: its separators, spacing and case."""
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(canonical)
        return "".join(next(chars, "") if c.isalnum() else c for c in original) + "".join(chars)
    if len(original) > 1 and original.isupper():
        return canonical.upper()
    if kind.startswith(("person", "given")):
        return " ".join(w if o[:1].islower() else w.capitalize() for o, w in zip(original.split(" "), canonical.split(" ")))
    return canonical


def _entities(df: DataFrame, text: str) -> DataFrame:
    """The distinct (kind, canonical) that are drawn for the corpus; copies go within each task, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                seen = sorted({x for t in part.column(0).to_pylist() if t for _, _, k, c in find(t) for x in parts(k, c)})
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.string()) for i in (0, 1)], ["kind", "canonical"])

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "kind string, canonical string").distinct()


def _family(kind):
    """First names share one space of surrogates, whatever their gender, and so do surnames."""
    return F.substring_index(kind, "-", 1)


def redrawn(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt) of the entities whose first surrogate is another's, or is itself an entity.

    Of entities that share a surrogate, the one drawn first keeps it, then the least; the others draw again. Forms get
    longer with the attempts, so this ends however many entities a format has.
    """

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, canonical: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, c, a) for k, c, a in zip(kind, canonical, attempt)], dtype=object)

    real = entities.select(_family("kind").alias("f"), F.col("canonical").alias("s")).distinct()
    held = materialise(entities.select("kind", "canonical", F.lit(0).alias("attempt")).withColumn("s", drawn("kind", "canonical", "attempt")).withColumn("f", _family("kind")))
    while True:
        first = held.groupBy("f", "s").agg(F.min(F.struct("attempt", "kind", "canonical")).alias("own"), F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = held.join(first, ["f", "s"]).where(F.struct("attempt", "kind", "canonical") != F.col("own")).select("kind", "canonical", "attempt")
        same = held.join(real, ["f", "s"], "left_semi").select("kind", "canonical", "attempt")
        lost = materialise(twice.union(same).distinct())
        if lost.isEmpty():
            break
        again = lost.withColumn("attempt", F.col("attempt") + 1).withColumn("s", drawn("kind", "canonical", "attempt")).withColumn("f", _family("kind"))
        held = materialise(held.join(lost.select("kind", "canonical"), ["kind", "canonical"], "left_anti").unionByName(again))
    return held.where("attempt > 0").select("kind", "canonical", "attempt")


def replace(df: DataFrame, text: str, key: bytes, doc_id: str = "doc_id") -> DataFrame:
    """``df`` with entities of ``text`` replaced, and ``entities``: array of struct (kind, start, end, surrogate).

    Starts and ends are places in the original text. Null texts stay null and have an empty array, as have texts without
    entities, which stay as they are; an empty table gives an empty one. Whole texts are rewritten, repeated rows and
    rows without an id alike. A column named ``entities`` is replaced; all others stay.
    """
    spark = df.sparkSession
    again = materialise(redrawn(materialise(_entities(df, text)), key))

    def rewrite(t: str | None, attempts: dict) -> tuple[str | None, list[dict]]:
        found = find(t) if t else []
        pieces, at, told = [], 0, []
        for start, end, kind, canonical in found:
            drawn = " ".join(surrogate(key, k, c, attempts.get((k, c), 0)) if k else c for k, c in words_of(kind, canonical))
            new = render(kind, t[start:end], drawn)
            pieces += [t[at:start], new]
            at = end
            told.append({"kind": kind, "start": start, "end": end, "surrogate": new})
        return ("".join([*pieces, t[at:]]) if found else t), told

    schema = f"`{text}` string, entities array<struct<kind string, start int, end int, surrogate string>>"
    columns = [*[c for c in df.columns if c.lower() != "entities"], "entities"]
    if again.count() <= SENT:
        sent = spark.sparkContext.broadcast({(r["kind"], r["canonical"]): r["attempt"] for r in again.collect()})
        return map_texts(df, text, lambda: lambda texts: list(zip(*(rewrite(t, sent.value) for t in texts))), schema).select(*[F.col(f"`{c}`") for c in columns])

    def held_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {(d, k, c) for d, t in zip(batch["id"], batch["text"]) if t for _, _, kind, name in find(t) for k, c in parts(kind, name)}
            yield pd.DataFrame(sorted(seen), columns=["id", "kind", "canonical"])

    # Rows are told apart by a number of their own, which is written down: ids may be null or repeated.
    numbered = materialise(df.withColumn("__row", F.monotonically_increasing_id()))
    named = numbered.select(F.col("__row").alias("id"), F.col(f"`{text}`").alias("text"))
    by_doc = named.mapInPandas(held_by, "id long, kind string, canonical string").join(again, ["kind", "canonical"])
    # A document's own entities only, so the list is bounded by its text.
    lists = by_doc.distinct().groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("__redrawn"))
    both = numbered.join(lists, F.col("__row") == F.col("__id"), "left").withColumn("__pair", F.struct(F.col(f"`{text}`").alias("text"), F.col("__redrawn").alias("redrawn")))

    def work(pairs: list) -> list:
        attempts = lambda p: {(r["kind"], r["canonical"]): r["attempt"] for r in p["redrawn"] or ()}
        return list(zip(*(rewrite(p["text"], attempts(p)) for p in pairs)))

    return map_texts(both, "__pair", lambda: work, schema, [c for c in df.columns if c != text]).select(*[F.col(f"`{c}`") for c in columns])
