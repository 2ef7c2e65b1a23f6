"""Documents to paragraphs, sentences and fixed windows, as expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.operations import floor_index, percentiles
from weftline.tables import stored

#: What begins a section and what marks lines of questions, options and answers.
SECTION = "^[一二三四五六七八九十]+[、.．]"
QUESTION, OPTION, ANSWER = r"(?i)^###\s+Q\d", r"^[- ]*[A-D]\.", r"^\*\*答案"


def pieces(df: DataFrame, text: str, separator: str = r"\n\n+", key: str = "doc_id") -> DataFrame:
    """(key, pos, piece): trimmed, non-empty pieces of the text with their places from 0."""
    kept = F.filter(F.transform(F.split(F.col(text), separator), lambda p: F.trim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    return df.select(key, F.posexplode(kept).alias("pos", "piece"))


def blocks(parts: DataFrame, key: str = "doc_id", least: int = 30) -> DataFrame:
    """Pieces merged to paragraphs (key, block, paragraph), joined by line breaks.

    A document with section headings gets a block for each, what comes before the first being one too. In others,
    short pieces and lines of questions and answers gather in one block; a question begins a new one, and a long piece
    of ordinary text stands alone. Both are running counts of breaks, so no state is carried by hand.
    """
    by = Window.partitionBy(key).orderBy("pos")
    whole = Window.partitionBy(key)
    heading = F.col("piece").rlike(SECTION)
    question = F.col("piece").rlike(QUESTION)
    marked = question | F.col("piece").rlike(OPTION) | F.col("piece").rlike(ANSWER)
    alone = ~marked & (F.length("piece") >= least)
    rows = parts.withColumn("sections", F.max(heading).over(whole)).withColumn("alone", alone)
    breaks = F.when(F.col("sections"), heading).otherwise(question | F.col("alone") | F.coalesce(F.lag("alone").over(by), F.lit(False)))
    numbered = rows.withColumn("b", F.sum(breaks.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy(key, "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "\n").alias("paragraph"))
    return joined.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("b")) - 1).alias("block"), "paragraph")


def sentences(paragraph: Column) -> Column:
    """The sentences of a paragraph: cut after an end mark or line break, except after an option's letter."""
    held = F.regexp_replace(paragraph, r"(?m)^([- ]*[A-D])\.\s", "$1\u0001")
    return F.filter(F.transform(F.split(held, r"(?<=[。！？.!?\n])\s*"), lambda s: F.replace(F.trim(s, F.lit(" \t\r\n")), F.lit("\u0001"), F.lit(". "))), lambda s: s != "")


def merged_sentences(parts: Column, target: int = 25, tail: int = 10) -> Column:
    """Sentences gathered until each piece has ``target`` characters; a rest under ``tail`` joins the piece before it.

    The running length starts anew at every piece, which no window can say, so this is a fold over the array.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, s: Column) -> Column:
        now = F.concat(state["open"], s)
        full = F.length(now) >= target
        return F.struct(F.when(full, F.array_append(state["done"], now)).otherwise(state["done"]).alias("done"), F.when(full, F.lit("")).otherwise(now).alias("open"))

    def end(state: Column) -> Column:
        done, rest = state["done"], state["open"]
        n = F.size(done)
        joined = F.concat(F.slice(done, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(done, -1), rest)))
        return F.when(rest == "", done).when((F.length(rest) < tail) & (n > 0), joined).otherwise(F.array_append(done, rest))

    return F.when(F.size(parts) <= 1, parts).otherwise(F.aggregate(parts, start, step, end))


def indexed(df: DataFrame, key: str = "doc_id", text: str = "text", separator: str = r"\n\n+") -> DataFrame:
    """Chunks (chunk_id, key, parent_id, parent_idx, chunk_index, text): the sentences of every paragraph, numbered through the document."""
    paragraphs = blocks(pieces(df, text, separator, key), key)
    parts = paragraphs.select(key, F.col("block").alias("parent_idx"), F.posexplode(merged_sentences(sentences(F.col("paragraph")))).alias("pos", "text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("parent_idx", "pos")) - 1
    rows = parts.withColumn("chunk_index", number)
    name = lambda kind, c: F.concat_ws("_", F.col(key).cast("string"), F.lit(kind), F.col(c).cast("string"))
    return rows.select(name("sent", "chunk_index").alias("chunk_id"), key, name("para", "parent_idx").alias("parent_id"), "parent_idx", "chunk_index", "text")


def windows(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Overlapping windows of a fixed size; none for an empty text."""
    step = size - overlap
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: text.substr(i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


_BLANK = " \t\r\n"


def _folded(parts: Column, size: int, longer, carried, joiner: str) -> Column:
    """Parts put together to chunks of at most ``size``: ``longer`` cuts a part that is too long by itself, ``carried`` is what a new chunk begins with."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    closed = lambda state: F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], F.trim(state["open"], F.lit(_BLANK))))

    def step(state: Column, p: Column) -> Column:
        return (
            F.when(F.length(p) > size, F.struct(F.concat(closed(state), longer(p)).alias("done"), F.lit("").alias("open")))
            .when(F.length(state["open"]) + F.length(p) > size, F.struct(closed(state).alias("done"), F.concat(carried(state["open"]), p).alias("open")))
            .otherwise(F.struct(state["done"].alias("done"), F.concat(state["open"], F.when(state["open"] == "", "").otherwise(joiner), p).alias("open")))
        )

    return F.filter(F.aggregate(parts, start, step, closed), lambda c: c != "")


def sentence_packed(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Sentences put together to chunks of at most ``size``; a longer sentence is cut in windows."""
    return _folded(F.split(text, r"(?<=[。！？.!?])\s*"), size, lambda p: windows(p, size, overlap), lambda open: F.lit(""), "")


def packed(text: Column, size: int = 500, overlap: int = 50, trimmed: bool = False) -> Column:
    """Paragraphs put together to chunks of at most ``size`` characters, blank lines between them not counted in the test.

    A new chunk begins with the last ``overlap`` characters of the one before; a paragraph longer than ``size`` closes
    the open chunk and is cut by sentences, and those in windows. Chunks are trimmed. With ``trimmed`` paragraphs are
    trimmed and blank ones dropped first, as the evaluation does.
    """
    parts = F.split(text, r"\n\n+")
    if trimmed:
        parts = F.filter(F.transform(parts, lambda p: F.trim(p, F.lit(_BLANK))), lambda p: p != "")
    return _folded(parts, size, lambda p: sentence_packed(p, size, overlap), lambda open: F.right(open, F.lit(overlap)), "\n\n")


def context_parts(context: Column) -> Column:
    """The parts of a context that lines of equals signs divide, without blank ones."""
    return F.filter(F.split(context, r"\n\n={10,}\n\n"), lambda p: F.trim(p, F.lit(_BLANK)) != "")


def content_windows(df: DataFrame, key: str, text: str, size: int, quota: int) -> DataFrame:
    """(key, window, chars): windows of ``size`` characters, in order of key, until their lengths reach ``quota`` in each key."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = df.select(key, F.posexplode(starts).alias("window", "at"), F.length(text).alias("n"))
    rows = rows.select(key, "window", F.least(F.lit(size), F.col("n") - F.col("at")).alias("chars"))
    before = F.coalesce(F.sum("chars").over(Window.partitionBy(key).orderBy("window").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < quota).drop("before")


def shares(groups: DataFrame, weight: str, total: int, order: str) -> DataFrame:
    """``total`` dealt out to the rows of ``groups`` (a small summary) by weight: at least one each, the difference to the last row if too many, the first if too few."""
    whole, by = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy(order)
    part = F.greatest(F.lit(1), F.floor(F.col(weight) * total / F.sum(weight).over(whole) + 0.5)).cast("long")
    rows = groups.withColumn("part", part).withColumn("n", F.row_number().over(by)).withColumn("rest", F.lit(total) - F.sum("part").over(whole)).withColumn("last", F.max("n").over(whole))
    fix = F.when((F.col("rest") > 0) & (F.col("n") == 1), F.col("rest")).when((F.col("rest") < 0) & (F.col("n") == F.col("last")), F.col("rest")).otherwise(0)
    return rows.withColumn("part", F.col("part") + fix).drop("n", "rest", "last")


#: Words that a table's head line may hold.
HEADER_WORDS = ("序号", "名称", "数量", "金额", "价格", "单价", "日期", "姓名", "学号", "电话", "部门", "项目", "备注", "合计", "成绩", "编号", "型号", "规格")


def table_like(page: Column) -> Column:
    """Whether a page looks like a table: pipes, rules, aligned fields or head words on enough lines."""
    lines = F.filter(F.transform(F.split(page, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    count = lambda test: F.size(F.filter(lines, test))
    fields = F.transform(lines, lambda x: F.size(F.filter(F.split(x, r"\s{2,}"), lambda f: f != "")))
    many = F.filter(fields, lambda n: n >= 2)
    pipes = count(lambda x: F.contains(x, F.lit("|"))) >= 3
    rules = count(lambda x: F.replace(x, F.lit(" ")).rlike(r"^[+\-=|]{4,}$")) >= 2
    aligned = F.exists(F.array_distinct(many), lambda n: F.size(F.filter(many, lambda m: m == n)) >= 4)
    heads = count(lambda x: x.rlike("|".join(HEADER_WORDS)) & (F.size(F.filter(F.split(x, r"\s{2,}"), lambda f: f != "")) >= 2)) >= 2
    return (F.size(lines) >= 3) & (pipes | (rules & (F.size(many) >= 3)) | (aligned & (F.size(many) >= 5)) | (heads & (F.size(many) >= 4)))


def table_pages(text: Column) -> Column:
    """Places (from 0) of the pages, divided by form feeds, that look like tables; none without page breaks."""
    pages = F.split(text, "\f")
    hits = F.filter(F.transform(pages, lambda p, i: F.when(table_like(p), i)), lambda i: i.isNotNull())
    return F.when(F.size(pages) > 1, hits).otherwise(F.array().cast("array<int>"))


def merge_report(parents: DataFrame, text: str = "text", target: int = 25, tail: int = 10) -> DataFrame:
    """One row: what merging short sentences of ``parents`` does.

    Sentences before and after, how many fewer (and per cent), and of the merged ones' lengths the mean, extremes,
    elements at floor(p x n), and how many are under 10, 30 and 100 characters and longer. Texts are cut and merged once:
    the lengths are written down, and what is asked of them is read from there. Lengths are counted by their value before
    percentiles are looked up, so no task holds all of them. Without sentences there is no row.
    """
    # Each step is the only element of an array, so that the next one has its value and does not work it out anew.
    one = F.transform(F.array(F.col(text)), sentences)
    merged = F.transform(one, lambda parts: F.struct(F.size(parts).alias("before"), F.transform(merged_sentences(parts, target, tail), lambda s: F.length(s)).alias("after")))
    split = stored(parents.select(F.inline(merged)))
    lengths = split.select(F.explode("after").alias("n"))
    counts = lengths.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    places = {f"p{round(100 * p)}": floor_index(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
    found = percentiles(lengths.withColumn("all", F.lit(1)), "all", "n", places).drop("all")
    some = lambda low, high: F.coalesce(F.sum(F.when((F.col("n") >= low) & (F.col("n") < high), F.col("c"))), F.lit(0))
    totals = counts.agg(
        F.sum("c").alias("after"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 1).alias("mean"), F.min("n").alias("shortest"), F.max("n").alias("longest"),
        some(0, 10).alias("under_10"), some(10, 30).alias("under_30"), some(30, 100).alias("under_100"), some(100, 1 << 30).alias("longer"),
    )
    before = split.agg(F.sum("before").alias("before"))
    rows = before.withColumn("all", F.lit(1)).join(totals.withColumn("all", F.lit(1)), "all").join(found.withColumn("all", F.lit(1)), "all").drop("all")
    fewer = F.col("before") - F.col("after")
    return rows.where("after IS NOT NULL").withColumn("fewer", fewer).withColumn("fewer_share", F.round(100 * fewer / F.col("before"), 1))
