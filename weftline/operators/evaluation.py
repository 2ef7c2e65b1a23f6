"""Evaluation of ranked lists against relevance, and roll-ups of the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.rules import DETAIL, REFUSAL
from weftline.operators.operations import floor_index, percentiles
from weftline.tables import half_up


def valid_ids(ids: Column) -> Column:
    """Relevance ids without blanks and placeholders."""
    return F.filter(ids, lambda x: (F.trim(x) != "") & ~F.upper(F.trim(x)).startswith("TODO"))


def distinct_ranked(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank): first occurrences only, ranked anew without gaps."""
    first = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("at"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id")).alias("rank"))


def ideal_gain(n: Column, k: int) -> Column:
    """The largest discounted gain that ``n`` relevant documents can have in ``k`` places."""
    out = F.lit(0.0)
    for i in range(1, k + 1):
        out = out + F.when(n >= i, 1 / F.log2(F.lit(i + 1.0))).otherwise(0.0)
    return out


def query_metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5), distinct: bool = True, digits: int = 6) -> DataFrame:
    """One row a query of ``relevant`` (query_id, doc_id): recall, precision, reciprocal rank, hit, recall@k and ndcg@k.

    Queries that found nothing have zeros. With ``distinct`` a document counts where it first occurs.
    """
    ranked = distinct_ranked(hits) if distinct else hits.select("query_id", "doc_id", "rank")
    judged = ranked.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return judged_metrics(judged, relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant")), ks, digits)


def judged_metrics(judged: DataFrame, wanted: DataFrame, ks: tuple[int, ...] = (1, 3, 5), digits: int = 6) -> DataFrame:
    """The same from judged hits (query_id, doc_id, rank, hit 0 or 1) and the number of relevant documents of each query (query_id, relevant).

    Where relevance follows from a property of rows, neither side has to list all pairs.
    """
    at = lambda k: [F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"hits{k}"), F.sum(F.when((F.col("rank") <= k) & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias(f"gain{k}")]
    found = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"), F.sum("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_rank"), *[c for k in ks for c in at(k)])
    both = wanted.join(found, "query_id", "left").na.fill(0, ["retrieved", "hits", *[f"{p}{k}" for k in ks for p in ("hits", "gain")]])
    rounded = lambda c, name: F.round(c, digits).alias(name)
    return both.select(
        "query_id", "relevant", "retrieved", "first_rank",
        rounded(F.col("hits") / F.col("relevant"), "recall"),
        rounded(F.when(F.col("retrieved") > 0, F.col("hits") / F.col("retrieved")).otherwise(0.0), "precision"),
        rounded(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), "rr"),
        (F.col("hits") > 0).cast("int").alias("hit"),
        *[rounded(F.col(f"hits{k}") / F.col("relevant"), f"recall_at_{k}") for k in ks],
        *[rounded(F.least(F.lit(1.0), F.col(f"gain{k}") / ideal_gain(F.col("relevant"), k)), f"ndcg_at_{k}") for k in ks],
    )


def bad_case(metrics: DataFrame, answer: Column | None = None, error: Column | None = None) -> Column:
    """What went wrong with a query, by the first rule that applies."""
    answer = F.lit(None).cast("string") if answer is None else answer
    error = F.lit(None).cast("string") if error is None else error
    return (
        F.when(error.isNotNull(), "api_error")
        .when(F.col("relevant").isNull() | (F.col("relevant") == 0), "skipped")
        .when(F.col("retrieved") == 0, "no_retrieval")
        .when(F.col("hit") == 0, "recall_miss")
        .when(F.col("first_rank") > 3, "ranking_error")
        .when(F.col("precision") < 0.34, "noisy_context")
        .when(F.coalesce(answer, F.lit("")).rlike(REFUSAL), "generation_refusal")
        .otherwise("pass")
    )


def grouped_means(metrics: DataFrame, by: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    """Counts and means over all rows and by each of ``by``, as one pass of grouping sets: (grouping, value, n, means)."""
    named = metrics.select(*[F.coalesce(F.col(b).cast("string"), F.lit("unknown")).alias(b) for b in by], *columns)
    sets = named.groupingSets([[], *[[F.col(b)] for b in by]], *[F.col(b) for b in by])
    out = sets.agg(*[F.grouping(b).alias(f"g_{b}") for b in by], F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.coalesce(c, F.lit(0.0))), digits).alias(f"mean_{c}") for c in columns])
    grouping, value = F.lit("all"), F.lit("all")
    for b in by:
        grouping, value = F.when(F.col(f"g_{b}") == 0, b).otherwise(grouping), F.when(F.col(f"g_{b}") == 0, F.col(b)).otherwise(value)
    return out.select(grouping.alias("grouping"), value.alias("value"), "n", *[f"mean_{c}" for c in columns])


def confusion(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Counts of each expected and actual pair, with whether they agree."""
    return df.groupBy(F.col(expected).cast("string").alias("expected"), F.col(actual).cast("string").alias("actual")).agg(F.count(F.lit(1)).alias("n")).withColumn("agree", (F.col("expected") == F.col("actual")).cast("int"))


def compare_arms(a: DataFrame, b: DataFrame, on: str, metric: str, digits: int = 6) -> DataFrame:
    """Two runs side by side by ``on``; a group that one run lacks has null there."""
    left, right = a.select(on, F.col(metric).alias("a")), b.select(on, F.col(metric).alias("b"))
    delta = F.round(F.col("b") - F.col("a"), digits)
    return left.join(right, on, "full").select(on, "a", "b", delta.alias("delta"), F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "same").alias("direction"))


def floor_percentile(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """(by, value): the element at floor(p x n) of each group's sorted values, which is not the nearest rank."""
    return percentiles(rows, by, value, {"__found": floor_index(p)}).withColumnRenamed("__found", value)


def label_value(label: Column) -> Column:
    """A judge's label as boolean; null for anything else."""
    text = F.lower(F.trim(label.cast("string")))
    return F.when(text.isin("true", "yes", "y", "1", "relevant"), True).when(text.isin("false", "no", "n", "0", "irrelevant", "not_relevant"), False)


def judge_score(text: Column) -> Column:
    """The number ``score`` in the JSON of a judge's reply (the whole reply, a fenced block, or from brace to brace); above 1 taken as per cent; within 0 and 1. 0 where there is none."""
    reply = F.coalesce(text, F.lit(""))
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    parsed = F.coalesce(*[F.try_parse_json(F.trim(x)) for x in (reply, fenced, F.regexp_extract(reply, r"(?s)\{.*\}", 0))])
    field = F.try_variant_get(parsed, "$.score", "variant")
    raw = F.when(F.schema_of_variant(field).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(parsed, "$.score", "double"))
    return F.when(raw.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(raw > 1, raw / 100).otherwise(raw))))


def coverage(answer: Column, words: Column) -> Column:
    """The share of ``words`` that the answer holds; null without words."""
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(F.lower(answer), w))) / F.size(words))


def keywords(text: Column) -> Column:
    """Distinct words to look for: Latin words of two letters or more, every CJK character, their pairs and first ten triples, and numbers."""
    cjk = F.regexp_replace(text, "[^\u4e00-\u9fff]", "")
    grams = lambda n: F.when(F.length(cjk) >= n, F.transform(F.sequence(F.lit(1), F.length(cjk) - n + 1), lambda i: cjk.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z]{2,})")), lambda w: F.lower(w))
    return F.array_distinct(F.concat(words, grams(1), grams(2), F.slice(grams(3), 1, 10), F.regexp_extract_all(text, F.lit(r"(\d+)"))))


def found_share(words: Column, text: Column) -> Column:
    """The share of ``words`` that the lower-cased text holds; 0 without words."""
    low = F.lower(text)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(low, F.lower(w)))) / F.size(words)).otherwise(0.0)


def answer_ratios(question: Column, answer: Column, truth: Column, context: Column, sources: Column) -> Column:
    """Four coverage ratios and their mean, to two places half up; all 0 without an answer or a true one.

    ``faithfulness``: keywords of the truth in the answer; ``answer_relevancy``: of the question in the answer;
    ``context_recall``: of the truth in the context; ``context_precision``: sources that hold some keyword of the truth.
    """
    wanted, asked = keywords(truth), keywords(question)
    held = F.filter(sources, lambda s: F.exists(wanted, lambda w: F.contains(F.lower(s), F.lower(w))))
    parts = {
        "faithfulness": found_share(wanted, answer), "answer_relevancy": found_share(asked, answer),
        "context_precision": F.when(F.size(sources) > 0, F.size(held) / F.size(sources)).otherwise(0.0), "context_recall": found_share(wanted, context),
    }
    parts["overall"] = (parts["context_recall"] + parts["answer_relevancy"] + parts["faithfulness"] + parts["context_precision"]) / 4
    given = (F.coalesce(truth, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != "")
    return F.struct(*[F.when(given, half_up(v, 2)).otherwise(0.0).alias(name) for name, v in parts.items()])


def score_of(*aliases: Column) -> Column:
    """The first of several columns that is not null; not a number or infinite counts as null; within 0 and 1."""
    first = F.coalesce(*[c.cast("double") for c in aliases])
    finite = F.when(~F.isnan(first) & (F.abs(first) < float("inf")), first)
    return F.when(finite.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite)))


def baseline(metrics: DataFrame, recall: str, precision: str, gate: float = 0.8, digits: int = 6) -> DataFrame:
    """One row: mean recall and precision, and whether the recall passes the gate."""
    mean = F.round(F.avg(recall), digits)
    return metrics.agg(F.count(F.lit(1)).alias("queries"), mean.alias("recall"), F.round(F.avg(precision), digits).alias("precision"), (F.avg(recall) >= gate).cast("int").alias("passed"))


def labelled_queries(candidates: DataFrame, label: Column) -> DataFrame:
    """(query_id, labelled, partly): whether all, or any, of a query's candidates have a label."""
    return candidates.groupBy("query_id").agg(F.bool_and(label.isNotNull()).cast("int").alias("labelled"), F.bool_or(label.isNotNull()).cast("int").alias("partly"))


def rerank_metrics(candidates: DataFrame, label: Column, top: int = 10) -> DataFrame:
    """(query_id, candidates, relevant, in_top, hit, first_rank, rr) of candidates (query_id, rank) whose label is true, false or null."""
    hit = F.when(label, F.col("rank"))
    first = F.min(hit)
    return candidates.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count(hit).alias("relevant"), F.count(F.when(hit <= top, 1)).alias("in_top"),
        F.coalesce((first <= top).cast("int"), F.lit(0)).alias("hit"), first.alias("first_rank"), F.coalesce(F.round(1 / first, 6), F.lit(0.0)).alias("rr"),
    )


def rerank_summary(metrics: DataFrame) -> DataFrame:
    """One row over queries: recall of the hit kind, mean reciprocal rank and first rank, ranking errors, and what follows for reranking."""
    rows = metrics.agg(
        F.count(F.lit(1)).alias("evaluated"), F.round(F.avg("hit"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"),
        F.coalesce(F.round(F.avg("first_rank"), 6), F.lit(0.0)).alias("mean_first_rank"), F.count_if(F.col("first_rank") > 3).alias("ranking_errors"),
    )
    advice = (
        F.when(F.col("evaluated") == 0, "label first")
        .when((F.col("recall") >= 0.95) & (F.col("mrr") >= 0.5) & (F.col("mean_first_rank") > 0) & (F.col("mean_first_rank") <= 2), "skip reranking")
        .when((F.col("mrr") <= 0.25) | (F.col("mean_first_rank") >= 5), "go on with reranking")
        .otherwise("small comparison first")
    )
    return rows.withColumn("advice", advice)


def hard_case(terms: Column, answer: Column) -> Column:
    """Of an answer to a hard question: share of the terms it holds (1 without terms), how many it lacks, whether it refuses, its length."""
    text = F.coalesce(answer, F.lit(""))
    found = F.size(F.filter(terms, lambda t: F.contains(F.lower(text), F.lower(t))))
    covered = F.when(F.size(terms) > 0, half_up(found / F.size(terms), 2)).otherwise(1.0)
    return F.struct(covered.alias("coverage"), (F.size(terms) - found).alias("missing"), text.rlike(REFUSAL).cast("int").alias("refused"), F.length(text).alias("chars"))


def probe_result(answer: Column, sources: Column) -> Column:
    """What became of a probe question: no sources is ``no_retrieval``, a refusal in spite of some ``generation_refusal``, else ``pass``. ``sources`` is how many there are; null is none."""
    return F.when(F.coalesce(sources, F.lit(0)) == 0, "no_retrieval").when(F.coalesce(answer, F.lit("")).rlike(REFUSAL), "generation_refusal").otherwise("pass")


def unsupported(answer: Column, context: Column) -> Column:
    """Whether an answer goes into detail (numbers, lists) though its context is shorter than 50 characters, and does not refuse; likely made up."""
    text = F.coalesce(answer, F.lit(""))
    return (F.length(F.coalesce(context, F.lit(""))) < 50) & text.rlike(DETAIL) & ~text.rlike(REFUSAL)


def probe_summary(rows: DataFrame, digits: int = 4) -> DataFrame:
    """(expected, n, match, rate, unsupported) of probes (expected, actual, unsupported): how often the result was the expected one, and how many answers look made up."""
    match = F.count_if(F.col("expected") == F.col("actual"))
    return rows.groupBy("expected").agg(F.count(F.lit(1)).alias("n"), match.alias("match"), half_up(match / F.count(F.lit(1)), digits).alias("rate"), F.count_if("unsupported").alias("unsupported"))


def tool_accuracy(rows: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """(by, judged, correct, accuracy, mean_ms, p95_ms) of tool choices (expected_route, route, expected_tool, tool, ms).

    A sample without an expected tool is not judged, but its time counts; a route and a tool must both be right; one
    that failed (no time) is judged wrong and has no time. The 95th percentile is the element at floor(0.95 n).
    """
    judged = F.col("expected_tool").isNotNull()
    right = F.count_if(judged & (F.col("route") == F.col("expected_route")) & F.col("tool").eqNullSafe(F.col("expected_tool")) & F.col("ms").isNotNull())
    sums = rows.groupBy(by).agg(F.count_if(judged & F.col("ms").isNotNull()).alias("judged"), right.alias("correct"), F.coalesce(half_up(F.avg("ms")), F.lit(0.0)).alias("mean_ms"))
    late = floor_percentile(rows.where("ms IS NOT NULL"), by, "ms", 0.95).withColumnRenamed("ms", "p95_ms").withColumnRenamed(by, "__by")
    rate = F.when(F.col("judged") > 0, F.round(F.col("correct") / F.col("judged"), digits))
    return sums.join(late, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "judged", "correct", rate.alias("accuracy"), "mean_ms", F.coalesce("p95_ms", F.lit(0.0)).alias("p95_ms"))


def grid_metrics(hits: DataFrame, relevant: DataFrame, by: list[str], k: int = 5, digits: int = 6) -> DataFrame:
    """(by, queries, recall, hit_rate, mrr, mean_first) of ranked lists (by, query_id, id: text, rank) against ``relevant`` (query_id, prefix, and any of ``by`` that tells of the query).

    A row is relevant if its id begins with one of the query's prefixes (the whole id is one too): the prefixes of each
    hit are listed, at most as many as its id has characters, and met by equality. Recall is the share of a query's
    prefixes that the first ``k`` hits have, the first rank 0 where there is none.
    """
    own = [c for c in by if c in relevant.columns]
    wanted = relevant.where("prefix <> '' AND NOT startswith(prefix, 'TODO')").select("query_id", "prefix", *own).distinct()
    asked = wanted.groupBy("query_id", *own).agg(F.count(F.lit(1)).alias("wanted"))
    lists = [c for c in by if c not in own]
    begun = hits.select(*lists, "query_id", "rank", F.explode(F.transform(F.sequence(F.lit(1), F.length("id")), lambda n: F.substring("id", F.lit(1), n))).alias("prefix"))
    met = begun.join(wanted.select("query_id", "prefix"), ["query_id", "prefix"]).groupBy(*lists, "query_id").agg(F.count_distinct(F.when(F.col("rank") <= k, F.col("prefix"))).alias("found"), F.min("rank").alias("first"))
    one = hits.select(*lists, "query_id").distinct().join(asked, "query_id").join(met, [*lists, "query_id"], "left").na.fill(0, ["found", "first"])
    return one.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("found") / F.col("wanted")), digits).alias("recall"), F.round(F.avg((F.col("found") > 0).cast("int")), digits).alias("hit_rate"),
        F.round(F.avg(F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0)), digits).alias("mrr"), F.round(F.avg("first"), digits).alias("mean_first"),
    )
