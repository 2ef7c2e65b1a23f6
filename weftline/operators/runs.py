"""Evaluation runs: labels that are carried from run to run, answers that may fail, rules by case."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.rules import ADVICE, HARD_REFUSAL
from weftline.operators.evaluation import answer_ratios

#: Defaults of a case, and how a failed answer is shown.
CATEGORY, DIFFICULTY, FAILED = "general", "medium", "[错误: {}]"
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "overall")


def selected_questions(questions: DataFrame, most: int, category: str | None = None) -> DataFrame:
    """The first ``most`` of ``questions`` (query_id, seq, question, category) that have a text, of one category if it is named, in order of ``seq``."""
    rows = questions.where(F.coalesce(F.col("question"), F.lit("")) != "")
    rows = rows.where(F.col("category") == category) if category else rows
    return rows.orderBy("seq", "query_id").limit(most)


def saved_labels(store: DataFrame) -> DataFrame:
    """(query_id, parent_id, is_relevant, note) as they stand in a label store (and ``run``): of each pair the newest row that has a label."""
    newest = Window.partitionBy("query_id", "parent_id").orderBy(F.desc("run"), F.desc("is_relevant"), F.desc("note"))
    rows = store.where("is_relevant IS NOT NULL").withColumn("__n", F.row_number().over(newest)).where("__n = 1")
    return rows.select("query_id", "parent_id", "is_relevant", F.coalesce("note", F.lit("")).alias("note"))


def collected(candidates: DataFrame, store: DataFrame, run: int) -> DataFrame:
    """The rows of a new run for the label store (query_id, parent_id, run, rank, is_relevant, note, state).

    Candidates (query_id, parent_id, rank) keep the label and note that was saved for their pair (state ``kept``) or
    wait for one (``new``); pairs with a label that are no candidates any more stay apart (``vanished``, without a
    rank), so that a later run that finds them again has their label. Repeated candidates count once, with their best
    rank. A store is only ever added to: what was known at a run can be told from its rows.
    """
    known = saved_labels(store)
    found = candidates.groupBy("query_id", "parent_id").agg(F.min("rank").alias("rank"))
    rows = found.join(known.withColumn("__known", F.lit(True)), ["query_id", "parent_id"], "full")
    state = F.when(F.col("rank").isNull(), "vanished").when(F.col("__known"), "kept").otherwise("new")
    return rows.select("query_id", "parent_id", F.lit(run).alias("run"), "rank", "is_relevant", F.coalesce("note", F.lit("")).alias("note"), state.alias("state"))


def label_status(questions: DataFrame, rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(query_id, candidates, labelled, vanished, status) of a run's questions: ``complete`` if all candidates have a label (none has also all), ``pending``, or ``error`` where ``errors`` (query_id) names the question."""
    now = F.col("state") != "vanished"
    counts = rows.groupBy("query_id").agg(F.count_if(now).alias("candidates"), F.count_if(now & F.col("is_relevant").isNotNull()).alias("labelled"), F.count_if(~now).alias("vanished"))
    out = questions.select("query_id").join(counts, "query_id", "left").na.fill(0, ["candidates", "labelled", "vanished"])
    failed = F.lit(False)
    if errors is not None:
        out = out.join(errors.select("query_id").distinct().withColumn("__failed", F.lit(True)), "query_id", "left")
        failed = F.coalesce("__failed", F.lit(False))
    status = F.when(failed, "error").when(F.col("candidates") == F.col("labelled"), "complete").otherwise("pending")
    return out.select("query_id", "candidates", "labelled", "vanished", status.alias("status"))


def guarded(answer: Callable[[pd.DataFrame], pd.Series], *columns: Column) -> Column:
    """struct(reply, error): what ``answer`` makes of ``columns``, for many rows at a time; where it raises, the error's text.

    A batch that raises is halved until the rows that do are alone, so one bad row costs no other its reply.
    """

    def attempt(rows: pd.DataFrame) -> list[tuple]:
        try:
            replies = list(answer(rows))
            if len(replies) != len(rows):
                raise ValueError(f"{len(replies)} replies to {len(rows)} rows")
            return [(None if r is None else str(r), None) for r in replies]
        except Exception as error:  # noqa: BLE001 whatever a model's client raises is that row's result
            if len(rows) == 1:
                return [(None, str(error) or type(error).__name__)]
        half = len(rows) // 2
        return attempt(rows.iloc[:half]) + attempt(rows.iloc[half:])

    @F.pandas_udf("reply string, error string")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(attempt(rows) if len(rows) else [], columns=["reply", "error"])

    return run(F.struct(*columns))


def evaluated_cases(cases: DataFrame, contexts: DataFrame, answer: Callable[[pd.DataFrame], pd.Series], via: str = "rag") -> DataFrame:
    """One row for each of ``cases`` (id, question, category, difficulty, ground_truth): its answer, contexts, measures, and the error of a case that failed.

    ``contexts`` has (id, place, name, text), a bounded number for each case, joined by line breaks for the answer.
    ``answer`` gets (question, context) and may raise: the case then has measures of 0, an answer that tells the error,
    and no contexts, and the others go on. A null category or difficulty has its default; a case that found nothing is
    answered from an empty context.
    """
    found = contexts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "name", "text"))).alias("found"))
    rows = cases.join(found, "id", "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    context = F.array_join(F.transform("found", lambda x: x["text"]), "\n")
    asked = rows.withColumn("context", context).withColumn("told", guarded(answer, F.coalesce("question", F.lit("")).alias("question"), F.col("context").alias("context")))
    ok = F.col("told.error").isNull()
    reply = F.when(ok, F.coalesce("told.reply", F.lit("")))
    measures = answer_ratios(F.coalesce("question", F.lit("")), reply, F.coalesce("ground_truth", F.lit("")), F.col("context"), F.transform("found", lambda x: x["text"]))
    before, after = FAILED.split("{}")
    told = asked.withColumn("m", measures).select(
        "id", "question", F.coalesce("category", F.lit(CATEGORY)).alias("category"), F.coalesce("difficulty", F.lit(DIFFICULTY)).alias("difficulty"),
        F.when(ok, reply).otherwise(F.concat(F.lit(before), "told.error", F.lit(after))).alias("answer"), "ground_truth",
        F.when(ok, F.transform("found", lambda x: x["name"].cast("string"))).otherwise(F.array().cast("array<string>")).alias("contexts"),
        *[F.when(ok, F.col(f"m.{c}")).otherwise(0.0).alias(c) for c in METRICS], F.lit(via).alias("via"), F.col("told.error").alias("error"),
    )
    return told


def run_summary(rows: DataFrame, by: str = "category", digits: int = 4) -> DataFrame:
    """(by, cases, failed, and the mean of each measure over the cases that did not fail; 0 without any) of ``evaluated_cases``."""
    ok = F.col("error").isNull()
    means = [F.coalesce(F.round(F.avg(F.when(ok, F.col(c))), digits), F.lit(0.0)).alias(c) for c in METRICS]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(~ok).alias("failed"), *means)


def case_issues(rules: DataFrame, answers: DataFrame) -> DataFrame:
    """(case_id, issues): what is wrong with each answer (case_id, answer, sources: array) by the rules of its case.

    ``rules`` has (case_id, expected: words an answer must hold, forbidden: array of struct(name, pattern, unless) with
    patterns it must not match (unless it matches another), may_refuse, least_sources: distinct sources it must
    draw on). Issues are, in this order, ``missing:<words>``, ``refusal``, ``forbidden:<names>``, ``no sources`` and
    ``few sources:<n>``. A refusal that also gives advice is none. Nulls count as empty; a case without rules has none
    but ``refusal`` and ``no sources``.
    """
    text = F.coalesce(F.col("answer"), F.lit(""))
    low = F.lower(text)
    empty = F.array().cast("array<string>")
    missing = F.filter(F.coalesce("expected", empty), lambda w: ~F.contains(low, F.lower(w)))
    broken = F.transform(F.filter("forbidden", lambda r: F.regexp_like(text, r["pattern"]) & ~((F.coalesce(r["unless"], F.lit("")) != "") & F.regexp_like(text, F.coalesce(r["unless"], F.lit(""))))), lambda r: r["name"])
    distinct = F.size(F.array_distinct(F.coalesce("sources", empty)))
    refuses = low.rlike(HARD_REFUSAL) & ~low.rlike(ADVICE) & ~F.coalesce("may_refuse", F.lit(False))
    issues = [
        F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))),
        F.when(refuses, F.lit("refusal")),
        F.when(F.size(F.coalesce(broken, empty)) > 0, F.concat(F.lit("forbidden:"), F.array_join(broken, ","))),
        F.when(distinct == 0, F.lit("no sources")),
        F.when((distinct > 0) & (distinct < F.coalesce("least_sources", F.lit(0))), F.concat(F.lit("few sources:"), distinct.cast("string"))),
    ]
    return answers.join(rules, "case_id", "left").select("case_id", F.filter(F.array(*issues), lambda x: x.isNotNull()).alias("issues"))
