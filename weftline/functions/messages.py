"""Expressions over messages and model replies: fields, cards, routes, settings of a rewrite, facts about a user."""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# What marks a question about a procedure, intents with their routes, what a message tells about its author.
PROCEDURE = "补办|办理|申请|报名|流程|步骤|手续|怎么办|如何办理|怎么做|需要什么材料|材料|多久|多长时间|在哪办|哪里办|费用是多少"
ROUTES = {"knowledge_query": "rag", "general_chat": "chat", "complex_task": "agent", "calculation_task": "agent"}
PROFILE = {
    "name": (r"我叫(.{2,8})[，。！？\s]|我是(.{2,8})[，。！？\s]?同学", 2, ""),
    "studentId": (r"(?<![0-9A-Za-z_])(\d{10,12})(?![0-9A-Za-z_])", 1, ""),
    "college": (r"(?:我是|我在|在|于)?(.{2,6})学院", 1, "学院"),
    "major": (r"专业是(\S{2,20})|(\S{2,20})专业", 2, ""),
}
PREFERENCE = "我喜欢|我偏好|我习惯|请用|请以|我更(喜欢|倾向|愿意)|我不喜欢|我不爱|不要|别给"
SPECIFIC = r"\d{4}[-/]\d{2}|成绩|课表|考试|学分|绩点|GPA|教室|图书馆"
STAGE_LABELS = {"embedding": "向量化", "milvus_search": "向量检索", "child_select": "子句精排", "rerank": "Rerank 重排", "parent_child": "父段落组装", "llm": "LLM 生成", "document_check": "文档检查", "total": "总耗时"}
# End of fixed values.


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def asks_procedure(query: Column) -> Column:
    """Whether a question asks how something is done."""
    return F.coalesce(query, F.lit("")).rlike(PROCEDURE)


def json_part(reply: Column) -> Column:
    """From the first opening to the last closing brace of a reply; null without them."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def procedure_card(reply: Column) -> Column:
    """struct(summary, steps, materials, location, duration, notes) from the JSON in a reply, fenced or bare.

    Steps need a title or a detail, materials a text. Null where there is no JSON or the card would say nothing.
    """
    shape = "summary string, steps array<struct<title string, detail string>>, materials array<string>, location string, duration string, notes string"
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))

    def tidy(card: Column) -> Column:
        steps = F.transform(F.filter(card["steps"], lambda s: filled(s["title"], s["detail"]).isNotNull()), lambda s: F.struct(said(s["title"]).alias("title"), said(s["detail"]).alias("detail")))
        materials = F.filter(F.transform(card["materials"], said), lambda m: m != "")
        return F.struct(
            F.coalesce(card["summary"], F.lit("")).alias("summary"), F.coalesce(steps, F.array().cast("array<struct<title string, detail string>>")).alias("steps"),
            F.coalesce(materials, F.array().cast("array<string>")).alias("materials"), filled(card["location"]).alias("location"), filled(card["duration"]).alias("duration"), filled(card["notes"]).alias("notes"),
        )

    def useful(card: Column) -> Column:
        return (F.size(card["steps"]) > 0) | (F.size(card["materials"]) > 0) | card["location"].isNotNull() | card["duration"].isNotNull()

    # Each step is the only element of an array, so that the next one has its value and does not work it out anew for every field.
    fenced = F.transform(F.array(reply), lambda r: F.struct(r.alias("reply"), F.regexp_extract(F.trim(r), r"(?s)```(?:json)?\s*(.*?)```", 1).alias("fenced")))
    cards = F.transform(fenced, lambda x: F.from_json(json_part(F.when(x["fenced"] != "", x["fenced"]).otherwise(x["reply"])), shape))
    return F.get(F.filter(F.transform(cards, tidy), useful), F.lit(0))


def reply_intent(reply: Column, fallback: Column) -> Column:
    """struct(intent, route, confidence) from the JSON of a classifying reply; ``fallback`` (such a struct) where it has none that parses.

    Unknown intents count as chat, a missing or zero confidence as 0.5.
    """
    part = json_part(reply)
    parsed = F.try_parse_json(part)
    told = F.get_json_object(part, "$.intent")
    intent = F.when(told.isin(*ROUTES), told).otherwise("general_chat")
    route = F.element_at(F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair]), intent)
    sure = F.get_json_object(part, "$.confidence").try_cast("double")
    return F.when(parsed.isNotNull(), F.struct(intent.alias("intent"), route.alias("route"), F.when(sure != 0, sure).otherwise(0.5).alias("confidence"))).otherwise(fallback)


def message_text(*fields: Column) -> Column:
    """The text of a message: the first of several fields that is not null, trimmed; empty without any."""
    return F.trim(F.coalesce(*fields, F.lit("")))


def message_role(role: Column) -> Column:
    """``assistant`` and missing roles as ``model``."""
    return F.when(role == "assistant", "model").otherwise(F.coalesce(filled(role), F.lit("model")))


def embedding_parts(plain: Column, dense: Column, embedding: Column, sparse: Column, sparse_vector: Column) -> Column:
    """struct(dense, sparse) of a vector that came as a plain array, as ``dense`` or as ``embedding`` with its terms; null for none of them."""
    none = F.create_map().cast("map<int,double>")
    other = F.when(dense.isNotNull(), F.coalesce(sparse, none)).otherwise(F.coalesce(sparse, sparse_vector, none))
    return F.when(F.coalesce(plain, dense, embedding).isNotNull(), F.struct(F.coalesce(plain, dense, embedding).alias("dense"), F.when(plain.isNotNull(), none).otherwise(other).alias("sparse")))


def rewrite_key(query: Column, history: Column) -> Column:
    """What a rewritten question is remembered by: the question, and role and first 100 characters of the last six turns; null without turns."""
    last = F.slice(history, -F.least(F.size(history), F.lit(6)), 6)
    turns = F.transform(last, lambda t: F.concat(t["role"], F.lit(":"), F.substring(F.coalesce(t["content"], F.lit("")), 1, 100)))
    return F.when(F.size(history) > 0, F.concat(F.lower(F.trim(F.coalesce(query, F.lit("")))), F.lit("|"), F.array_join(turns, "|")))


def accepted_rewrite(query: Column, rewritten: Column) -> Column:
    """A rewritten question without its quotes; null under two characters or where nothing changed."""
    clean = F.regexp_replace(F.trim(rewritten), '^["「『]|["」』]$', "")
    return F.when((F.length(clean) >= 2) & (clean != F.trim(query)), clean)


def profile_facts(message: Column) -> Column:
    """array of struct(field, value): what a message tells about its author, by the rules above."""

    def fact(field: str, pattern: str, groups: int, suffix: str) -> Column:
        value = filled(*[F.regexp_extract(message, pattern, i + 1) for i in range(groups)])
        return F.when(value.isNotNull(), F.struct(F.lit(field).alias("field"), F.concat(value, F.lit(suffix)).alias("value")))

    return F.array_compact(F.array(*[fact(name, *rule) for name, rule in PROFILE.items()]))


def memories(message: Column, reply: Column) -> Column:
    """array of struct(type, content, confidence): question and answer where the answer (31 to 2999 characters) has data in it, and preferences."""
    said = F.coalesce(message, F.lit(""))
    entry = lambda kind, content, sure: F.struct(F.lit(kind).alias("type"), content.alias("content"), F.lit(sure).alias("confidence"))
    answered = F.concat(F.lit("用户问："), said, F.lit("\n回答："), F.substring(reply, 1, 500))
    useful = (F.length(reply) > 30) & (F.length(reply) < 3000) & reply.rlike(SPECIFIC)
    return F.array_compact(F.array(F.when(useful & (said != ""), entry("qa", answered, 0.7)), F.when(said.rlike(PREFERENCE), entry("preference", said, 0.6))))


def stage_label(name: Column) -> Column:
    """The label of a stage; its name where it has none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STAGE_LABELS.items() for x in pair]), name), name)


def percent(value: Column) -> Column:
    """A share as per cent within 0 and 100; 0 for what is no finite number."""
    number = value.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(100.0), number * 100))).otherwise(0.0)


def unit_score(value: Column) -> Column:
    """A score within 0 and 1; 0 for what is no finite number."""
    return percent(value) / 100


def keyword_recall(truth: Column, answer: Column) -> Column:
    """The share of the truth's Latin words, runs of up to four CJK characters and numbers, repeats counted, that the answer holds; 0 without either."""
    words = F.transform(F.regexp_extract_all(truth, F.lit("([a-zA-Z]{2,}|[一-鿿]{1,4}|\\d+)")), lambda w: F.lower(w))
    low = F.lower(answer)
    found = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.when((truth != "") & (answer != "") & (F.size(words) > 0), found / F.size(words)).otherwise(0.0)


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_NAMED = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "abs": abs, "log": math.log, "exp": math.exp, "floor": math.floor, "ceil": math.ceil, "round": round}
_CONSTANTS = {"pi": math.pi, "e": math.e}


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return float(node.value)
    if isinstance(node, ast.Name):
        return _CONSTANTS[node.id]
    if isinstance(node, ast.BinOp):
        return _BINARY[type(node.op)](_value(node.left), _value(node.right))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        return -_value(node.operand) if isinstance(node.op, ast.USub) else _value(node.operand)
    if isinstance(node, ast.Call) and not node.keywords:
        return float(_NAMED[node.func.id](*map(_value, node.args)))
    raise ValueError("not arithmetic")


def _calculated(expression: str | None) -> float | None:
    """The value of an expression; None for what is no arithmetic, is longer than 200 characters or has no finite value."""
    if not expression or len(expression) > 200:
        return None
    try:
        value = _value(ast.parse(expression.strip().replace("^", "**"), mode="eval").body)
        return value if math.isfinite(value) else None
    except (ValueError, TypeError, KeyError, AttributeError, ArithmeticError, SyntaxError, RecursionError, MemoryError):
        return None


@F.pandas_udf(DoubleType())
def calculate(expression: pd.Series) -> pd.Series:
    """Arithmetic in text (four operations, powers, roots, trigonometry); null for what has no finite value."""
    return expression.map(_calculated).astype("float64")
