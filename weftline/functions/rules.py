"""Ordered rules over text as one ``when`` chain: question types, routes, categories, error types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None) -> Column:
    """The name of the first rule (name, pattern) whose pattern is found in ``text``."""
    out = None
    for name, pattern in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def keyword_category(text: Column, keywords: Mapping[str, Sequence[str]], least: int = 2) -> Column:
    """The category with the most keywords in ``text`` (the first of several), null under ``least`` of them."""
    hits = F.array(*[F.struct(sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("hits"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, words) in enumerate(keywords.items())])
    best = F.array_max(hits)
    return F.when(best["hits"] >= least, best["name"])


# Patterns, word lists and numbers that decide which type, category or route a text gets.
QUESTION_TYPES = (
    ("authoritative", "教务|选课|学分|毕业|学位|补考|重修|转专业|奖学金|处分|成绩|GPA|考试|报名|申请|条件|要求|规定|政策|规则|流程|手续|办法|制度|资格|审核|审批"),
    ("factual", "多少|几个|哪些|何时|哪里|谁|电话|地址|网站|邮箱|号码|比例|率|面积|人数|成立于|建于"),
    ("knowledge", "什么是|解释|说说|区别|差异|不同|特点|特征|定义|概念|原理|方法|算法|为什么|如何|怎样|怎么|举例|说明|描述|理解|介绍|概述|总结|分类|组成|结构|功能|作用|优势|劣势|优缺点|比较|对比"),
)
TYPE_SETTINGS = {"authoritative": (0.50, 0.35, 0.70, 6), "knowledge": (0.25, 0.15, 0.40, 6), "factual": (0.40, 0.25, 0.55, 6), "general": (0.30, 0.20, 0.50, 6)}
CATEGORY_WORDS = {
    "学校概况": ("校训", "食堂", "宿舍", "社团", "校区", "图书馆", "报到", "开学", "学费", "奖学金", "校史", "地图", "一卡通", "军训", "转专业", "校车", "体育"),
    "专业课程": ("离散数学", "软件工程", "课程", "复习", "教材", "知识点", "算法", "数据结构", "组成原理", "计算机网络", "操作系统", "数据库", "编译", "期末", "课件", "作业", "考试"),
    "面试刷题": ("面试", "刷题", "CodeTop", "大厂", "offer", "笔试", "简历", "面经", "算法题", "八股", "手撕"),
    "AI学习": ("Agent", "RAG", "大模型", "LLM", "智能体", "提示词", "Prompt", "机器学习", "深度学习", "Embedding", "Rerank", "向量检索", "AIGC"),
}
GREETING = "(?i)^(你好|您好|嗨|哈喽|hello|hi|hey|在吗|早上好|中午好|下午好|晚上好|晚安|谢谢|感谢|多谢|再见|拜拜|bye|goodbye|辛苦了|好的|好的吧)[!！.。~～]?$"
MULTI_STEP = "(规划|制定.*计划|学习计划|复习计划|安排.*计划|时间线|综合.*分析|全面.*分析|权衡|利弊|对比.*(方案|计划)|哪个更适合|帮我计划|分步|一步一步)"
NUMERIC = r"(?i)\d|sqrt\s*\(|(?:sin|cos|tan|log|abs)\s*\(|\bpi\b"
CALCULATE = r"(?i)(算一下|计算|求值|等于多少|是多少|次方|平方|立方|平方根|开方|[+\-*/^×÷])"
ERROR_TYPES = (("timeout", "timeout|timed out|abort"), ("rate_limit", "rate|429|quota|limit"), ("vector_store", "milvus|vector|collection"), ("embedding", "embedding|transformer|model"), ("network", "network|econn|enotfound|socket|fetch"))
REFERRING = "^(这个|那个|它|它们|他|她|他们|她们|那|那些|这些|这|其|该|此)"
ELLIPTIC = "^(那|那.*呢|然后|还有|那.*吗|费用|条件|流程|要求|时间|地点|原因|结果|影响|区别)$"
REFUSAL = "没有检索到|资料不足|知识库中没有|无法回答"
HARD_REFUSAL = "无法回答|没有相关信息|无法提供|我不清楚|没有找到|抱歉"
ADVICE = "建议|咨询|查询"
DETAIL = "[0-9]{2,}|具体|分为|包括|例如"
# End of fixed values.


def question_type(query: Column, rules: Sequence[tuple[str, str]] = QUESTION_TYPES) -> Column:
    return first_match(F.coalesce(query, F.lit("")), rules, "general")


def type_settings(kind: Column) -> Column:
    """struct(base, low, high, cap) of a question type; unknown ones as general."""
    out = None
    for name, (base, low, high, cap) in TYPE_SETTINGS.items():
        value = F.struct(F.lit(base).alias("base"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(cap).alias("cap"))
        if name == "general":
            return value if out is None else out.otherwise(value)
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    raise AssertionError


def route(message: Column, knowledge: Sequence[str], greeting: str = GREETING, multi_step: str = MULTI_STEP, numeric: str = NUMERIC, calculate: str = CALCULATE) -> Column:
    """struct(intent, route, tool, confidence) of a message: greeting, several steps, calculation, knowledge, else chat."""
    text = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    told = lambda intent, way, tool, sure: F.struct(F.lit(intent).alias("intent"), F.lit(way).alias("route"), F.lit(tool).cast("string").alias("tool"), F.lit(sure).alias("confidence"))
    known = F.lit(False)
    for pattern in knowledge:
        known = known | text.rlike(pattern)
    return (
        F.when(text.rlike(greeting), told("general_chat", "chat", None, 0.95))
        .when(text.rlike(multi_step), told("complex_task", "agent", None, 0.75))
        .when(text.rlike(numeric) & text.rlike(calculate), told("calculation_task", "agent", "calculate", 0.9))
        .when(known, told("knowledge_query", "rag", None, 0.85))
        .otherwise(told("general_chat", "chat", None, 0.3))
    )


def error_type(message: Column) -> Column:
    return first_match(F.lower(F.coalesce(message, F.lit(""))), ERROR_TYPES, "unknown")


def needs_rewrite(query: Column, has_user_turn: Column) -> Column:
    """Whether a follow-up question leans on what came before: very short, beginning with a pronoun, or elliptic."""
    q = F.trim(F.coalesce(query, F.lit("")))
    return has_user_turn & ((F.length(q) < 5) | q.rlike(REFERRING) | q.rlike(ELLIPTIC) | (q.rlike("^.+呢$") & (F.length(q) < 8)))
