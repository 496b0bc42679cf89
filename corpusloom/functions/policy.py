"""Column expressions for intents, slots, answers, confidence, refusal and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT, AnswerPolicy, Resilience
from corpusloom.functions.text import any_of, ascii_digits, strip

# Word lists and messages that decide results.
SUMMARY_WORDS = ("报表", "总结", "汇总", "概括", "核心观点", "主要内容", "奋斗", "查询报表", "财务报表")
CALC_WORDS = ("增长", "同期", "比例", "谁更多", "差值", "计算", "同比", "环比")
INTENTS = ("FACT", "CALC", "SUMMARY")
REFUSAL_WORDS = ("无法", "不知道", "没有找到", "未找到", "不清楚", "无法确定")
CITATION = r"(?i)\[Chunk\s+(\p{Nd}+)\]"
REWRITE_SUFFIX = " 详细信息"
GROWTH_BY_ZERO = "增长率计算时除数（基期）不能为零，请检查数据。"
RATIO_BY_ZERO = "占比计算时除数（总量）不能为零，请检查数据。"
#: intent, slot, required, question, order
SLOTS = (
    ("CALC", "product", True, "请问您查的是哪个产品？", 1),
    ("CALC", "date", False, "请问您要查询哪个时间或年份？", 2),
    ("SUMMARY", "year", True, "请问您要查询哪一年（年份）？", 1),
    ("SUMMARY", "dept", True, "请问您要查询哪个部门？", 2),
    ("SUMMARY", "date", False, "请问您要查询哪个时间或年份？", 3),
    ("SUMMARY", "department", False, "请问您要查询哪个部门？", 4),
    ("SUMMARY", "product", False, "请问您要总结的是哪个产品？", 5),
)
SLOT_ALIASES = {"dept": "department", "year": "date"}


def intent(query: Column, other: Column | None = None) -> Column:
    """By keyword, summaries first; ``other`` decides the rest, FACT if there is none."""
    q = strip(query)
    rest = F.lit("FACT") if other is None else F.coalesce(other, F.lit("FACT"))
    return F.when(q.isNull() | (q == ""), "FACT").when(any_of(q, SUMMARY_WORDS), "SUMMARY").when(any_of(q, CALC_WORDS), "CALC").otherwise(rest)


def parse_intent(raw: Column) -> Column:
    """The intent a model's text names: its first word, else a prefix or a word of it, else FACT."""
    text = F.upper(strip(raw))
    split = F.split(text, r"\s+")
    out = F.when(F.element_at(split, 1).isin(*INTENTS), F.element_at(split, 1))
    for name in INTENTS:
        out = out.when(text.startswith(name) | F.array_contains(split, name), name)
    return F.coalesce(out, F.lit("FACT"))


def citations(answer: Column) -> Column:
    """Cited chunk ids in order, repeats kept; null stands for a number that no id can have, which counts as a citation of nothing."""
    return F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda x: ascii_digits(x).try_cast("long"))


def confidence(answer: Column) -> Column:
    n = F.size(citations(answer))
    size = F.length(strip(answer))
    cited = F.when(n > 0, 0.3 + F.least(n * 0.05, F.lit(0.15))).otherwise(-0.2)
    sized = F.when(size < 10, -0.3).when(size > 50, 0.1).otherwise(0.0)
    refused = F.when(any_of(answer, REFUSAL_WORDS), -0.2).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + cited + sized + refused)), 6)


def is_refused(answer: Column, policy: AnswerPolicy = DEFAULT.policy) -> Column:
    low = F.lit(policy.refuse_if_low_confidence) & (confidence(answer) < policy.min_confidence)
    uncited = F.lit(policy.cite_required) & (F.size(citations(answer)) == 0)
    return F.coalesce((strip(answer) == "") | low | uncited, F.lit(True))


def calculate(op: Column, a: Column, b: Column) -> Column:
    """growth (a - b) / b, diff a - b, ratio a / b; null for division by zero or another operation."""
    a, b = a.cast("double"), b.cast("double")
    by = F.when(b != 0, b)
    return F.when(op == "growth", (a - b) / by).when(op == "diff", a - b).when(op == "ratio", a / by)


def calculation_problem(op: Column, b: Column) -> Column:
    unknown = F.concat(F.lit("未知运算类型: "), op, F.lit("，支持 growth / diff / ratio"))
    return F.when((op == "growth") & (b == 0), GROWTH_BY_ZERO).when((op == "ratio") & (b == 0), RATIO_BY_ZERO).when(~op.isin("growth", "diff", "ratio"), unknown)


def task_id(user: Column, query: Column, tenant: Column | None = None) -> Column:
    """Hash of user and query; with a tenant, equal requests of two tenants differ."""
    parts = [F.coalesce(user, F.lit(0)).cast("string"), strip(query)]
    return F.sha2(F.concat_ws("|", *([] if tenant is None else [tenant.cast("string")]), *parts), 256)


def rewrites(query: Column, given: Column, limit: int = 3) -> Column:
    """Up to ``limit`` queries: the given ones, the query itself, and a variant where that is among them."""
    given = F.coalesce(given, F.array().cast("array<string>"))
    first = F.when(F.size(given) == 0, F.array(query)).otherwise(given)
    with_query = F.when(F.array_contains(first, query), first).otherwise(F.array_append(first, query))
    varied = F.when(F.size(with_query) < limit, F.array_append(with_query, F.concat(query, F.lit(REWRITE_SUFFIX)))).otherwise(with_query)
    return F.slice(F.when(F.size(first) >= limit, first).otherwise(varied), 1, limit)


def clean_slots(slots: Column) -> Column:
    """Stripped values of known slots; empty ones go."""
    known = sorted({s[1] for s in SLOTS})
    return F.map_filter(F.transform_values(slots, lambda k, v: strip(v)), lambda k, v: k.isin(*known) & v.isNotNull() & (v != ""))


def with_aliases(slots: Column) -> Column:
    """dept from department and year from date where they are missing."""
    names = F.array(*[F.lit(x) for x in SLOT_ALIASES])
    filled = F.map_from_entries(
        F.array(*[F.struct(F.lit(name).alias("k"), F.coalesce(F.try_element_at(slots, F.lit(name)), F.try_element_at(slots, F.lit(alias))).alias("v")) for name, alias in SLOT_ALIASES.items()])
    )
    return F.map_concat(F.map_filter(slots, lambda k, v: ~F.array_contains(names, k)), F.map_filter(filled, lambda k, v: v.isNotNull()))


def missing_slots(intent_name: Column, slots: Column) -> Column:
    """Required slots without a value, in the order of the registry."""
    out = F.array().cast("array<string>")
    for name in INTENTS:
        required = [s[1] for s in sorted(SLOTS, key=lambda s: s[4]) if s[0] == name and s[2]]
        if required:
            absent = F.filter(F.array(*[F.lit(x) for x in required]), lambda x: F.coalesce(F.try_element_at(slots, x), F.lit("")) == "")
            out = F.when(intent_name == name, absent).otherwise(out)
    return out


def slot_question(intent_name: Column, slot: Column) -> Column:
    out = F.concat(F.lit("请提供「"), slot, F.lit("」相关信息。"))
    for i, name, _, question, _ in SLOTS:
        out = F.when((intent_name == i) & (slot == name), question).otherwise(out)
    return out


def error_kind(error: Column, status: Column) -> Column:
    """timeout, rate_limit, 5xx, parse_error or fallback."""
    return F.when(error.isin("timeout", "connect_timeout"), "timeout").when(status == 429, "rate_limit").when(status.between(500, 599), "5xx").when(error == "parse", "parse_error").otherwise("fallback")


def is_retryable(error: Column, status: Column) -> Column:
    return F.coalesce(error.isin("timeout", "connect_timeout", "connection"), F.lit(False)) | F.coalesce((status == 429) | status.between(500, 599), F.lit(False))


def error_message(message: Column) -> Column:
    """What a user is told, by what the error says."""
    low = F.lower(message)
    says = lambda *w: F.lit(False) if not w else any_of(low, w)
    return (
        F.when(says("circuit", "熔断"), "服务暂时不可用，请稍后重试")
        .when(says("connection", "连接"), "数据库连接失败，请稍后重试")
        .when(says("timeout"), "请求超时，请稍后重试")
        .when(says("validation", "pydantic"), "请求参数验证失败，请检查输入")
        .otherwise("处理失败，请稍后重试")
    )


def embedding_error(message: Column) -> Column:
    """Why a question has no vector and is searched by words alone: no_model, no_access, timeout or other; null without an error."""
    low = F.lower(message)
    kinds = F.when(any_of(low, ("404", "not found")), "no_model").when(any_of(low, ("401", "unauthorized")), "no_access").when(F.contains(low, F.lit("timeout")), "timeout")
    return F.when(message.isNotNull(), F.coalesce(kinds, F.lit("other")))


def backoff(attempt: Column, resilience: Resilience = DEFAULT.resilience, jitter: Column | None = None) -> Column:
    """Seconds to wait after an attempt, doubled each time up to a maximum; ``jitter`` such as F.rand() comes on top."""
    wait = F.least(F.lit(resilience.backoff_multiplier) * F.pow(F.lit(2.0), attempt - 1), F.lit(resilience.backoff_max))
    return wait if jitter is None else wait + jitter


def labelled(ids: Column, content: Column) -> Column:
    """A context passage under the labels of its chunks."""
    return F.concat(F.array_join(F.transform(ids, lambda i: F.concat(F.lit("[Chunk "), i.cast("string"), F.lit("]"))), " "), F.lit("\n"), content)


def valid_request(query: Column, top_k: Column) -> Column:
    return F.coalesce(F.length(query).between(1, 1000) & top_k.between(1, 20), F.lit(False))
