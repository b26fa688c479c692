"""Text hygiene: normalisation, tolerant JSON, truncation, templates and signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of facts, words of observation noise, signals of a settings request.
KINDS = ("preference", "mistake", "goal", "habit", "fact")
NOISE_MARKERS = (
    "题目耗时线索", "耗时线索", "差异题目", "无新增", "画面", "界面", "屏幕", "截图", "静止", "动作证据", "阅读动作", "工作台", "持续显示", "停留", "翻页",
    "在场", "未检测到", "秒拍摄", "无法判定具体题目耗时", "连续", "疑似正在",
)
PREFERENCE_SIGNALS = ("以后", "从现在起", "讲题", "讲解", "辅导", "口气", "风格", "啰嗦", "简洁", "提示", "别老", "别再", "不要再", "记住我喜欢", "偏好")
TOGGLE_VERBS = ("打开", "开启", "关掉", "关闭", "停用", "启用", "别用", "用上", "带上")
TOGGLE_NOUNS = ("上下文", "记忆", "长期记忆", "错题", "历史", "知识点", "画面", "观察", "策略", "调试")

#: White space as Python's strip sees it, of what occurs in text.
SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same, one by one.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space at both ends. Their two characters are looked at first, as most texts have none there."""
    ends = [F.lit(SPACES).contains(F.substring(x, i, 1)) for i in (1, -1)]
    return F.when(ends[0] | ends[1], F.btrim(x, F.lit(SPACES))).otherwise(x)


def kind(x: Column) -> Column:
    """Stripped and lower-cased; anything but a known kind is ``fact``."""
    k = F.lower(strip(F.coalesce(x, F.lit(""))))
    return F.when(k.isin(*KINDS), k).otherwise(F.lit("fact"))


def missing(x: Column) -> Column:
    """The empty text as null."""
    return F.nullif(x, F.lit(""))


def any_of(x: Column, markers: tuple[str, ...]) -> Column:
    """Whether the text holds any of the markers; null counts as empty."""
    return F.coalesce(x, F.lit("")).rlike("|".join("\\Q" + m + "\\E" for m in markers))


def json_array(x: Column, schema: str) -> Column:
    """Objects of the outermost JSON array in a text with fences or prose around it; empty where there is none.

    ``schema`` is that of one object, as DDL. Entries that are no objects go.
    """
    inner = F.regexp_extract(F.coalesce(x, F.lit("")), r"(?s)\[.*\]", 0)
    parts = F.from_json(inner, "array<string>")
    objects = F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: p.startswith("{"))
    return F.transform(objects, lambda p: F.from_json(p, schema))


def whole_json(x: Column) -> Column:
    """A text that is one JSON value and nothing else, as a VARIANT; else null.

    In brackets, as the reader would stop after the first value and not look at what follows it.
    """
    one = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
    return F.when(F.try_variant_get(one, "$[1]", "variant").isNull(), F.try_variant_get(one, "$[0]", "variant"))


def payload(x: Column) -> Column:
    """The JSON object that a text is, fences aside, or else holds, as a VARIANT with whatever fields it has; else null.

    The whole text is read first. If it is JSON but no object, there is none; only if it is no JSON, what stands from its first
    brace to its last is read. An object that names a field twice is no JSON here.
    """
    bare = F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"^```[A-Za-z]*\s*|\s*```$", "")
    whole = whole_json(bare)
    inner = whole_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    found = F.when(whole.isNotNull(), whole).otherwise(inner)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def field(variant: Column, name: str, kind: str = "string") -> Column:
    """A field of a payload, read as ``kind``; null where it is missing or cannot be read so."""
    return F.try_variant_get(variant, f"$.{name}", kind)


def json_object(x: Column, schema: str) -> Column:
    """The object of ``payload`` with the fields of ``schema`` only; null where there is none."""
    return F.from_json(F.to_json(payload(x)), schema)


def json_vector(x: Column) -> Column:
    """A JSON list of numbers as an array of doubles; null for anything else, an entry that is no number included."""
    found = whole_json(x)
    items = F.when(F.schema_of_variant(found).rlike("^ARRAY<(BIGINT|DOUBLE|DECIMAL.*|FLOAT)>$"), F.try_variant_get(found, "$", "array<double>"))
    return F.when(F.forall(items, lambda v: v.isNotNull()), items)


def number_or(x: Column, default: float = 0.5) -> Column:
    """A number clamped to [0, 1]; what is none counts as ``default``."""
    y = F.coalesce(x.try_cast("double"), F.lit(default))
    return F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))


def list_or_empty(x: Column) -> Column:
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def safe_id(x: Column, default: str = "local") -> Column:
    """Letters, digits, dot, dash and underscore; others become ``_``; 120 characters; the default if nothing is left."""
    y = F.substring(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^A-Za-z0-9_.-]", "_"), 1, 120)
    return F.when(y == "", F.lit(default)).otherwise(y)


def short_id(x: Column) -> Column:
    return F.substring(F.coalesce(x, F.lit("")), 1, 8)


# The note of an omission around the number of characters left out, and the share of the room that the head has.
OMITTED = ("\n...[已按 token 预算截断约 ", " 字]...\n")
HEAD_SHARE = 0.72


def head_tail(x: Column, most: int | Column) -> Column:
    """At most ``most`` characters: 72 % of what a note of the omission leaves from the head, the rest from the tail."""
    most = F.lit(most) if isinstance(most, int) else most

    def cut(p: Column) -> Column:
        text, size = p["text"], p["most"]
        marker = F.concat(F.lit(OMITTED[0]), (F.length(text) - size).cast("string"), F.lit(OMITTED[1]))
        room = size - F.length(marker)
        head = F.greatest(F.lit(1), F.floor(room * HEAD_SHARE).cast("int"))
        tail = F.greatest(F.lit(0), room - head)
        both = F.concat(F.regexp_replace(F.substring(text, F.lit(1), head), f"{SPACE}+$", ""), marker, F.regexp_replace(F.right(text, tail), f"^{SPACE}+", ""))
        return F.when(F.length(text) <= size, text).when((size <= 20) | (room <= 0), F.substring(text, F.lit(1), size)).otherwise(both)

    # Bound as a variable, the text is stripped once.
    return F.transform(F.array(F.struct(strip(F.coalesce(x, F.lit(""))).alias("text"), most.cast("int").alias("most"))), cut)[0]


# The context's limit in tokens and what of it is kept free, the fewest characters that a text is cut to and those it is
# cut to where tokens cannot be counted, the number of attempts, and how much shorter than in proportion a cut is.
CONTEXT_TOKENS, MARGIN_TOKENS, LEAST_TOKENS = 40_000, 2_048, 1_024
LEAST_CHARS, FALLBACK_CHARS, ATTEMPTS, SHORTER = 2_000, 16_000, 6, 0.82
BUDGET_NOTICE = "注意：后端已根据模型 token 上下文限制进一步压缩输入；未列出的细节不要编造，只基于可见证据概述；重复事实只保留一次。"


def budget_for(answer_tokens: int) -> int:
    """The tokens that a text may have if its answer may have ``answer_tokens``."""
    return max(LEAST_TOKENS, CONTEXT_TOKENS - answer_tokens - MARGIN_TOKENS)


def fit_to_budget(df: DataFrame, name: str, count: Callable[[Column], Column], budget: int, *, notice: str = BUDGET_NOTICE, rounds: int = ATTEMPTS, floor: int = LEAST_CHARS, fallback: int = FALLBACK_CHARS) -> DataFrame:
    """``df`` with the text ``name`` cut (``head_tail``) until it has at most ``budget`` tokens, and a notice before what was cut.

    ``count`` makes a column of tokens from a column of texts, and is asked about each cut anew; it may be a service. A cut has the length
    times the ratio of budget to tokens times 0.82, at least ``floor`` characters and at least one fewer than before; after
    ``rounds`` cuts, or at ``floor`` characters, it stays as it is. Where tokens cannot be counted (null) at first, more than ``fallback``
    characters are cut to as many; later, the text stays. A null text is empty. Columns named ``_n`` and ``_on`` are replaced.
    """
    intro = F.lit(notice + "\n\n")
    marked = lambda x: F.when(x.startswith(notice), x).otherwise(F.concat(intro, x))
    x, n = F.col(name), F.col("_n")
    out = df.withColumn(name, F.coalesce(name, F.lit(""))).withColumn("_n", count(x).cast("long"))
    uncounted = n.isNull() & (F.length(x) > fallback)
    out = out.withColumn("_on", n.isNotNull()).withColumn(name, F.when(uncounted, F.concat(intro, head_tail(x, fallback))).otherwise(x))
    for k in range(rounds):
        out = out.withColumn("_on", F.coalesce(F.col("_on") & (n > budget) & (F.length(x) > floor), F.lit(False)))
        ratio = F.lit(float(budget)) / F.greatest(n, F.lit(1))
        chars = F.least(F.greatest(F.lit(floor), F.floor(F.length(x) * ratio * SHORTER).cast("int")), F.length(x) - 1)
        out = out.withColumn(name, F.when(F.col("_on"), F.transform(F.array(head_tail(x, chars)), marked)[0]).otherwise(x))
        if k + 1 < rounds:  # what was not cut is not counted again
            out = out.withColumn("_n", F.when(F.col("_on"), count(x).cast("long")).otherwise(n))
    return out.drop("_n", "_on")


def render(template: Column, values: dict[str, Column], default: Column | None = None) -> Column:
    """``{name}`` filled in, nulls as empty; a template with unknown names gives way to the default one."""

    def filled(t: Column) -> Column:
        for name, value in values.items():
            t = F.replace(t, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
        return t

    if default is None:
        return filled(template)
    return F.when(F.size(unknown_names(template, list(values))) == 0, filled(template)).otherwise(filled(default))


def unknown_names(template: Column, names: list[str]) -> Column:
    """Names in braces that the template may not use."""
    return F.array_except(F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1)), F.array(*map(F.lit, names)))


def question_line(x: Column) -> Column:
    """Whether a line starts with a question number."""
    return F.coalesce(x, F.lit("")).rlike(r"^\s*(第)?[0-9一二三四五六七八九十]+\s*[、，,.\)）题]")


def looks_like_settings(x: Column) -> Column:
    """A preference signal, or a toggle verb together with a toggle noun."""
    return any_of(x, PREFERENCE_SIGNALS) | (any_of(x, TOGGLE_VERBS) & any_of(x, TOGGLE_NOUNS))


def proposal_id(account: Column, token: Column) -> Column:
    """``ip_<account>_<token>``, the account with ``_`` for all but letters, digits, dash and underscore; without one ``local``."""
    safe = F.regexp_replace(F.coalesce(missing(account), F.lit("local")), "[^a-zA-Z0-9_-]", "_")
    return F.concat(F.lit("ip_"), safe, F.lit("_"), token)


def owner_of(proposal_id: Column) -> Column:
    """The account in a proposal's id: what stands between ``ip_`` and the last underscore; else empty."""
    return F.coalesce(F.regexp_extract(proposal_id, r"(?s)^ip_(.*)_[^_]*$", 1), F.lit(""))


def location(ref: Column, page: Column, question: Column) -> Column:
    """The location text, else page and question."""
    return F.coalesce(missing(ref), missing(F.concat_ws(" ", missing(page), missing(question))), F.lit(""))


def actionable(flag: Column, has_figure: Column, text: Column) -> Column:
    return flag & (has_figure | (F.length(text) >= 50))
