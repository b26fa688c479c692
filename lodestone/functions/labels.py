"""Codes and the labels, tones, marks and payloads that belong to them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ITEM_TYPES = {"question": "题目", "section": "板块", "knowledge": "知识点", "answer": "作答"}
STATUSES = {"suspected": "疑似错题", "confirmed": "已确认", "incomplete": "未完成", "corrected": "已订正", "mastered": "已掌握", "ignored": "已忽略"}
REVIEW_STATES = {"queued": "待复习", "scheduled": "已安排", "reviewing": "复习中", "done": "本轮已复习", "mastered": "长期掌握", "ignored": "已忽略"}
STATUS_TONES = {"mastered": "ok", "ignored": "muted", "corrected": "warn", "confirmed": "warn"}
REVIEW_TONES = {"mastered": "ok", "ignored": "muted", "scheduled": "warn", "reviewing": "warn"}
ACTIONS = {"confirm": ("confirmed", "queued"), "ignore": ("ignored", "ignored"), "corrected": ("corrected", "queued"), "mastered": ("mastered", "mastered")}
LIFECYCLE = {"resolved": "mastered"}
VERDICTS = {"correct": "correct", "wrong": "wrong", "partial": "partial"}


def coded(x: Column, names: Mapping[str, str], default: Column | str) -> Column:
    """The name of a code; the default for codes without."""
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.coalesce(F.try_element_at(table, x), F.lit(default) if isinstance(default, str) else default)


def label(x: Column, names: Mapping[str, str], default: str) -> Column:
    """The name of a code, else the code itself, else the default."""
    return coded(x, names, F.coalesce(F.nullif(x, F.lit("")), F.lit(default)))


def grade_mark(gradable: Column, verdict: Column) -> Column:
    return F.when(~F.coalesce(gradable, F.lit(False)), F.lit("uncertain")).otherwise(coded(verdict, VERDICTS, "uncertain"))


def answer_lines(qtype: Column, options: Column, blanks: Column) -> Column:
    """Lines for answers on a blank sheet: none where options are printed, one for each blank, else by type."""
    return F.when((qtype == "选择题") & (F.coalesce(F.size(options), F.lit(0)) > 0), 0).when(F.coalesce(blanks, F.lit(0)) > 0, blanks).when(qtype == "口算题", 1).when(qtype == "作文题", 12).otherwise(4)
