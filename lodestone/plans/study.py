"""Composite queries over study records: noise cleanup, question sets, browsing, prompts and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import hashes
from lodestone.functions.text import NOISE_MARKERS, any_of, strip
from lodestone.operators.filters import where_contains, where_equal
from lodestone.operators.matching import alike_in_place, first_wins, firsts, greedy_first, near_before
from lodestone.operators.ranking import page
from lodestone.operators.shared import written


def noise(columns: list[str], markers: tuple[str, ...] = NOISE_MARKERS) -> Column:
    """Whether any of the columns holds any of the markers."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | any_of(F.col(c), markers)
    return hit


def cleanup_targets(mistakes: DataFrame, *, keep_observation: bool = False, columns: tuple[str, ...] = ("title", "evidence", "error_reason", "question_text"), markers: tuple[str, ...] = NOISE_MARKERS) -> DataFrame:
    """Noise, and unless kept what was observed and is no candidate."""
    target = noise([c for c in columns if c in mistakes.columns], markers)
    if not keep_observation:
        target = target | ((F.col("detection_method") == "observation") & (F.coalesce("status", F.lit("")) != "candidate"))
    return mistakes.where(target)


def question_set(questions: DataFrame, keys: list[str], order: list[str], stem: str = "stem", most: int = 3) -> DataFrame:
    """Questions kept of those that repeat by fingerprint or near SimHash, first ones first; blank stems go.

    Fingerprints are made first and equal ones dropped, by groups that combine before the shuffle; only what is left is hashed.
    """
    return greedy_first(written(distinct_stems(questions, keys, order, stem), "stems"), keys, order, "simhash", most)


def distinct_stems(questions: DataFrame, keys: list[str], order: list[str], stem: str = "stem") -> DataFrame:
    """The first question of each fingerprint, with ``fingerprint``, ``stem_length`` (normalised) and ``simhash``; blank stems go."""
    sound = questions.where(strip(F.coalesce(F.col(stem), F.lit(""))) != "")
    first = firsts(sound.withColumn("fingerprint", hashes.fingerprint(F.col(stem))), [*keys, "fingerprint"], order)
    plain = hashes.normalized(F.col(stem))
    # Not spread first: to count the pieces of what is grouped, Spark runs the whole grouping once more.
    return first.withColumn("stem_length", F.length(plain)).withColumn("simhash", hashes.simhash(plain))


def illustrated_question_set(questions: DataFrame, keys: list[str], order: list[str], stem: str = "stem", *, crop: str = "crop_hash", box: str = "box", most: int = 3, short: int = 12, crop_most: int = 5, near: float = 0.05) -> DataFrame:
    """Questions kept where short stems are told apart by their picture and place; first ones win.

    A question goes if an earlier one of its group has its fingerprint; or, if its normalised stem has ``short`` characters or
    more, if one that stays has a SimHash within ``most`` bits; or, if it is shorter, if one that stays has a crop hash within
    ``crop_most`` bits and its box (a struct ``x, y, w, h``) has its centre within ``near`` on both axes. Blank stems go; rows
    without a crop hash or a box are alike by nothing but the text. Out: the columns given and ``fingerprint, stem_length,
    simhash``. The bounds of crop and place are our own.

    Before the joins, equal SimHashes of long stems and equal crops in equal boxes of short ones are dropped but the first:
    whatever makes the first one go makes the others go.
    """
    stems = distinct_stems(questions, keys, order, stem)
    long = F.col("stem_length") >= short
    text, picture = F.concat(F.lit("t"), F.col("simhash").cast("string")), F.concat(F.lit("c"), F.col(crop).cast("string"), *[F.concat(F.lit(":"), F.col(f"{box}.{c}").cast("string")) for c in "xywh"])
    # What has neither is like nothing, itself included: its place in the order marks it.
    mark = F.coalesce(F.when(long, text).otherwise(picture), F.concat(F.lit("o"), F.to_json(F.struct(*order))))
    columns = [*questions.columns, "fingerprint", "stem_length", "simhash"]
    distinct = written(firsts(stems.withColumn("_mark", mark), [*keys, "_mark"], order).select(*columns), "questions")
    centre = lambda a, b: F.col(f"{box}.{a}") + F.col(f"{box}.{b}") / 2
    nodes = distinct.select("*", F.struct(*keys).alias("g"), F.struct(*order).alias("o"), centre("x", "w").alias("cx"), centre("y", "h").alias("cy"))
    conflicts = near_before(nodes, "simhash", most, long, 1).unionByName(alike_in_place(nodes, crop, crop_most, near, ~long))
    gone = first_wins(conflicts).withColumnRenamed("a", "o")
    return nodes.join(gone, ["g", "o"], "left_anti").select(*columns)


def browse(items: DataFrame, sessions: DataFrame, *, kind: str, number: int, size: int, order: list[Column], equal: dict | None = None, contains: dict | None = None) -> DataFrame:
    """A page of items with their session's title and status. Facets that a kind does not have are left out."""
    absent = {"learning": ("status", "error_type"), "mistake": ("item_type",)}.get(kind, ())
    chosen = where_equal(items.where(F.col("kind") == kind), **{k: v for k, v in (equal or {}).items() if k not in absent})
    chosen = where_contains(chosen, **{k: v for k, v in (contains or {}).items() if k not in absent})
    return page(chosen, number, size, *order).join(sessions, "session_id", "left")


def effective_prompts(defaults: DataFrame, overrides: DataFrame, legacy: DataFrame, account: str) -> DataFrame:
    """``key, template, is_custom``: the account's override, else the legacy one, else the default."""
    mine = overrides.where(F.col("account_id") == account).select("key", F.col("template").alias("_mine"))
    old = legacy.select("key", F.col("template").alias("_old"))
    joined = defaults.join(mine, "key", "left").join(old, "key", "left")
    return joined.select("key", F.coalesce("_mine", "_old", "template").alias("template"), F.coalesce("_mine", "_old").isNotNull().alias("is_custom"))
