"""Benchmark decontamination through a positional inverted index of the training texts.

The index holds postings (text, position, term) of those terms that the test texts are looked up by. A test text of which
word s stands at position p of a training text lies on the diagonal p - s, so lists of two test words, each adjusted by its
offset, intersect where text, test text and diagonal are equal. Each window of a test text is looked up by its rarest terms;
what survives is compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, sized, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters and all that is not ASCII, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def tokenized(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, id, words``, written: the key is a number of the row's own, so rows that repeat an id stay apart."""
    return written(df.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("words")), "words")


def distinct_texts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different word lists ``item, words`` of test texts, and ``item, item_id``: the rows that have each."""
    lists = written(items.where(F.size("words") > 0).groupBy("words").agg(F.min("key").alias("item")).select("item", "words"), "items")
    members = items.join(lists, "words").select("item", F.col("id").cast("string").alias("item_id")).distinct()
    return lists, written(members, "members")


def occurrences_of(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: how often each of ``terms`` occurs in ``texts``. Terms that never occur have no row.

    Counts combine in each task; where the terms are few, others go before they are counted.
    """
    return texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n")).join(sized(terms), "term", "left_semi")


def windows(lists: DataFrame, frequency: DataFrame, size: int, rarest: int) -> DataFrame:
    """``item, start, length, anchors``: the windows of test texts that may occur, each with its rarest words.

    ``anchors`` is an array of ``n, m, s, term``, rarest first. Of equally rare ones those come first whose position s in the test
    text has the least remainder m by ``size``: any two neighbouring windows then mostly have the same, so there are few. A text
    shorter than a window is one. Windows with a term that occurs nowhere are left out.
    """
    placed = lists.select("item", F.posexplode("words").alias("s", "term")).join(frequency, "term", "left")
    placed = placed.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("s", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("w"))
    length = F.least(F.lit(size), F.size("w"))
    slices = placed.select("item", length.alias("length"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("start"))
    ranked = F.array_sort(F.transform(F.slice("w", F.col("start") + 1, F.col("length")), lambda x: F.struct(x["n"].alias("n"), (x["s"] % size).alias("m"), x["s"].alias("s"), x["term"].alias("term"))))
    found = slices.select("item", "start", "length", ranked.alias("r")).where(F.col("r")[0]["n"] > 0)
    return found.select("item", "start", "length", F.slice("r", 1, rarest).alias("anchors"))


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: ``key, pos, term`` of every occurrence of ``terms`` in ``texts``, positions from 0; written."""
    every = texts.select("key", F.posexplode("words").alias("pos", "term"))
    return written(every.join(sized(terms), "term", "left_semi").select("key", "pos", "term"), "postings")


def phrase_matches(texts: DataFrame, lists: DataFrame, size: int = 10, rarest: int = 2) -> DataFrame:
    """``key, item, start, length``: every window of a test text that stands in a training text from word ``start`` on.

    The offset-adjusted lists of a window's ``rarest`` terms are intersected first: hits are grouped by text, test text and
    diagonal, combined before the shuffle. A group with the anchors of some window is then compared word for word.
    """
    vocabulary = written(lists.select(F.explode("words").alias("term")).distinct(), "test-terms")
    sought = written(windows(lists, written(occurrences_of(texts, vocabulary), "frequencies"), size, rarest), "windows")
    anchors = written(sought.select("item", F.explode("anchors").alias("a")).select("item", F.col("a.s").alias("s"), F.col("a.term").alias("term")).distinct(), "anchors")
    index = postings(texts, written(anchors.select("term").distinct(), "anchor-terms"))

    hits = index.join(sized(anchors), "term").select("key", "item", (F.col("pos") - F.col("s")).alias("diagonal"), "s")
    crossed = hits.groupBy("key", "item", "diagonal").agg(F.collect_set("s").alias("at"))
    per_item = written(sought.groupBy("item").agg(F.collect_list(F.struct("start", "length", F.col("anchors.s").alias("s"))).alias("sought"), F.min(F.size("anchors")).alias("least")), "sought")
    live = F.filter("sought", lambda w: (F.col("diagonal") + w["start"] >= 0) & (F.size(F.array_except(w["s"], "at")) == 0))
    candidates = crossed.join(sized(per_item), "item").where(F.size("at") >= F.col("least")).select("key", "item", "diagonal", F.transform(live, lambda w: F.struct(w["start"].alias("start"), w["length"].alias("length"))).alias("live"))
    candidates = written(candidates.where(F.size("live") > 0).withColumn("live", F.array_sort("live")), "candidates")

    # The part of the training text beside the test text: from word `low` of the test text to the end of its last window.
    low = F.greatest(F.lit(0).cast("long"), -F.col("diagonal").cast("long")).cast("int")
    last = F.element_at("live", -1)
    beside = F.slice("words", F.col("diagonal") + low + 1, last["start"] + last["length"] - low)
    near = texts.select("key", "words").join(sized(candidates), "key").select("key", "item", "diagonal", "live", low.alias("low"), beside.alias("beside"))
    equal = F.filter("live", lambda w: F.slice("beside", w["start"] - F.col("low") + 1, w["length"]) == F.slice("words", w["start"] + 1, w["length"]))
    found = near.join(sized(lists), "item").select("key", "item", "diagonal", F.explode(equal).alias("w"))
    return found.select("key", "item", (F.col("diagonal") + F.col("w.start")).alias("start"), F.col("w.length").alias("length"))


def proximity_matches(texts: DataFrame, lists: DataFrame, within: int = 20, size: int = 10, rarest: int = 3) -> DataFrame:
    """``key, item, window, pos``: where the rarest terms of a window of a test text stand near each other in any order.

    ``pos`` is the position of the rarest one; each other one of the window's ``rarest`` different terms occurs at most
    ``within`` words from it. ``window`` is the window's start in the test text. Positions meet in stretches of ``within``
    words, so a task holds three stretches of a list at a time, however common a term is.
    """
    vocabulary = written(lists.select(F.explode("words").alias("term")).distinct(), "test-terms")
    sought = windows(lists, written(occurrences_of(texts, vocabulary), "frequencies"), size, size)
    terms = F.slice(F.array_distinct(F.transform("anchors", lambda a: a["term"])), 1, rarest)
    anchors = sought.select("item", F.col("start").alias("window"), terms.alias("t")).select("item", "window", F.size("t").alias("of"), F.posexplode("t").alias("k", "term"))
    anchors = written(anchors, "anchors")
    index = postings(texts, written(anchors.select("term").distinct(), "anchor-terms"))
    stretch = F.floor(F.col("pos") / within)
    hits = index.join(sized(anchors), "term").withColumn("stretch", F.explode(F.when(F.col("k") == 0, F.array(stretch)).otherwise(F.array(stretch - 1, stretch, stretch + 1))))
    met = hits.groupBy("key", "item", "window", "of", "stretch").agg(F.collect_set(F.when(F.col("k") == 0, F.col("pos"))).alias("first"), F.collect_set(F.when(F.col("k") > 0, F.struct("k", "pos"))).alias("others"))
    close = lambda p, k: F.exists("others", lambda o: (o["k"] == k) & (F.abs(o["pos"] - p) <= within))
    others = F.when(F.col("of") > 1, F.sequence(F.lit(1), F.col("of") - 1)).otherwise(F.array().cast("array<int>"))
    near = F.filter("first", lambda p: F.forall(others, lambda k: close(p, k)))
    return met.select("key", "item", "window", F.explode(near).alias("pos"))


def covered(found: DataFrame) -> DataFrame:
    """``key, n_hit``: the words inside any of the occurrences of a text."""
    spans = found.select("key", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    return spans.select("key", new.alias("new")).groupBy("key").agg(F.sum("new").cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, rarest: int = 2) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items, contaminated`` of every row of ``docs``.

    A window is ``size`` consecutive words of a test text; a shorter text is one window, and one without words none.
    ``n_hit`` counts the words inside any occurrence of a window, ``items`` lists the ids of the test texts with an occurring
    window, as strings, in order. Null and empty texts have no words. Rows that repeat an id are rows of their own; equal test
    texts are looked up once and all their ids are listed; a null item id is not listed. Ids that test texts share count once. Empty
    tables give no rows, or rows without hits. Other columns are ignored.

    What is joined by broadcast is checked for its size each time (``sized``); beyond it the same joins shuffle. The index
    holds only the terms that windows are looked up by, so common words enter it only if a window has no rarer ones.
    """
    texts = tokenized(docs, id_col, text_col)
    lists, members = distinct_texts(tokenized(benchmark, item_col, item_text_col))
    found = written(phrase_matches(texts, lists, size, rarest), "occurrences")
    items = found.select("key", "item").distinct().join(sized(members), "item").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = written(covered(found).join(items, "key", "left"), "hit")
    out = texts.select("key", "id", F.size("words").cast("long").alias("n_words")).join(sized(hit), "key", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (n_hit > 0).alias("contaminated"))
