"""Segmentation of a page's text lines into question blocks, and of blocks into crops.

Lines are ``page, x, y, w, h`` (double, unit square, origin at the top left) ``, text, confidence``. A page is gathered in one row;
all else is arithmetic on its columns. Where two or more lines start with a question number, blocks run from one such line to
the next, and lines before the first are dropped; else blocks are split at gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geometry as g
from lodestone.functions.text import question_line, strip
from lodestone.operators.ranking import reading_order

# The pad around a crop and its least area; where contents and crops end.
PAD = 0.012
LEAST_AREA = 0.012
LEFT, RIGHT, BOTTOM = 0.025, 0.975, 0.985


def right(r: Column) -> Column:
    return r["x"] + r["w"]


def low(r: Column) -> Column:
    return r["y"] + r["h"]


def middle(r: Column) -> Column:
    return r["x"] + r["w"] / 2


def with_rect(df: DataFrame, name: str, r: Column) -> DataFrame:
    """Adds a rectangle whose four numbers are columns of their own first, so that what is made from it does not make them again."""
    own = {c: f"_{name}_{c}" for c in "xywh"}
    return df.withColumns({own[c]: r[c] for c in "xywh"}).withColumn(name, g.rect(*[F.col(own[c]) for c in "xywh"])).drop(*own.values())


def gathered(lines: DataFrame) -> DataFrame:
    """``page, lines``: a page's lines with text, from top to bottom (then by x and text), with ``numbered, right, low, middle``.

    Lines are shuffled as rows: lists of parts of pages would be sorted and packed before that, and save nothing.
    """
    sound = lines.withColumn("text", strip(F.col("text"))).where("text <> ''")
    made = [(F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("low"), (F.col("x") + F.col("w") / 2).alias("middle")]
    line = F.struct("y", "x", "text", "w", "h", "confidence", question_line(F.col("text")).alias("numbered"), *made)
    return sound.select("page", line.alias("line")).repartition("page").groupBy("page").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def numbers(values: Column) -> tuple[Column, Column]:
    """The average and the median of a column of numbers in an array."""
    ordered, n = F.sort_array(values), F.size(values)
    mid = F.floor(n / 2).cast("int")
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n, F.when(n % 2 == 0, (F.get(ordered, mid - 1) + F.get(ordered, mid)) / 2).otherwise(F.get(ordered, mid))


def box_of(lines: Column) -> Column:
    """The smallest rectangle around lines of ``gathered``."""
    x, y = F.array_min(lines["x"]), F.array_min(lines["y"])
    return g.rect(x, y, F.array_max(lines["right"]) - x, F.array_max(lines["low"]) - y)


def page_stats(pages: DataFrame) -> DataFrame:
    """``pages`` of ``gathered`` with ``average`` and ``height`` (the median, the average at least) of lines, and their ``box``."""
    average, median = numbers(F.col("lines")["h"])
    pages = pages.withColumns({"average": average, "median": median})
    return with_rect(pages.withColumn("height", F.greatest("median", "average", F.lit(0.012))).drop("median"), "box", box_of(F.col("lines")))


def with_content(stats: DataFrame) -> DataFrame:
    """Adds ``content``: where questions of the page may lie, a little more than its lines."""
    pad = F.greatest(F.lit(0.026), F.least(F.lit(0.06), F.col("height") * 2.2))
    width = F.least(F.lit(RIGHT - LEFT), F.greatest(F.col("box.w") + pad * 2, F.lit(0.68)))
    across = g.bounded(middle(F.col("box")), width, LEFT, RIGHT)
    top = F.greatest(F.lit(0.0), F.col("box.y") - F.greatest(F.lit(0.012), F.col("height") * 1.2))
    out = stats.withColumns({"_low": across["low"], "_high": across["high"], "_top": top})
    bottom = F.least(F.lit(BOTTOM), F.greatest(low(F.col("box")) + below(F.col("height")), F.col("_top") + least_height(F.col("height"))))
    content = g.rect(F.col("_low"), F.col("_top"), F.col("_high") - F.col("_low"), F.greatest(bottom - F.col("_top"), F.lit(0.0)))
    return with_rect(out, "content", content).drop("_low", "_high", "_top")


def below(height: Column) -> Column:
    return F.greatest(F.lit(0.09), height * 5)


def least_height(height: Column) -> Column:
    return F.greatest(F.lit(0.30), height * 10)


def with_columns(pages: DataFrame) -> DataFrame:
    """Adds ``split_x``: where a page has two columns, the middle of the widest gap between neighbouring line centres.

    Lines over 72 % of the content's width, and those with their centre outside it, do not count; at least four must remain,
    two on each side of the gap; of equal gaps the first. The gap must reach 0.16 and 22 % of the width, few lines may cross
    its middle, each side must have a line's centre, and both columns are at least 0.24 wide. Else null. And ``columns``: the
    rectangles, the content where there is no split, each as low as its lines ask.
    """
    c = F.col("content")
    pages = pages.withColumns({"_w": c["w"] * 0.72, "_l": c["x"], "_r": right(c)})
    narrow = F.filter("lines", lambda r: (r["w"] <= F.col("_w")) & (r["middle"] >= F.col("_l")) & (r["middle"] <= F.col("_r")))
    out = pages.withColumn("_m", F.sort_array(narrow["middle"])).drop("_w", "_l", "_r")
    n = F.size("_m")
    gaps = F.when(n >= 4, F.transform(F.sequence(F.lit(2), n - 2), lambda i: F.struct((F.get("_m", i) - F.get("_m", i - 1)).alias("gap"), (-i).alias("i"))))
    out = out.withColumn("_g", F.array_max(gaps))
    at = -F.col("_g.i")
    out = out.withColumn("_x", F.when((F.col("_g.gap") > 0) & (F.col("_g.gap") >= F.greatest(F.lit(0.16), c["w"] * 0.22)), (F.get("_m", at - 1) + F.get("_m", at)) / 2))
    count = lambda f: F.size(F.filter("lines", f))
    few = count(lambda r: (r["x"] < F.col("_x")) & (r["right"] > F.col("_x"))) <= F.greatest(F.lit(1), F.floor(F.size("lines") / 5))
    both = (F.array_min(F.col("lines")["middle"]) < F.col("_x")) & (F.array_max(F.col("lines")["middle"]) >= F.col("_x"))
    wide = (F.col("_x") - c["x"] >= 0.24) & (right(c) - F.col("_x") >= 0.24)
    out = out.withColumn("split_x", F.when(F.col("_x").isNotNull() & wide & both & few, F.col("_x"))).drop("_m", "_g", "_x")

    def column(x0: Column, x1: Column, keep) -> Column:
        lowest = F.array_max(F.filter("lines", keep)["low"])
        bottom = F.least(F.lit(BOTTOM), F.greatest(F.coalesce(lowest, low(c)) + below(F.col("height")), c["y"] + least_height(F.col("height"))))
        return g.rect(x0, c["y"], F.greatest(x1 - x0, F.lit(0.0)), F.greatest(bottom - c["y"], F.lit(0.0)))

    x = F.col("split_x")
    return out.withColumn("columns", F.when(x.isNull(), F.array(c)).otherwise(F.array(column(c["x"], x, lambda r: r["middle"] < x), column(x, right(c), lambda r: r["middle"] >= x))))


def column_split(lines: DataFrame) -> DataFrame:
    """``page, split_x`` of the pages with two columns."""
    pages = with_columns(with_content(page_stats(gathered(lines))))
    return pages.select("page", F.explode(F.array("split_x")).alias("split_x")).where("split_x is not null")


def block_starts(lines: Column, by_number: Column, limit: Column) -> Column:
    """The places (from 1) of the lines that begin a block, in order.

    ``by_number`` these are the numbered lines, and lines before the first belong to no block. Else a block ends where a line is
    more than ``limit`` below the lowest edge of the block so far, not of the page or the line before, or is numbered itself: a
    fold over the lines.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("double").alias("low"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        new = s["low"].isNull() | (r["y"] - s["low"] > limit) | r["numbered"]
        out = F.when(new, F.concat(s["out"], F.array(s["at"] + 1))).otherwise(s["out"])
        return F.struct((s["at"] + 1).alias("at"), F.when(new, r["low"]).otherwise(F.greatest(s["low"], r["low"])).alias("low"), out.alias("out"))

    numbered = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(lines, i - 1)["numbered"])
    return F.when(by_number, numbered).otherwise(F.aggregate(lines, start, step, lambda s: s["out"]))


def block_column(box: Column, centres: Column, columns: Column, content: Column) -> Column:
    """The column (a rectangle) that a block belongs to: overlap counts twice, each line centre in it 0.05, distance -0.1.

    Blocks of 70 % of the content's width, and pages of one column, have the whole content. Of equal scores the first.
    """

    def score(c: Column) -> Column:
        across = F.greatest(F.least(right(box), right(c)) - F.greatest(box["x"], c["x"]), F.lit(0.0))
        inside = F.size(F.filter(centres, lambda m: (m >= c["x"]) & (m <= right(c))))
        return across * 2.0 + inside * 0.05 - F.abs(middle(box) - middle(c)) * 0.1

    best = F.array_min(F.transform(columns, lambda c, i: F.struct((-score(c)).alias("s"), i.alias("i"), c.alias("c"))))
    return F.when((F.size(columns) <= 1) | (box["w"] >= content["w"] * 0.70), content).otherwise(best["c"])


def with_crop(found: DataFrame) -> DataFrame:
    """Adds ``crop`` to blocks with ``box, column, height, bottom, last``: padded, and cut to the page.

    A crop is as wide as its column, and as low as the next block or the rules let it be. ``bottom`` is the next block's top
    less the pad, or null; ``last`` says whether no block follows. A block nearly as wide as its column keeps its width and a
    little at the sides. One that is too low grows, no further than the next block; the last one, if nothing bounds it, grows
    to the end of its column, within a cap.
    """
    box, column, height = F.col("box"), F.col("column"), F.col("height")
    side = F.least(F.lit(0.02), column["w"] * 0.035)
    narrow = box["w"] < column["w"] * 0.92
    out = found.withColumns({
        "_x0": F.when(narrow, column["x"]).otherwise(F.greatest(column["x"], box["x"] - side)),
        "_x1": F.when(narrow, right(column)).otherwise(F.least(right(column), right(box) + side)),
        "_hard": F.when(F.col("bottom") > low(box), F.least(F.lit(BOTTOM), F.col("bottom"))),
    })

    def least(lines: float, share: float, floor: float, cap: float) -> Column:
        return F.least(F.greatest(box["h"], F.lit(floor), height * lines, column["w"] * share), F.lit(cap))

    y, hard, free = box["y"], F.col("_hard"), F.col("_free")
    out = out.withColumns({"_free": F.col("last") & hard.isNull(), "_open": y + least(8.0, 0.30, 0.20, 0.38), "_shut": y + least(5.0, 0.20, 0.12, 0.28)})
    wanted = F.greatest(low(box), hard, F.when(free, F.col("_open")).otherwise(F.col("_shut")))
    out = out.withColumn("_wanted", F.least(hard, wanted))  # nulls do not count
    end = F.least(F.lit(BOTTOM), F.greatest(low(column), low(box) + F.greatest(F.lit(0.07), height * 3.5), F.col("_open")))
    cap = F.least(F.greatest(F.lit(0.42), height * 14), F.lit(0.56))
    out = out.withColumn("_y1", F.least(F.lit(BOTTOM), F.when(free, F.least(F.greatest(F.col("_wanted"), end), y + F.greatest(box["h"], cap))).otherwise(F.col("_wanted"))))
    crop = g.clamp(g.rect(F.col("_x0"), y, F.greatest(F.col("_x1") - F.col("_x0"), F.lit(0.0)), F.greatest(F.col("_y1") - y, F.lit(0.0))))
    out = with_rect(with_rect(out, "crop", crop), "crop", g.clamp(g.inset(F.col("crop"), -PAD)))
    # A generator, so that a condition on the crop is asked here and not with all of this arithmetic written into it below.
    return out.withColumn("crop", F.explode(F.array("crop"))).drop("_x0", "_x1", "_hard", "_free", "_open", "_shut", "_wanted", "_y1")


def blocks(pages: DataFrame, by_column: bool) -> DataFrame:
    """A row for each block of the pages of ``with_columns``: its ``box, content, columns, height, centres, text, confidence, bottom, last``.

    ``by_column`` blocks the lines of each column by themselves, left before right; else a page's lines go from top to bottom
    across both.
    """
    is_right = lambda r: F.coalesce(r["middle"] >= F.col("split_x"), F.lit(False))  # noqa: E731  without a split all lines are on the left
    own = ["page", "content", "columns", "height", "average"]
    if by_column:
        rows = pages.select(*own, F.posexplode(F.array(F.filter("lines", lambda r: ~is_right(r)), F.filter("lines", is_right))).alias("part", "lines"))
    else:
        rows = pages.select(*own, F.lit(0).alias("part"), "lines")
    rows = rows.withColumns({"_numbered": F.size(F.filter(F.col("lines")["numbered"], lambda x: x)) >= 2, "_limit": F.col("average") * 1.6})
    rows = rows.withColumn("_starts", block_starts(F.col("lines"), F.col("_numbered"), F.col("_limit"))).withColumn("_n", F.size("_starts"))

    def block(first: Column, i: Column) -> Column:
        # Lines of a block are neighbours: a slice of the page.
        after = F.get("_starts", i + 1)
        lines = F.slice("lines", first, F.coalesce(after, F.size("lines") + 1) - first)
        return F.struct((i + 1).alias("block"), lines.alias("own"), (F.get("lines", after - 1)["y"] - PAD).alias("bottom"), (i + 1 == F.col("_n")).alias("last"))

    rows = rows.select("page", "part", "content", "columns", "height", F.explode(F.transform("_starts", block)).alias("b"))
    rows = rows.select("page", "part", "b.block", "content", "columns", "height", "b.bottom", "b.last", F.col("b.own").alias("own"))
    return with_rect(rows, "box", box_of(F.col("own"))).select(
        "page", "part", "block", "content", "columns", "height", "bottom", "last", "box", F.col("own")["middle"].alias("centres"),
        F.array_join(F.col("own")["text"], "\n").alias("text"), (F.aggregate(F.col("own")["confidence"], F.lit(0.0), lambda s, c: s + c) / F.size("own")).alias("confidence"),
    )


def regions(lines: DataFrame, by_column: bool = False) -> DataFrame:
    """``page, index, x, y, w, h, text, confidence`` of the question regions of each page, in reading order.

    A region is the box of its lines grown into the crop of a question (``with_crop``) within its column, padded and cut to the
    page; tiny ones and those without text go. Blank and null lines go, and so do pages that have no others. With
    ``by_column`` the lines of two columns are not mixed.

    One shuffle gathers the lines of a page; a page is a row, so it is what must fit in memory.
    """
    pages = with_columns(with_content(page_stats(gathered(lines))))
    found = blocks(pages, by_column).withColumn("column", block_column(F.col("box"), F.col("centres"), F.col("columns"), F.col("content")))
    found = with_crop(found).select("page", "crop.*", "text", "confidence")
    found = found.where(F.col("w") * F.col("h") >= LEAST_AREA)  # lines have text, stripped, and so has what is made of them
    return reading_order(found, ["page"]).select("page", "index", "x", "y", "w", "h", "text", "confidence")


def straightened_regions(regions: DataFrame, quads: DataFrame) -> DataFrame:
    """Regions in the page as it was seen: ``regions`` were found on pages set straight, ``quads`` says how these were seen.

    ``quads``: ``page, candidates`` (an array of ``confidence, quad``; corners from the top left clockwise, origin at the top
    left). The most confident one decides, if it is worth straightening by (``geometry.worth_straightening``); pages without such a one were
    not set straight, and their regions stay as they are. Mapped regions that are too small go. ``straightened`` says which are which.
    """
    quad = g.chosen_quad(F.col("candidates"))
    pages = quads.select("page", F.explode(F.array(quad)).alias("quad")).where(g.worth_straightening(F.col("quad")))
    both = regions.join(pages, "page", "left").withColumn("straightened", F.col("quad").isNotNull())
    own = g.rect(*[F.col(c) for c in "xywh"])
    out = both.withColumn("r", F.explode(F.array(F.when(F.col("straightened"), g.mapped(own, F.col("quad"))).otherwise(own))))
    out = out.where(~F.col("straightened") | (F.col("r.w") * F.col("r.h") >= g.LEAST_MAPPED))
    return out.select(*[F.col(f"r.{c}").alias(c) if c in ("x", "y", "w", "h") else F.col(c) for c in regions.columns], "straightened")
