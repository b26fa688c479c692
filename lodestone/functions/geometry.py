"""Rectangles and quadrilaterals in the unit square, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f) -> Column:
    """``f`` of a value that is made once, however often ``f`` looks at it."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def clamp(r: Column) -> Column:
    """Cut to the unit square."""
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    x, y, right, bottom = map(unit, (r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]))
    return rect(x, y, F.greatest(right - x, F.lit(0.0)), F.greatest(bottom - y, F.lit(0.0)))


def inset(r: Column, d: float) -> Column:
    return rect(r["x"] + d, r["y"] + d, r["w"] - 2 * d, r["h"] - 2 * d)


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return rect(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def overlap(a: Column, b: Column) -> Column:
    """The shared area."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def bounded(center: Column, length: Column, lo: float, hi: float) -> Column:
    """``low, high`` of an interval about a centre, moved into the bounds and no longer than they are apart."""
    size = F.least(F.greatest(length, F.lit(0.0)), F.lit(hi - lo))
    low = F.least(F.greatest(center - size / 2, F.lit(lo)), F.lit(hi) - size)
    return F.struct(low.alias("low"), (low + size).alias("high"))


def area(quad: Column) -> Column:
    """Shoelace area of an array of points ``x, y``."""
    n = F.size(quad)
    terms = F.transform(quad, lambda p, i: p["x"] * F.get(quad, F.pmod(i + 1, n))["y"] - F.get(quad, F.pmod(i + 1, n))["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def angles(quad: Column) -> Column:
    """Interior angles in degrees."""
    n = F.size(quad)

    def at(p: Column, i: Column) -> Column:
        a, b = F.get(quad, F.pmod(i - 1, n)), F.get(quad, F.pmod(i + 1, n))
        ux, uy, vx, vy = a["x"] - p["x"], a["y"] - p["y"], b["x"] - p["x"], b["y"] - p["y"]
        norm = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
        return F.degrees(F.acos(F.least(F.greatest((ux * vx + uy * vy) / F.nullif(norm, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))))

    return F.transform(quad, at)


def bilinear(quad: Column, u: Column, v: Column) -> Column:
    """The point of a quadrilateral (top left, top right, bottom right, bottom left) at (u, v) of the unit square."""

    def mixed(c: str) -> Column:
        p = [F.get(quad, F.lit(i))[c] for i in range(4)]
        return (1 - u) * (1 - v) * p[0] + u * (1 - v) * p[1] + u * v * p[2] + (1 - u) * v * p[3]

    return F.struct(mixed("x").alias("x"), mixed("y").alias("y"))


# What a page seen askew must be like to be set straight.
LEAST_PAGE, SHARPEST, BLUNTEST, STRAIGHT = 0.35, 50.0, 135.0, 0.97
#: The least area of a region of a page that was set straight, and the pad around it.
LEAST_MAPPED, MAPPED_PAD = 0.006, 0.004


def deformed(quad: Column) -> Column:
    """Whether a quadrilateral is no more than 97 % of the rectangle around it; one without extent is not."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    around = (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys))
    return F.coalesce(area(quad) / F.nullif(around, F.lit(0.0)) <= STRAIGHT, F.lit(False))


def worth_straightening(quad: Column) -> Column:
    """Whether a page's quadrilateral is large enough, has no corner too sharp or too blunt, and is askew at all."""

    def fair(q: Column) -> Column:
        corners = F.forall(angles(q), lambda a: (F.coalesce(a, F.lit(0.0)) >= SHARPEST) & (F.coalesce(a, F.lit(0.0)) <= BLUNTEST))
        return F.coalesce((F.size(q) == 4) & (area(q) >= LEAST_PAGE) & corners & deformed(q), F.lit(False))

    return let(quad, fair)


def chosen_quad(candidates: Column) -> Column:
    """Of candidates (an array of ``confidence, quad``) the quadrilateral of the most confident one, the first of equals; null if there is none."""
    most = F.array_max(F.transform(candidates, lambda c, i: F.struct(c["confidence"].alias("c"), (-i).alias("i"))))
    return F.get(candidates, -most["i"])["quad"]


def mapped(r: Column, quad: Column) -> Column:
    """The rectangle around a rectangle of the straightened page in the page as it was seen, padded and cut to the unit square."""
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))

    def around(corners: Column) -> Column:
        xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))

    corners = let(quad, lambda q: F.array(*[bilinear(q, unit(u), unit(v)) for u in (r["x"], r["x"] + r["w"]) for v in (r["y"], r["y"] + r["h"])]))
    return let(let(corners, around), lambda box: let(inset(box, -MAPPED_PAD), clamp))
