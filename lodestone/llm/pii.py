"""Personal data: base spans by fixed patterns, and further spans chosen by boosted trees, in DataFrame operations only.

High-recall generators propose spans, which may overlap. Each has a few yes-or-no features of format and context. Trees
are boosted on the counts of every feature combination over the whole table, where proposals that base spans confirm or
refute give the labels, and become one column expression; thresholds calibrated for each kind select spans.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Possessive quantifiers match the same here and neither backtrack nor recurse. \G lets a match start where the last ended;
# elsewhere a run is entered at its start only, which is where its leftmost match begins.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[a-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
}
NEEDS = {"email": r"(?i)@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"[0-9]"}
CLUES = {"email": "(?i)mail|contact|write|kontakt|correo|courriel", "ip": "(?i)ip|host|server|address|serveur", "card": "(?i)card|visa|karte|tarjeta|carte", "phone": "(?i)tel|phone|call|fax|mobile|anruf"}


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once."""
    return F.transform(F.array(x), f)[0]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def octets(x: Column) -> Column:
    return x.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)|0++(?:\.|$)){4}$")


def luhn(x: Column) -> Column:
    return F.call_function("luhn_check", digits(x))


def valid(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(x)
    n = F.length(digits(x))
    return n.between(13, 19) & luhn(x) if kind == "card" else n.between(9, 15)


def found(text: Column, pattern: str, needs: str) -> Column:
    """Every leftmost non-overlapping match as ``array<struct<s, e, m>>``, in code points, the end exclusive.

    What lies between the matches has one entry more than they have; places are the running lengths of both.
    """
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def placed(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, y: Column) -> Column:
            s = acc["at"] + F.length(y["gap"])
            e = s + F.length(y["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), y["m"].alias("m")))).alias("out"))

        return F.aggregate(F.arrays_zip(F.slice(x["gaps"], F.lit(1), F.size(x["ms"])).alias("gap"), x["ms"].alias("m")), start, step, lambda acc: acc["out"])

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"))
    return F.when(text.rlike(needs), bind(both, placed)).otherwise(none)


def overlaps(spans: Column, x: Column) -> Column:
    return F.exists(spans, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))


def spans_of(text: Column) -> Column:
    """A struct of base, failed and proposed spans for each kind."""

    def of_kind(kind: str) -> Column:
        return F.struct(found(text, BASE[kind], NEEDS[kind]).alias("base"), found(text, PROPOSED[kind], NEEDS[kind]).alias("more"))

    return F.struct(*[of_kind(k).alias(k) for k in KINDS])


def features(kind: str, text: Column, x: Column) -> list[Column]:
    """Yes-or-no features of a proposed span: its format, and what stands around it."""
    n, before, after = F.length(digits(x["m"])), F.substring(text, F.greatest(x["s"] - 19, F.lit(1)), F.least(F.lit(20), x["s"])), F.substring(text, x["e"] + 1, F.lit(1))
    return [
        luhn(x["m"]), octets(x["m"]), x["m"].startswith("+"), x["m"].contains("("), x["m"].contains("@"), x["m"].rlike(r"[\x20-]"),
        n.between(9, 15), n == 16, before.rlike(CLUES[kind]), before.rlike(r"[A-Za-z0-9_=/.-]$"), after.rlike(r"[A-Za-z0-9_=/-]"),
    ]


N_FEATURES = 11
#: Where the features say that a clue word stands before, and those of which one is a sound format of the kind.
CLUE = 8
FORMATS = {"email": (4,), "ip": (1,), "card": (0,), "phone": (2, 6)}
#: The label of a proposal outside base spans that a clue word and its format speak for: right nine times in ten.
WEAK = 0.9
#: One row in so many, by a hash of its text, calibrates thresholds and teaches the trees nothing.
FOLDS = 5


def bits(kind: str, text: Column, x: Column) -> Column:
    value = F.lit(0)
    for i, f in enumerate(features(kind, text, x)):
        value = value + F.when(F.coalesce(f, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
    return value


def proposals(text: Column, kind: str, x: Column) -> Column:
    """The proposed spans with features: ``label`` 1 where a valid base span is the same, ``WEAK`` where it lies in no base match
    but both a clue word and a sound format speak for it, else 0; and null where it lies within a match that fails, about
    which the patterns cannot tell."""
    ok = F.filter(x["base"], lambda y: valid(kind, y["m"]))
    failed = F.filter(x["base"], lambda y: ~valid(kind, y["m"]))

    def described(y: Column) -> Column:
        same = F.exists(ok, lambda z: (z["s"] == y["s"]) & (z["e"] == y["e"]))
        inner = F.exists(failed, lambda z: (z["s"] <= y["s"]) & (z["e"] >= y["e"]) & ((z["s"] < y["s"]) | (z["e"] > y["e"])))
        code = bits(kind, text, y)
        return F.struct(y["s"].alias("s"), y["e"].alias("e"), code.alias("bits"), same.alias("same"), inner.alias("inner"), (same | overlaps(ok, y)).alias("covered"))

    def labelled(y: Column) -> Column:
        sound = F.lit(False)
        for f in FORMATS[kind]:
            sound = sound | (y["bits"].bitwiseAND(1 << f) != 0)
        likely = sound & (y["bits"].bitwiseAND(1 << CLUE) != 0) & ~y["covered"]
        label = F.when(y["same"], 1.0).when(~y["inner"], F.when(likely, F.lit(WEAK)).otherwise(0.0))
        return F.struct(y["s"].alias("s"), y["e"].alias("e"), y["bits"].alias("bits"), label.alias("label"), y["covered"].alias("covered"))

    return F.transform(F.transform(x["more"], described), labelled)


def boosted(rows: list[tuple[int, float, float]], rounds: int = 40, rate: float = 0.3) -> list[tuple[int, int, float, float, float, float]]:
    """Depth-two trees ``(i, j, values for neither, j, i, both)`` by Newton steps on (bits, positives, negatives)."""
    code = np.array([r[0] for r in rows], "int64")
    pos, neg = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    on = (code[:, None] >> np.arange(N_FEATURES + len(KINDS))) & 1
    score, trees = np.zeros(len(rows)), []
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = pos - (pos + neg) * p, (pos + neg) * p * (1 - p)
        best = None
        for i in range(on.shape[1]):
            for j in range(i, on.shape[1]):
                leaf = 2 * on[:, i] + on[:, j]
                gs, hs = np.bincount(leaf, g, 4), np.bincount(leaf, h, 4) + 1.0
                if best is None or (gs * gs / hs).sum() > best[0] + 1e-9:
                    best = ((gs * gs / hs).sum(), i, j, rate * gs / hs, leaf)
        _, i, j, values, leaf = best
        score = score + values[leaf]
        trees.append((i, j, *map(float, values)))
    return trees


def tree_score(trees: list[tuple], code: Column | np.ndarray):
    """The sum of the trees: for a column of bits a column, for an array an array."""
    if isinstance(code, np.ndarray):
        total = np.zeros(len(code))
        for i, j, *v in trees:
            total += np.array(v)[2 * ((code >> i) & 1) + ((code >> j) & 1)]
        return total
    total = F.lit(0.0)
    for i, j, *v in trees:
        on_i, on_j = code.bitwiseAND(1 << i) != 0, code.bitwiseAND(1 << j) != 0
        total = total + F.when(on_i, F.when(on_j, v[3]).otherwise(v[2])).otherwise(F.when(on_j, v[1]).otherwise(v[0]))
    return total


def thresholds(trees: list[tuple], rows: list[tuple[int, float, float]], precision: float) -> dict[str, float | None]:
    """For each kind the lowest score from which on at least ``precision`` of the labelled proposals are right."""
    out: dict[str, float | None] = {}
    for k, kind in enumerate(KINDS):
        own = [r for r in rows if r[0] >> (N_FEATURES + k) & 1]
        out[kind], pos, neg = None, 0.0, 0.0
        score = tree_score(trees, np.array([r[0] for r in own], "int64"))
        for s in sorted(set(score), reverse=True):
            pos += sum(r[1] for r, x in zip(own, score, strict=True) if x == s)
            neg += sum(r[2] for r, x in zip(own, score, strict=True) if x == s)
            if pos >= precision * (pos + neg) and pos > 0:
                out[kind] = float(s) - 1e-9
    return out


def train(docs: DataFrame, *, text_col: str = "text", precision: float = 0.9) -> tuple[list[tuple], dict[str, float | None]]:
    """Trees and thresholds from all rows: thresholds from the fifth of the rows that the trees have not seen.

    What comes to the driver is a count for each combination of features that occurs. If the fifth has no row of a kind that is
    right, nothing of the kind is added.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def labelled(t: Column) -> Column:
        def of(x: Column) -> Column:
            return F.flatten(F.array(*[F.transform(proposals(t, k, x[k]), with_kind(i)) for i, k in enumerate(KINDS)]))

        return bind(spans_of(t), of)

    def with_kind(i: int) -> Callable[[Column], Column]:
        return lambda y: F.struct((y["bits"] + (1 << (N_FEATURES + i))).alias("code"), y["label"].alias("label"))

    rows = docs.where(F.col(text_col).rlike("[0-9@]|[(\\[]at[)\\]]")).select((F.pmod(F.xxhash64(F.col(text_col), F.lit(5)), F.lit(FOLDS)) == 0).alias("aside"), F.explode(bind(text, labelled)).alias("x"))
    each = rows.where("x.label is not null").groupBy("aside", "x.code").agg(F.sum("x.label").alias("pos"), F.sum(1 - F.col("x.label")).alias("neg")).orderBy("code").collect()
    seen, aside = ([(r["code"], r["pos"], r["neg"]) for r in each if r["aside"] == a] for a in (False, True))
    trees = boosted(seen)
    return trees, thresholds(trees, aside, precision)


def find_pii(docs: DataFrame, model: tuple[list[tuple], dict[str, float | None]] | None = None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_email, n_ip, n_card, n_phone`` (long: base spans) and ``base`` and ``spans``.

    Both are ``array<struct<kind: string, s: int, e: int>>`` in code points, the end exclusive, by kind as in ``KINDS``,
    then start. Base spans are the leftmost non-overlapping matches of each kind's pattern that are valid; a match that
    fails is dropped without another try within it. ``spans`` adds proposals that the model selects, of overlapping ones
    the best, then the leftmost, and none that overlaps a base span of its kind. Whole texts are searched; a null text
    counts as empty. Columns named as the new ones are replaced. Each row is worked on where it is read.
    """
    trees, least = model if model is not None else train(docs, text_col=text_col)
    docs = docs.drop("base", "spans", *[f"n_{k}" for k in KINDS])

    def chosen(kind: str, t: Column, x: Column) -> Column:
        none = F.array().cast("array<struct<score:double,s:int,e:int>>")
        if least[kind] is None:
            return none
        bit = F.lit(1 << (N_FEATURES + KINDS.index(kind)))
        open_ = F.filter(proposals(t, kind, x), lambda y: ~y["covered"])
        scored = F.filter(F.transform(open_, lambda y: F.struct((-tree_score(trees, y["bits"] + bit)).alias("score"), y["s"].alias("s"), y["e"].alias("e"))), lambda y: y["score"] <= -least[kind])
        return F.aggregate(F.array_sort(scored), none, lambda acc, y: F.when(overlaps(acc, y), acc).otherwise(F.concat(acc, F.array(y))))

    def per_kind(t: Column) -> Column:
        def of(x: Column) -> Column:
            out = []
            for k in KINDS:
                base = F.transform(kept(k, x), lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e")))
                extra = F.transform(chosen(k, t, x[k]), lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e")))
                out.append(F.struct(base.alias("base"), extra.alias("extra")).alias(k))
            return F.struct(*out)

        return bind(spans_of(t), of)

    def kept(kind: str, x: Column) -> Column:
        return F.filter(x[kind]["base"], lambda y: valid(kind, y["m"]))

    def named(kind: str, spans: Column) -> Column:
        return F.transform(F.array_sort(spans), lambda y: F.struct(F.lit(kind).alias("kind"), y["s"].alias("s"), y["e"].alias("e")))

    def columns(x: Column) -> Column:
        base = F.flatten(F.array(*[named(k, x[k]["base"]) for k in KINDS]))
        every = F.flatten(F.array(*[named(k, F.concat(x[k]["base"], x[k]["extra"])) for k in KINDS]))
        return F.struct(*[F.size(x[k]["base"]).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), every.alias("spans"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("_pii", bind(bind(text, per_kind), columns)).select(*docs.columns, "_pii.*")


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Output of ``find_pii`` with every span of ``spans`` in the text replaced by ``<KIND>``; spans that overlap count as one."""

    def step(acc: Column, y: Column) -> Column:
        gap = F.substring(F.col(text_col), acc["at"] + 1, F.greatest(y["s"] - acc["at"], F.lit(0)))
        tag = F.when(y["s"] >= acc["at"], F.concat(F.lit("<"), F.upper(y["kind"]), F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], y["e"]).alias("at"), F.concat(acc["out"], gap, tag).alias("out"))

    by_place = F.array_sort(F.transform(F.col("spans"), lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), y["kind"].alias("kind"))))
    text = F.aggregate(by_place, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    return docs.withColumn(text_col, F.when(F.size("spans") == 0, F.col(text_col)).otherwise(text))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda y: F.concat_ws(":", y["kind"], y["s"].cast("string"), y["e"].cast("string"))), ",")
