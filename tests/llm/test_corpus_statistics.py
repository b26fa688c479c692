"""Divergence of sources, decontamination and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bytewords, decontamination, divergence, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS, WORDS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AWKWARD = ["", None, " .,;-- ", "A", "İSTANBUL É中文 naïve", "a1b2 c3", "x" * 70 + " " + "y" * 200, "\x00a\x7fb\u0085c", "no\nnew\tterms\r\nhere", "Éé ÀÀ zz"]


def words(text, pattern=WORDS):
    return re.findall(pattern, (text or "").translate(LOWER))


@pytest.mark.parametrize("table, pattern", [(bytewords.LETTERS, LETTERS), (bytewords.LETTERS_DIGITS, WORDS)])
def test_words_are_those_of_the_pattern(table, pattern):
    rng = random.Random(5)
    texts = AWKWARD + ["".join(rng.choice("aZ09é中\U0001f600 .-_\x7f") for _ in range(rng.randrange(30))) for _ in range(200)]
    whole = pa.array(texts, pa.string())
    for column, want in ((whole, texts), (whole.slice(3, 50), texts[3:53]), (whole[:0], []), (pa.array([None, ""], pa.string()), [None, ""])):
        got = bytewords.cut(column, table)
        rows = defaultdict(list)
        for s, e, r in zip(got.starts, got.ends, got.rows, strict=True):
            rows[int(r)].append(got.data[s:e].tobytes().decode())
        assert [rows[i] for i in range(len(want))] == [words(t, pattern) for t in want] and got.n_rows == len(want)


def test_chunks_keep_all_rows():
    batch = pa.record_batch({"text": pa.array(["ab" * n if n % 7 else None for n in range(100)], pa.string()), "n": pa.array(range(100))})
    parts = list(bytewords.chunks(iter([batch, batch[:0]]), "text", 300))
    assert [x for p in parts for x in p["n"].to_pylist()] == list(range(100)) and len(parts) > 20


@pytest.mark.parametrize("digest", [lambda b: 0, lambda b: len(b), lambda b: b[0] * 256 + len(b)])
def test_words_whose_hashes_collide_stay_apart(digest):
    text = "a b aa ab ba a b ab abc abd abc"
    cut = bytewords.cut(pa.array([text], pa.string()), bytewords.LETTERS)
    group, first = divergence.grouped(cut, digest)
    names = [cut.data[cut.starts[i] : cut.ends[i]].tobytes().decode() for i in first]
    assert [names[g] for g in group] == text.split() and len({names[g] for g in group}) == len(set(group.tolist())) == 7


def divergence_brute(rows, least=3, top=200):
    count, docs, groups = Counter(), defaultdict(set), set()
    for k, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in words(text, LETTERS):
            count[lang, source, t] += 1
            docs[lang, t].add(k)
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = sorted(t for x, t in docs if x == lang and len(docs[x, t]) >= least)
        share = {}
        for s in [*sources, None]:
            n = {t: sum(count[lang, x, t] for x in (sources if s is None else [s])) for t in kept}
            total = sum(n.values()) + len(kept)
            share[s] = {t: 1 + 10**9 * (n[t] + 1) // total for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = sorted(((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted((-f(share[s][t], share[None][t]), t.encode()) for t in kept if count[lang, s, t] and share[s][t] > share[None][t])
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms[:top])]
    return sorted(out)


def corpus(rng, n=150):
    vocabulary = ["".join(rng.choice("abcé中Z") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "é", None]), " ".join(rng.choice(vocabulary[: rng.choice((5, 60))]) for _ in range(rng.randrange(40)))) for _ in range(n)]
    return rows + [("en", "lone", t) for t in AWKWARD] + [("de", "only", "ein wort"), ("it", "a", ""), ("it", "b", None)] + rows[:20]


@pytest.mark.parametrize("entries, block, top", [(1 << 14, 256, 200), (20, 2, 3)])
def test_divergence_is_exact(spark, entries, block, top):
    rows = corpus(random.Random(2))
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, source string, text string, term string, n int, value long").repartition(3)
    got = divergence.divergences(df, slice_entries=entries, block_sources=block, top=top)
    assert sorted(tuple(r) for r in got.collect()) == divergence_brute(rows, top=top)


def test_divergence_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    got = divergence.divergences(spark.createDataFrame([("a", "x", ""), ("a", "y", None)], "lang string, source string, text string")).collect()
    assert sorted(map(tuple, got)) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]


def test_shares_of_large_counts_are_exact():
    rng = random.Random(3)
    cases = [(c, c + rng.randrange(1, 10**14)) for c in (rng.randrange(10 ** rng.randrange(1, 15)) for _ in range(500))]
    got = divergence.share(np.array([c for c, _ in cases]), np.array([t for _, t in cases]))
    assert got.tolist() == [1 + 10**9 * (c + 1) // t for c, t in cases]


def contamination_brute(rows, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(str(item) if item is not None else None)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for length in {len(x) for x in windows}:
            for i in range(len(w) - length + 1):
                if tuple(w[i : i + length]) in windows:
                    hit |= set(range(i, i + length))
                    found |= windows[tuple(w[i : i + length])]
        out.append((doc, len(w), len(hit), sorted(x for x in found if x is not None), bool(hit)))
    return sorted(out, key=repr)


def leaks(rng):
    vocabulary = [f"w{i}" for i in range(40)]
    say = lambda n: [rng.choice(vocabulary[: rng.choice((3, 40))]) for _ in range(n)]
    texts = [say(rng.randrange(1, 35)) for _ in range(25)]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100, "one two"), (101, "Solo"), (102, ""), (103, None), (104, " ".join(texts[3])), (None, " ".join(texts[4])), (105, "the " * 30), (100, "three, four; five")]
    rows = []
    for i in range(160):
        w = say(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            t = rng.choice(texts)
            a, at = rng.randrange(len(t)), rng.randrange(len(w) + 1)
            w[at:at] = t[a : a + rng.randrange(1, 25)] if rng.random() < 0.5 else t
        rows.append((i, rng.choice((" ", ", ", "\n")).join(w)))
    extra = ["one two", "ONE-two one two", "solo", "the " * 50, "the " * 9, "three four five six", *AWKWARD]
    return rows + [(200 + i, t) for i, t in enumerate(extra)] + [(None, "solo one two"), (3, rows[5][1])], items


@pytest.mark.parametrize("rarest", [1, 2, 3])
def test_decontamination_finds_what_brute_force_finds(spark, rarest):
    rows, items = leaks(random.Random(7))
    docs = spark.createDataFrame([(i, t, "k", 0, 1) for i, t in rows], "doc_id long, text string, key string, n int, start int").repartition(4)
    benchmark = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, item string")
    got = decontamination.decontaminate(docs, benchmark, rarest=rarest)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()), key=repr) == contamination_brute(rows, items)
    assert all(r["n_items"] == len(r["items"]) for r in got.collect())


def test_decontamination_without_broadcasts(spark, monkeypatch):
    """The same joins shuffle where a table is too large to be broadcast."""
    rows, items = leaks(random.Random(8))
    monkeypatch.setattr(decontamination, "sized", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got), key=repr) == contamination_brute(rows, items)


def test_decontamination_of_nothing_and_by_nothing(spark):
    docs, benchmark = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.decontaminate(docs.limit(0), benchmark).count() == 0
    for none in (benchmark.limit(0), benchmark.withColumn("text", F.lit(None).cast("string")), benchmark.withColumn("text", F.lit("z"))):
        got = decontamination.decontaminate(docs, none).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in got] == [(2, 0, 0, [], False), (0, 0, 0, [], False)]


def test_windows_of_equally_rare_words_share_anchors(spark):
    lists = spark.createDataFrame([(1, ["the"] * 200), (2, [f"w{i}" for i in range(200)])], "item long, words array<string>")
    frequency = lists.select(F.explode("words").alias("term")).distinct().withColumn("n", F.lit(7).cast("long"))
    found = decontamination.windows(lists, frequency, 10, 2)
    assert found.count() == 2 * 191
    assert {r["item"]: r["n"] for r in found.select("item", F.explode("anchors.s").alias("s")).groupBy("item").agg(F.count_distinct("s").alias("n")).collect()} == {1: 40, 2: 40}


def test_decontamination_stays_in_the_jvm(spark):
    rows, items = leaks(random.Random(9))
    out = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("within", [3, 8])
def test_proximity_matches(spark, within):
    rows, items = leaks(random.Random(10))
    texts = decontamination.tokenized(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    lists, _ = decontamination.distinct_texts(decontamination.tokenized(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text"))
    key_words, item_words = {r["key"]: r["words"] for r in texts.collect()}, {r["item"]: r["words"] for r in lists.collect()}
    n = Counter(w for ws in key_words.values() for w in ws)
    want = set()
    for item, ws in item_words.items():
        for a in range(max(1, len(ws) - 9)):
            window = ws[a : a + 10]
            if all(n[w] for w in window):
                rare = list(dict.fromkeys(w for _, _, _, w in sorted((n[w], (a + i) % 10, a + i, w) for i, w in enumerate(window))))[:3]
                for key, d in key_words.items():
                    want |= {(key, item, a, p) for p, w in enumerate(d) if w == rare[0] and all(r in d[max(0, p - within) : p + within + 1] for r in rare[1:])}
    got = decontamination.proximity_matches(texts, lists, within=within).collect()
    assert {(r["key"], r["item"], r["window"], r["pos"]) for r in got} == want and len(got) == len(want) > 100


def resampling_brute(rows, target, buckets=10_000, share=25, least=20, seed=7):
    def features(text):
        w = words(text)
        return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    s, t = Counter(b for _, x in rows for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for doc, text in rows:
        n, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: len(able) * share // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("share, least", [(25, 20), (100, 0), (0, 20)])
def test_resampling_is_the_brute_force_draw(spark, share, least):
    rows, items = leaks(random.Random(11))
    target = [t for _, t in items]
    docs = spark.createDataFrame([(i, t, 0, 0, "x") for i, t in rows], "doc_id long, text string, score int, rank int, id string").repartition(5)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), share=share, least_words=least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == resampling_brute(rows, target, share=share, least=least)


def test_resampling_of_nothing_and_towards_nothing(spark):
    docs, target = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), target).count() == 0
    got = resampling.resample(docs, target, least_words=0, share=50)
    assert sorted(map(tuple, got.collect()), key=repr) == resampling_brute([(1, "a b c"), (2, None)], [], least=0, share=50)


def test_crc_of_words_and_pairs():
    texts = [t for t in AWKWARD if t] + ["".join(random.Random(i).choice("abé9 ") for _ in range(300)) for i in range(20)]
    cut = bytewords.cut(pa.array(texts, pa.string()), bytewords.LETTERS_DIGITS)
    bucket, row = resampling.features(cut, 1 << 32)
    want = Counter((i, zlib.crc32(x.encode())) for i, t in enumerate(texts) for w in [words(t)] for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))])
    assert Counter(zip(row.tolist(), bucket.tolist(), strict=True)) == want
