"""Each operator against brute force on small tables that hold the awkward cases; the pipeline against its stages."""

import hashlib
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lodestone.llm import embedding_dedup, line_dedup, mixing, ngram_join, pii, sentencepiece_fst, topk, toxicity, url_filter, warc
from lodestone.llm.common import components
from lodestone.llm.queries import PIECES, QUERIES, URL_RULES

DOCS = "doc_id long, text string, score double, component_id string, kind string"


def docs(spark, rows):
    """Rows (id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 0.0, "x", "y") for i, t in rows], DOCS)


def groups(pairs, nodes):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(200, 300 + i) for i in range(30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(edges, {x for e in edges for x in e})
    assert got == {n: c for n, c in want.items() if n in got} and len(got) >= 90
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard_brute(rows, n, under, over):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and over * len(sets[a] & sets[b]) >= under * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, groups(links, ids)


def similar_texts(seed=3, families=12, each=6, words=(5, 160)):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(*words))]
        for _ in range(each):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(text) // 40) + 1)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((i, " ".join(text)))
            i += 1
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "One"), (1005, "one two"), (1006, "long " * 5000), (1007, "LONG " * 5000)]


@pytest.mark.parametrize(("n", "under", "over"), [(3, 9, 10), (5, 8, 10)])
def test_ngram_join(spark, n, under, over):
    rows = similar_texts()
    sizes, want = jaccard_brute(rows, n, under, over)
    got = ngram_join.jaccard_join(docs(spark, rows), n=n, threshold=(under, over)).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(want) - 20


def test_ngram_join_of_chains_and_nothing(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(base[:100] + [f"x{k}_{j}" for j in range(0)])) for k in range(1)]
    rows = [(k, " ".join([f"n{j}" if j < 4 * k else w for j, w in enumerate(base)])) for k in range(12)]
    _, want = jaccard_brute(rows, 3, 9, 10)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_join(docs(spark, rows), n=3, threshold=(9, 10)).collect()} == want
    assert ngram_join.jaccard_join(docs(spark, [])).count() == 0
    assert [r["component_id"] for r in ngram_join.jaccard_join(docs(spark, [(None, "a b c d e f")])).collect()] == [None]


def test_box_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    base = rng.poisson(3, (40, ngram_join.POINT))
    points = np.concatenate([base, base + (rng.random(base.shape) < 0.02), rng.poisson(3, (100, ngram_join.POINT))]).astype("int32")
    sizes, rule = points.sum(axis=1), ngram_join.Rule(9, 10)
    got = {tuple(sorted(p)) for i, j in ngram_join.BoxTree(points, sizes).pairs(rule) for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if np.minimum(points[i], points[j]).sum() >= rule.least(sizes[i] + sizes[j])}
    assert got == want and len(want) >= 40


def test_pins_meet():
    rng = np.random.default_rng(6)
    for under, over in ((9, 10), (8, 10)):
        rule = ngram_join.Rule(under, over)
        classes = rule.classes(4000)
        for _ in range(300):
            size = int(rng.integers(1, 1500))
            a = rng.integers(-(2**62), 2**62, size)
            b = np.concatenate([a[: size - int(rng.integers(0, size // 5 + 1))], rng.integers(-(2**62), 2**62, int(rng.integers(0, size // 5 + 1)))])
            both = len(np.intersect1d(a, b))
            if len(b) and both * over >= (len(a) + len(b) - both) * under and both < max(len(a), len(b)):
                assert len(np.intersect1d(ngram_join.pins(a, rule, classes), ngram_join.pins(b, rule, classes)))


def test_sentencepiece_is_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["", " ", " a  b   c", "line\n\nline", "日本語😀", "<s> <0x0A>", "a" * 3000, "    " * 9, "Don't stop—believing… naïve café", "x" * 70 + " y", "\u0000"] + [t for _, t in similar_texts() if t][:20]
    rows = sentencepiece_fst.encode(docs(spark, list(enumerate(texts)) + [(999, None)]), sentencepiece_fst.model_bytes(PIECES)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[999]["ids"] is None and got[999]["n_tokens"] == 0
    for i, t in enumerate(texts):
        assert got[i]["ids"] == theirs.encode(t), t
        assert got[i]["round_trip"] is True
    encoded = spark.createDataFrame([(r["doc_id"], r["ids"]) for r in rows], "doc_id long, ids array<int>")
    back = {r["doc_id"]: r["text"] for r in sentencepiece_fst.decode(encoded, sentencepiece_fst.model_bytes(PIECES)).collect()}
    assert back == dict(enumerate(texts)) | {999: None}


def test_sentencepiece_unigram_is_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng, proto = random.Random(4), pb.ModelProto()
    proto.ParseFromString(sentencepiece_fst.model_bytes(PIECES))
    del proto.pieces[:]
    proto.trainer_spec.model_type = 1
    kinds = pb.ModelProto.SentencePiece
    for piece, kind in (("<unk>", kinds.UNKNOWN), ("<s>", kinds.CONTROL), ("</s>", kinds.CONTROL), *((f"<0x{i:02X}>", kinds.BYTE) for i in range(256))):
        proto.pieces.add(piece=piece, score=0, type=kind)
    names = {"▁", *"abcd", *("".join(rng.choices("abcd", k=rng.randrange(2, 6))) for _ in range(60)), *("▁" + "".join(rng.choices("abcd", k=rng.randrange(1, 5))) for _ in range(40))}
    for piece in sorted(names):
        proto.pieces.add(piece=piece, score=-rng.uniform(1, 12), type=kinds.NORMAL)
    proto.trainer_spec.vocab_size = len(proto.pieces)
    model = proto.SerializeToString()
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["", " ", "abcdé", "ab\ncd e", "é" * 3, "x" * 60] + [" ".join("".join(rng.choices("abcdabcdé", k=rng.randrange(1, 30))) for _ in range(12)) for _ in range(60)]
    got = {r["doc_id"]: r["ids"] for r in sentencepiece_fst.encode(docs(spark, list(enumerate(texts))), model).collect()}
    assert [got[i] for i in range(len(texts))] == [theirs.encode(t) for t in texts]
    proto.pieces[-1].type = kinds.USER_DEFINED
    with pytest.raises(ValueError):
        sentencepiece_fst.Transducer(proto.SerializeToString())


def test_sentencepiece_of_nothing_and_of_repeats(spark):
    model = sentencepiece_fst.model_bytes(PIECES)
    table = spark.createDataFrame([(1, "same words", [7], 3), (1, "same words", [8], 4), (2, None, None, None)], "doc_id long, text string, ids array<int>, n_tokens int")
    rows = sentencepiece_fst.encode(table, model).collect()
    assert len(rows) == 3 and rows[0]["ids"] == rows[1]["ids"] != [7] and rows[2]["n_tokens"] == 0
    assert sentencepiece_fst.encode(table.limit(0), model).count() == 0 and sentencepiece_fst.decode(sentencepiece_fst.encode(table, model), model).count() == 3


def test_decoding_of_null_ids(spark):
    table = spark.createDataFrame([(1, None, "x"), (None, "Some text", "y"), (None, None, None), (2, "", "z")], "doc_id long, text string, source string")
    model = sentencepiece_fst.model_bytes(PIECES)
    encoded = sentencepiece_fst.encode(table, model).drop("text")
    got = sentencepiece_fst.decode(encoded, model).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, None), (None, "Some text"), (None, None), (2, "")], key=repr)


def test_toxicity(spark):
    rng = random.Random(2)
    ordinary = ["meadow", "river", "stone", "window", "paper", "garden", "silver", "morning", "letter", "bridge"]
    bad = ["scoundrel", "nitwit", "dunce"]
    rows, marks = [], []
    for i in range(240):
        words = [rng.choice(ordinary) + rng.choice(["", "s", "ly"]) for _ in range(rng.randrange(10, 120))]
        if toxic := i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    table = docs(spark, rows)
    labels = spark.createDataFrame(marks[:160], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(spark, [*rows, (900, None), (901, ""), (902, "river " * 20000), (903, "z" * 500)]), model).collect()}
    assert all(got[i]["predicted"] == y for i, y in marks[160:])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["predicted"] for i in (900, 901, 902, 903)] == [0, 0, 0, 0] and got[900]["score"] == got[901]["score"]
    # Labels without a document take no place in the sample, and texts that repeat change nothing.
    strangers = labels.unionByName(spark.createDataFrame([(10_000 + i, i % 2) for i in range(5000)], "doc_id long, toxic int"))
    few = toxicity.train(table.unionByName(table), strangers, rows=(40, 120))
    assert few == toxicity.train(table, labels, rows=(40, 120)) == model
    # Each dictionary holds its own kind; a window costs what zstandard says.
    assert b"scoundrel" in model.toxic and b"scoundrel" not in model.ordinary
    a, b = toxicity.compressor(model.toxic), toxicity.compressor(model.ordinary)
    for _, text in rows[:40]:
        text = toxicity.plain(text)
        lengths = [len(b.compress(toxicity.ANCHOR + w)) - len(a.compress(toxicity.ANCHOR + w)) for w in toxicity.windows(text)]
        assert toxicity.saved(text, a, b) == (sum(x > 0 for x in lengths), sum(x for x in lengths if x > 0))
    empty = toxicity.train(table.limit(0), labels.limit(0))
    assert toxicity.score_toxicity(docs(spark, []), empty).count() == 0
    one_kind = toxicity.train(table, labels.where("toxic = 0"))
    assert len(set(one_kind.table)) >= 1 and {r["predicted"] for r in toxicity.score_toxicity(table, one_kind).collect()} == {0}


def test_toxicity_counts_in_tasks_are_those_of_the_whole_sample(spark):
    """Prefixes, ordinary words and calibrated shares against a plain computation over all texts at once."""
    rng = random.Random(4)
    some = ["meadow", "river", "scouring", "done", "sundrels", "élan"]
    rows = [(i, " ".join(rng.choice([*some, *["scoundrel", "dunces"][: 2 * (i % 3 == 0)]]) for _ in range(rng.randrange(3, 40)))) for i in range(90)]
    marks = [(i, int(i % 3 == 0)) for i in range(0, 90)] + [(0, None), (777, 1)]
    texts = toxicity.sample(docs(spark, rows + rows[:5]), spark.createDataFrame(marks, "doc_id long, toxic int"), "doc_id", "text", "toxic", (500, 500)).repartition(5)
    got = texts.collect()
    assert sorted((r["text"], r["label"]) for r in got) == sorted({(toxicity.plain(t), int(i % 3 == 0)) for i, t in rows})
    want = {}
    for r in got:
        for p, n in toxicity.contexts(r["text"]).items():
            want.setdefault(p, [0] * 4)[2 * r["half"] + r["label"]] += n
    assert {r["p"]: [r["n00"], r["n01"], r["n10"], r["n11"]] for r in toxicity.prefix_counts(texts).collect()} == want
    lists = [["scoundrel", "dunce"], ["river "], []]
    words = sorted({w for r in got if not r["label"] for w in r["text"].split()})
    brute = [{p: min(w for w in words if p in f" {w} " and not any(w.startswith(m.rstrip()) for m in ms)) for p in toxicity.parts_of(ms) if any(p in f" {w} " and not any(w.startswith(m.rstrip()) for m in ms) for w in words)} for ms in lists]
    found = toxicity.ordinary_words(texts, lists)
    assert [{p: w for p, w in f.items() if p in toxicity.parts_of(ms)} for f, ms in zip(found, lists, strict=True)] == brute
    assert toxicity.look_alikes(["scoundrel", "dunce"], found[0]) == ["scouring", "sundrels"]


def test_rising_shares():
    table = toxicity.rising({(0, 0): 100, (0, 1): 2, (3, 1): 5, (4, 0): 5, (10, 1): 50})
    assert len(table) == toxicity.RATES and list(table) == sorted(table) and table[0] < 0.05 < 0.5 < table[10]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "é" * (i % 7) if i % 5 else None) for i in range(600)] + [(3, "http://h/3", "again")], "page_id long, url string, html string")
    records = pages.select("page_id", warc.record_text(F.col("url"), F.col("html"), F.col("page_id")).alias("record"), F.lit(1).alias("offset"))
    laid = warc.layout(warc.hashed(records))
    rows = sorted(laid.collect(), key=lambda r: (r["file"], r["ordinal"]))
    for a, b in zip(rows, rows[1:]):
        assert b["offset"] == (a["offset"] + a["length"] if a["file"] == b["file"] else 0)
    place = ["file", "ordinal", "offset", "length"]
    a = laid.select(*place, "hash")
    b = a.where("file <> 1 or ordinal <> 7").withColumn("hash", F.when((F.col("file") == 2) & (F.col("ordinal") == 40), "bad").otherwise(F.col("hash")))
    got = {(r["file"], r["ordinal"]): r["problem"] for r in warc.audit(a, b).collect()}
    assert got == {(1, 7): "missing", (2, 40): "changed"}
    assert warc.audit(a, a).count() == 0 and warc.audit(a.limit(0), a.limit(0)).count() == 0
    assert {r["problem"] for r in warc.audit(a.limit(0), a.where("file = 0")).collect()} == {"extra"}
    warc.write_warc(records, f"{tmp_path}/w")
    read = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert len(read) == 601 and all(r["whole"] for r in read)


def test_warc_bodies_end_where_their_length_says(spark, tmp_path):
    import gzip

    def record(i, body, length=None):
        return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body.encode()) if length is None else length}\r\n\r\n{body}\r\n\r\n".encode()

    bodies = ["x spec says WARC/1.0\r\nend", "", "é\r\n\r\nWARC/1.0\r\nWARC-Type: fake\r\n\r\n", "last"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(bodies)) + record(9, "cut short", 100))
    (tmp_path / "w/b.warc.gz").write_bytes(b"".join(gzip.compress(record(10 + i, b)) for i, b in enumerate(bodies)))
    (tmp_path / "w/c.warc").write_bytes(b"")
    got = {r["record_id"]: (r["body"], r["whole"]) for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert {k: v for k, v in got.items() if k != "<9>"} == {f"<{i + n}>": (b, True) for i, b in enumerate(bodies) for n in (0, 10)}
    assert got["<9>"][1] is False


def test_warc_layout_of_null_and_repeated_ids(spark):
    records = spark.createDataFrame([(None, "a"), (None, "b"), (7, "c"), (7, "c"), (7, "d")], "page_id long, record string")
    rows = warc.layout(warc.hashed(records)).collect()
    assert sorted(r["ordinal"] for r in rows if r["page_id"] == 7) == [0, 1, 2] and all(r["file"] < 0 for r in rows if r["page_id"] is None)


def test_url_filter(spark):
    urls = ["http://www.Example.COM/en/x?y", "https://a.example.com/en/1#z", "https://example.com/en", "http://example.com", "http://com/", "ftp://b.net/es/", "b.net/es/", None, "", "http://xnet/es/", "http://q.net/fr/?a://b", "http://a.example.com:80/en/", "://", "http://www.example.com/EN/", "http://x.www.example.com/en/" + "p" * 50000]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x"), (None, urls[1], "x")]
    rules = spark.createDataFrame([*URL_RULES, URL_RULES[0]], "host string, path string, verdict string")
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), rules, partitions=5).collect()
    assert len(got) == len(rows)

    def judged(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = sorted(((h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: -len(x[0]))
        return host, path, *(fits[0] if fits else (None, "allow"))

    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(urls[r["page_id"]])
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame([(1, urls[0])], "page_id long, url string"), rules.limit(0)).collect()} == {"allow"}


def test_url_filter_of_very_many_hosts_of_one_suffix(spark):
    """A hundred thousand hosts share one key; their own keys are cut into many slices, which their rules reach."""
    n = 100_000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".com/")).alias("url"))
    rules = spark.createDataFrame([("com", "/", "allow"), *[(f"h{i}.com", "/", "block") for i in range(0, n, 1000)]], "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules, partitions=16)
    counts = {(r["rule"], r["verdict"]): r["count"] for r in got.groupBy("rule", "verdict").count().collect()}
    assert counts == {("com/", "allow"): n - n // 1000, **{(f"h{i}.com/", "block"): 1 for i in range(0, n, 1000)}}


def test_sweep_closes_rules_and_meets_each_key_once():
    import pandas as pd

    rows = [(b"a", 1), (b"a", -1), (b"ab", 2), (b"abc", -1), (b"ac", -1), (b"b", -1), (b"c", 3), (b"c\xfe", -1), (b"d", -1)]
    for cut in range(len(rows)):
        parts = [pd.DataFrame(rows[:cut], columns=["key", "rule_no"]), pd.DataFrame(rows[cut:], columns=["key", "rule_no"])]
        got = [tuple(x) for p in url_filter.sweep(iter(parts)) for x in p.itertuples(index=False)]
        assert got == [(b"a", 1), (b"abc", 2), (b"ac", 1), (b"c\xfe", 3)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)] + [(200 + i, [1.0] * 6) for i in range(30)] + [(500, None), (501, [1.0, None] * 3), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (600, [1.0, 2.0])]
    table = vectors(spark, rows)
    got = topk.top_k(table, table.where("vec_id % 50 = 0"), 5, block=40, query_block=2).collect()
    good = {i: np.floor(256 * np.asarray(v, "float32").astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in good if i % 50 == 0):
        scores = sorted(((-int(good[q] @ good[c]), c) for c in good if c != q and len(good[c]) == len(good[q])))[:5]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(scores, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0
    one, asked = vectors(spark, [(1, [1.0, 2.0])]), vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0, 1.0, 1.0])])
    assert [tuple(r) for r in topk.top_k(one, asked).collect()] == [(2, 1, 1, 256 * 256 * 5)]


def test_topk_of_one_id_with_vectors_of_several_lengths(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0, 3.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, [2.0, 1.0, 1.0]), (50, [1.0, 2.0])]
    table = vectors(spark, rows)
    got = topk.top_k(table, table.where("vec_id = 50"), 2, scale=1).collect()
    assert sorted(tuple(r) for r in got) == [(50, 1, 2, 4), (50, 1, 4, 7), (50, 2, 1, 3), (50, 2, 3, 6)]


def test_topk_of_large_components(spark):
    rows = [(1, [2.0**20, 1.0]), (2, [2.0**20, 3.0]), (3, [-(2.0**20), 5.0])]
    got = topk.top_k(vectors(spark, rows), vectors(spark, rows[:1])).collect()
    whole = {i: [int(256 * x) for x in v] for i, v in rows}
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, sum(a * b for a, b in zip(whole[1], whole[i]))) for i in (2, 3)]


def test_pii(spark):
    texts = [
        "mail a.b@c.de, x@y.z.w and card 4539 1488 0343 6467 from 10.0.0.255 or 256.1.1.1", "+1 (743) 555-3824 227.5.221.1", "call +49-30-1234567 now", "é😀 q@r.st", "1" * 5000, "a@" * 3000, None, "", "7536784127813050 4465758382889437",
        "a@b.cd_x@e.f", "00010.1.2.3", "+1" + "2" * 30,
    ]
    got = {r["doc_id"]: r for r in pii.find_pii(docs(spark, list(enumerate(texts)))).collect()}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(x - 9 * (x > 9) for x in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t or "") if good(k, m[0])]
        assert [tuple(x) for x in got[i]["base"]] == want
        assert set(want) <= {tuple(x) for x in got[i]["spans"]}
    assert pii.find_pii(docs(spark, [])).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(docs(spark, list(enumerate(texts))))).collect()}
    assert clean[3] == "é😀 <EMAIL>" and clean[6] is None


def luhn_brute(x):
    d = [int(c) for c in re.sub("[^0-9]", "", x)]
    return bool(d) and sum(sum(divmod(2 * n, 10)) if i % 2 else n for i, n in enumerate(reversed(d))) % 10 == 0


def valid_brute(kind, m):
    n = len(re.sub("[^0-9]", "", m))
    if kind == "ip":
        return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", m) is not None and all(int(x) <= 255 for x in m.split("."))
    return kind == "email" or (13 <= n <= 19 and luhn_brute(m) if kind == "card" else 9 <= n <= 15)


def proposals_brute(text, kind):
    """(start, end, features, label, covered) of each proposed span, by Python's own matcher."""
    match = lambda pattern: [(m.start(), m.end(), m.group()) for m in regex.finditer(pattern, text)] if regex.search(pii.NEEDS[kind], text) else []
    base = match(pii.BASE[kind])
    ok, failed = ([b for b in base if valid_brute(kind, b[2]) == good] for good in (True, False))
    out = []
    for s, e, m in match(pii.PROPOSED[kind]):
        n, before, after = len(re.sub("[^0-9]", "", m)), text[max(0, s - 20) : s], text[e : e + 1]
        octets = re.fullmatch(r"([0-9]+\.){3}[0-9]+\.?", m) is not None and all(int(x) <= 255 for x in m.rstrip(".").split("."))
        flags = [
            luhn_brute(m), octets, m.startswith("+"), "(" in m, "@" in m, bool(re.search("[ -]", m)), 9 <= n <= 15, n == 16,
            bool(regex.search(pii.CLUES[kind], before)), bool(re.search("[A-Za-z0-9_=/.-]$", before)), bool(re.search("[A-Za-z0-9_=/-]", after)),
        ]
        same, inner = any((s, e) == b[:2] for b in ok), any(b[0] <= s and e <= b[1] and (s, e) != b[:2] for b in failed)
        covered = same or any(b[0] < e and s < b[1] for b in ok)
        likely = any(flags[f] for f in pii.FORMATS[kind]) and flags[pii.CLUE] and not covered
        out.append((s, e, sum(1 << i for i, f in enumerate(flags) if f), 1.0 if same else None if inner else pii.WEAK if likely else 0.0, covered))
    return [b[:2] for b in ok], out


def awkward_personal_texts(seed):
    rng = random.Random(seed)
    parts = [
        "mail jo.doe@ex-1.org", "write to ann (at) site (dot) net", "x@y", "a@b.c@d.e", "host 10.0.0.1", "1.2.3.4.5", "999.1.1.1", "ip: 010.200.3.44", "card 4111 1111 1111 1111", "4111111111111111", "visa 4111-1111-1111-1112",
        "4111111111111111 4111111111111111", "+49 170 1234567", "tel (030) 123 4567", "call 030-1234-5678", "+1 (555) 010-9999", "2024-01-02", "v1.2.3", "é中", "\n", "id=12345678901234", "3.14", "kontakt: z@q.io.",
    ]
    return [(i, rng.choice((" ", ", ", "; ", "")).join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))) for i in range(400)] + [(900, None), (901, "")]


def test_pii_training_counts_and_choice_of_spans_are_those_of_brute_force(spark, monkeypatch):
    rows = awkward_personal_texts(3)
    table = docs(spark, rows)
    aside = {r["doc_id"]: r["a"] for r in table.select("doc_id", (F.pmod(F.xxhash64("text", F.lit(5)), F.lit(pii.FOLDS)) == 0).alias("a")).collect()}
    counts = [{}, {}]
    for i, t in rows:
        for k, kind in enumerate(pii.KINDS):
            for _, _, code, label, _ in proposals_brute(t or "", kind)[1]:
                if label is not None:
                    n = counts[aside[i]].setdefault(code + (1 << (pii.N_FEATURES + k)), [0.0, 0.0])
                    n[0], n[1] = n[0] + label, n[1] + 1 - label
    given, boosted, thresholds = {}, pii.boosted, pii.thresholds
    monkeypatch.setattr(pii, "boosted", lambda rows: given.setdefault("seen", rows) and boosted(rows))
    monkeypatch.setattr(pii, "thresholds", lambda trees, rows, precision: given.setdefault("aside", rows) and thresholds(trees, rows, precision))
    trees, least = pii.train(table)
    for name, a in (("seen", False), ("aside", True)):
        assert [r[0] for r in given[name]] == sorted(counts[a]), name
        assert np.allclose([r[1:] for r in given[name]], [counts[a][k] for k in sorted(counts[a])]), name
    assert any(v is not None for v in least.values())

    # Low thresholds, so that overlapping proposals compete.
    for model in ((trees, least), (trees, dict.fromkeys(pii.KINDS, -9.0)), (trees, {"email": -9.0, "ip": None, "card": 0.0, "phone": -1.0})):
        got = {r["doc_id"]: r for r in pii.find_pii(table, model).collect()}
        added = 0
        for i, t in rows:
            spans = []
            for k, kind in enumerate(pii.KINDS):
                base, more = proposals_brute(t or "", kind)
                kept = []
                if model[1][kind] is not None:
                    score = lambda code: float(pii.tree_score(trees, np.array([code + (1 << (pii.N_FEATURES + k))]))[0])  # noqa: E731, B023
                    for x in sorted((-score(code), s, e) for s, e, code, _, covered in more if not covered):
                        if x[0] <= -model[1][kind] and not any(y[1] < x[2] and x[1] < y[2] for y in kept):
                            kept.append(x)
                added += len(kept)
                spans += [(kind, s, e) for s, e in sorted([*base, *((s, e) for _, s, e in kept)])]
            assert [tuple(x) for x in got[i]["spans"]] == spans, t
        assert added > 0


def test_pii_of_repeated_rows_and_clashing_names(spark):
    table = spark.createDataFrame([(1, "a@b.cd", "x", "y", 7, 8), (1, "a@b.cd", "x", "y", 7, 8), (None, None, None, None, None, None)], "doc_id long, text string, base string, spans string, n_email int, n_ip int")
    got = pii.find_pii(table).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_email"], r["n_ip"], [tuple(x) for x in r["spans"]]) for r in got] == [(None, 0, 0, []), *[(1, 1, 0, [("email", 0, 6)])] * 2]


def test_pii_listing_matches_its_digest(spark):
    r = pii.find_pii(docs(spark, [(1, "q@r.st 1.2.3.4")])).select(F.sha2(pii.listed(F.col("base")), 256).alias("x")).first()
    assert r["x"] == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()


def test_embedding_near_dedup(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for _ in range(40):
        base = rng.normal(size=12)
        for _ in range(rng.integers(1, 5)):
            rows.append((i, [float(x) for x in base + rng.normal(size=12) * rng.choice([0.0, 0.1, 0.25])]))
            i += 1
    rows += [(300 + k, [0.5] * 12) for k in range(50)] + [(400, None), (401, [0.0] * 12), (402, [None] * 12), (403, [float("nan")] * 12), (404, [1.0, 0.0]), (405, [2.0, 0.0]), (406, [])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(vectors(spark, rows), 0.95, tile_rows=16).collect()}
    good = {k: np.asarray(v, "float32").astype(float) for k, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a]) / np.sqrt(good[b] @ good[b]) >= 0.95]
    want = groups(links, [k for k, _ in rows])
    count = {k: sum(k in p for p in links) for k, _ in rows}
    assert {k: (r["n_links"], r["component_id"], r["kept"]) for k, r in got.items()} == {k: (count[k], c, c == k) for k, c in want.items()}
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_embedding_near_dedup_of_huge_and_tiny_vectors(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [0.0, 1e-200]), (4, [0.0, 2e-200]), (5, [5e-324, -5e-324])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(table).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_line_dedup(spark):
    long_line = " ".join(f"word{i} turns" for i in range(60))
    rows = [(1, f"{long_line}\nunique one here"), (2, f"{long_line}\n\nother text stands"), (3, long_line.replace("word30", "WORD31x")), (4, None), (5, ""), (6, "short\nshort\n \nlast"), (7, "short"), (None, "short"), (8, "z" * 30000), (8, "z" * 30000)]
    got = [(r["doc_id"], r["text"], r["dropped"]) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()]
    by_id = {i: (t, d) for i, t, d in got}
    assert len(got) == len(rows)
    assert by_id[1] == (rows[0][1], []) and by_id[2] == ("\nother text stands", [0]) and by_id[3] == ("", [0])
    assert by_id[4] == (None, []) and by_id[5] == ("", []) and by_id[6] == ("short\n \nlast", [1]) and by_id[7] == ("", [0]) and by_id[None] == ("short", [])
    assert [d for i, _, d in got if i == 8] == [[], []]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_finds_what_brute_force_finds(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    lines = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(40)]
        lines += [" ".join(base), " ".join(base[:20] + [rng.choice(vocabulary)] + base[21:])]
    rows = [(i, x) for i, x in enumerate(lines)]
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    want = {i for i, c in groups(links, range(len(lines))).items() if i != c}
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect() if r["dropped"]}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 40


def line_links(rows, under=8, over=10):
    """Documents dropped by brute force over all pairs of lines, one line a document."""
    sets = {d: {t.lower()[i : i + 8] for i in range(max(1, len(t) - 7))} for d, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and over * len(sets[a] & sets[b]) >= under * len(sets[a] | sets[b])]
    return {d for d, c in groups(pairs, ids).items() if d != c}


def test_line_dedup_of_single_tokens_and_scripts_without_spaces(spark):
    rng, rows = random.Random(5), []
    for base, letters in enumerate(("abcdefghijklmnopqrstuvwxyz0123456789/", "".join(map(chr, range(0x1780, 0x17A0))), "".join(map(chr, range(0x1000, 0x1020))))):
        for _ in range(12):
            body = "".join(rng.choices(letters, k=300))
            rows += [(len(rows), "https://www." * (base == 0) + body), (len(rows) + 1, "".join(rng.choices(letters, k=12)) + body[12:])]
    want = line_links(rows)
    assert len(want) == 36
    assert {r["doc_id"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect() if r["dropped"]} == want


def test_line_dedup_of_lines_that_repeat_themselves(spark):
    rows = list(enumerate(["-" * 40, "-" * 80, "=" * 30, "=" * 300, "." * 20, "." * 64, "abc" * 10, "abc" * 40]))
    assert line_links(rows) == {1, 3, 5, 7}
    assert {r["doc_id"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect() if r["dropped"]} == {1, 3, 5, 7}


def test_line_dedup_of_a_common_passage(spark):
    rng, rows = random.Random(9), []
    text = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    passage = text(320)
    for _ in range(60):
        tail = text(80)
        rows += [passage + tail, passage + tail[:40] + text(40)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = line_links(rows)
    assert len(want) == 60
    assert {r["doc_id"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect() if r["dropped"]} == want


def test_line_dedup_of_clashing_names_and_repeated_rows(spark):
    rows = [(1, "one line here\nanother", 7, "x", 9), (1, "one line here\nanother", 7, "x", 9), (2, "another\none line here", 8, None, None), (None, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, dropped string, h long")
    got = line_dedup.dedup_lines(table)
    assert got.columns == ["doc_id", "text", "h", "n_lines", "n_kept", "dropped"]
    # Rows that repeat an id share places, so what stays of one stays of the other.
    assert sorted(((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_kept"], r["dropped"]) for r in got.collect()), key=repr) == sorted(
        [(0, None, 1, 1, []), (1, rows[0][1], 2, 2, []), (1, rows[0][1], 2, 2, []), (2, "", 2, 0, [0, 1])], key=repr)


def just_alike(rng, base, vocabulary):
    """A line like ``base`` with a similarity of 0.80 to 0.83."""
    runs = lambda words: {t[i : i + 8] for t in [" ".join(words)] for i in range(len(t) - 7)}
    own = runs(base)
    while True:
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        other = runs(words)
        if 0.8 <= len(own & other) / len(own | other) < 0.83:
            return " ".join(words)


@pytest.mark.parametrize("crowd", [False, True])
def test_line_dedup_recall_near_the_threshold(spark, crowd):
    """Pairs that are only just alike: each by itself, and amid hundreds of lines that begin with the same words.

    Of the crowd's lines each pair has a passage in common with all others, so all share bands, and only the crowd's search
    can tell who belongs together.
    """
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(600)]
    common = [rng.choice(vocabulary) for _ in range(25)]
    lines = []
    for _ in range(150):
        base = (common if crowd else []) + [rng.choice(vocabulary) for _ in range(30 if crowd else 45)]
        lines += [" ".join(base), just_alike(rng, base, vocabulary)]
    rows = list(enumerate(lines))
    want = line_links(rows)
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect() if r["dropped"]}
    assert got <= want and len(want) >= 150 and len(got) >= 0.95 * len(want), (len(got), len(want))


def test_mixing(spark):
    rows = [(i, "abc"[0 if i % 3 else 1 + i % 2]) for i in range(900)] + [(i, None) for i in range(900, 1000)] + [(5, "a")]
    table = spark.createDataFrame([(i, s, 1) for i, s in rows], "doc_id long, source string, position int")
    weights = {"a": 0.2, "b": 0.3, "c": 0.4, None: 0.1}
    out = mixing.mix_sources(table, weights, block_docs=4, bucket_rows=50).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(len(rows))) and len(out) == len(rows)
    assert sorted((r["doc_id"], r["source"] or "") for r in out) == sorted((i, s or "") for i, s in rows)
    slots = sorted({(r["slot"], r["source"]) for r in out}, key=lambda x: x[0])
    assert len({s for s, _ in slots}) == len(slots)
    end = min(max(s for s, x in slots if x == y) for y in weights)
    for t in range(1, end + 1):
        for x, w in weights.items():
            assert abs(sum(1 for s, y in slots[:t] if y == x) - w * t) < 1
    again = mixing.mix_sources(table.repartition(7), weights, block_docs=4, bucket_rows=50).orderBy("position").collect()
    assert [(r["doc_id"], r["source"]) for r in again] == [(r["doc_id"], r["source"]) for r in out]
    assert mixing.mix_sources(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(table, {"a": 1.0})


def test_mixing_of_null_and_long(spark):
    table = spark.createDataFrame([(None, "a", None), (None, "a", None), (1, None, "x" * 200000), (1, "b", "")], "doc_id long, source string, text string")
    out = mixing.mix_sources(table).collect()
    assert sorted(r["position"] for r in out) == [0, 1, 2, 3] and sum(r["doc_id"] is None for r in out) == 2


def slots_one_by_one(weights, blocks):
    """Earliest deadline first among the released blocks, each slot by looking at every source; anew when one has run out."""
    left, out = {x: n for x, n in blocks.items() if n}, []
    order = sorted(left, key=lambda x: (x is not None, x))
    while left:
        names, start, done = [x for x in order if x in left], len(out), dict.fromkeys(left, 0)
        total = sum(weights[x] for x in names)
        while all(left[x] for x in names):
            t = len(out) - start
            able = [x for x in names if done[x] * total // weights[x] <= t]
            x = min(able, key=lambda x: (-(-(done[x] + 1) * total // weights[x]), names.index(x)))
            out.append(x)
            done[x] += 1
            left[x] -= 1
        left = {x: n for x, n in left.items() if n}
    return out


def expanded(segments):
    return [x for slots, times in segments for _ in range(times) for x in slots]


@pytest.mark.parametrize("weights", [(1, 1, 1), (141, 173, 1, 777), (50, 21, 13, 8, 8), (5, 3, 2), (1,), (1, 4095)])
@pytest.mark.parametrize("blocks", [7, 1000])
def test_periods_are_the_schedule_slot_by_slot(weights, blocks):
    rng = random.Random(blocks)
    share = dict(enumerate(weights))
    for _ in range(3):
        n = {x: rng.randrange(1, blocks) for x in share}
        assert expanded(mixing.pfair_segments(share, n)) == slots_one_by_one(share, n)
    many = {x: w * 10**9 + 1 for x, w in share.items()}
    assert sum(len(slots) for slots, _ in mixing.pfair_segments(share, many)) < 4 * len(share) * sum(weights)
    assert sum(len(slots) * times for slots, times in mixing.pfair_segments(share, many)) == sum(many.values())


@pytest.mark.parametrize("weights", [(1 / 3, 1 / 3, 1 / 3), (0.5, 0.21, 0.13, 0.08, 0.08), (141, 173, 1, 777)])
def test_pfair_slots_stay_within_a_block(weights):
    share = dict(enumerate(weights))
    total, slots = sum(weights), 200_000
    got = expanded(mixing.pfair_segments(share, {x: int(slots * w / total) for x, w in share.items()}))
    counts = dict.fromkeys(share, 0)
    for t, x in enumerate(got[: slots - 3000], 1):
        counts[x] += 1
        if t % 97 == 0:
            assert all(abs(counts[y] - share[y] * t / total) < 1 + 1e-6 for y in share)


def test_pfair_starts_anew_when_a_source_has_run_out():
    got = expanded(mixing.pfair_segments({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 300, "c": 200}))
    assert len(got) == 510 and max(k for k, x in enumerate(got) if x == "a") <= 20
    rest = got[max(k for k, x in enumerate(got) if x == "a") + 1 :]
    assert all(abs(rest[:t].count("b") - 0.6 * t) < 1 for t in range(1, 400))
    with pytest.raises(ValueError):
        mixing.pfair_segments({"a": 2**0.5, "b": 3**0.5}, {"a": 10, "b": 300})


@pytest.mark.parametrize("size", [1, 4, 16])
def test_positions_are_those_of_the_schedule_slot_by_slot(spark, size):
    """A source's rows in their order, dealt out block by block as the slots say."""
    rng = random.Random(size)
    rows = [(i, rng.choice(["a"] * 12 + ["b"] * 5 + ["c", "d", None])) for i in range(1500)] + [(9, "a"), (9, "a"), (None, "b")]
    table = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 7, "b": 5, "c": 1, "d": 2, None: 3}
    got = mixing.mix_sources(table, weights, block_docs=size, bucket_rows=100).orderBy("position").collect()
    of = {x: [r["doc_id"] for r in got if r["source"] == x] for x in weights}
    # Within a source the order is one of hashes, whatever the weights, blocks and buckets are.
    plain = mixing.mix_sources(table, dict.fromkeys(weights, 1), block_docs=1, bucket_rows=10_000).orderBy("position").collect()
    assert of == {x: [r["doc_id"] for r in plain if r["source"] == x] for x in weights}
    want, at = [], dict.fromkeys(weights, 0)
    for slot, x in enumerate(slots_one_by_one(weights, {x: -(-len(ids) // size) for x, ids in of.items()})):
        want += [(x, i, at[x] // size, slot) for i in of[x][at[x] : at[x] + size]]
        at[x] += size
    assert [(r["source"], r["doc_id"], r["block"], r["slot"]) for r in got] == want and [r["position"] for r in got] == list(range(len(rows)))


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{sf}/documents.parquet")
    now, seen = first, []
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, now, sf)
        assert after.columns == first.columns, name
        rows = after.toPandas()
        seen.append(rows)
        now = spark.createDataFrame(rows, first.schema)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in first.collect()} - set(seen[0]["doc_id"])
    assert sum(labels.get(i) == 0 for i in gone) <= 1
    _, want = jaccard_brute(list(zip(seen[1]["doc_id"], seen[1]["text"])), 5, 8, 10)
    assert set(seen[2]["doc_id"]) == {i for i, c in want.items() if i == c}
    assert sorted(seen[3]["doc_id"]) == sorted(seen[2]["doc_id"])
    last = pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(seen[3]["doc_id"]) and all(r["round_trip"] and r["position"] is None for r in last)
    # Read from files, every document has its place in the mix, however the files are dealt out.
    mixed = spark.createDataFrame(seen[2], first.schema)
    pipeline.mix(spark, mixed, sf).write.parquet(f"{tmp_path}/mixed")
    want = {r["doc_id"]: r["position"] for r in mixing.mix_sources(mixed).collect()}
    for table in (spark.read.parquet(f"{tmp_path}/mixed"), spark.read.parquet(f"{tmp_path}/mixed").repartition(7)):
        got = pipeline.STAGES[-1][1](spark, table, sf).collect()
        assert {r["doc_id"]: r["position"] for r in got} == want and sorted(want.values()) == list(range(len(want)))


def test_pipeline_of_awkward_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, position long, h long"
    body = " ".join(f"word{i} stands" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "no id"), (None, "no id"), (5, body), (5, body), (6, body.replace("word30", "w")), (7, "long " * 60_000), (8, "x" * 100_000), (9, "one\none\ntwo")]
    table = spark.createDataFrame([(i, t, None if i == 9 else "en", None if i == 2 else "s", None, 0.5, 7, 1) for i, t in rows], columns)
    now = table
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, table.limit(0), sf).count() == 0, name
        after = stage(spark, now, sf)
        assert after.columns == table.columns, name
        now = spark.createDataFrame(after.collect(), columns)
    kept = [(r["doc_id"], r["text"]) for r in now.collect()]
    # The text of 5 is in it twice and its near copy 6 loses its only line; what has no words or no id stays.
    assert sorted((i is None, i or 0) for i, _ in kept) == sorted((i is None, i or 0) for i in (1, 2, 3, None, None, 5, 5, 7, 8, 9))
    assert dict(kept)[9] == "one\ntwo"
    last = {r["doc_id"]: r for r in pipeline.STAGES[-1][1](spark, now, sf).collect()}
    assert last[1]["ids"] is None and last[2]["ids"] == [] and last[7]["round_trip"] and last[8]["round_trip"]
    assert pipeline.STAGES[-1][1](spark, table.limit(0), sf).count() == 0


def test_runs_of_one_component_bring_no_pair_together(spark):
    from lodestone.llm import line_dedup

    rows = [("a", 1, 5), ("b", 1, 5), ("a", 1, 6), ("c", 2, 6), ("c", 2, 7)]
    out = line_dedup.shared(spark.createDataFrame(rows, "h string, component long, r long"))
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, 6), ("c", 2, 6)]


@pytest.mark.parametrize("piece", [2, 2048])
def test_lines_of_a_crowd_meet_without_a_join_of_lines_and_runs(spark, monkeypatch, piece):
    """The pairs are those of brute force, and the plan that tells them joins nothing: before, a line and a run were a row of a join."""
    rng = random.Random(3)
    monkeypatch.setattr(line_dedup, "PIECE", piece)
    text = lambda k: "".join(rng.choices("abcdefghij klmnop", k=k))
    common, texts = text(60), []
    for _ in range(12):
        own = text(120)
        texts += [common + own, common + own[:-6] + text(6), common + text(150)]
    lines = spark.createDataFrame(list(enumerate(texts)), "h long, line string")
    many = lines.select("h", F.when(F.col("h") < 2, 0).otherwise(F.col("h")).alias("component"))
    sets = [{x.lower()[k : k + 8] for k in range(len(x) - 7)} for x in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])} - {(0, 1)}
    out = line_dedup.rare_pairs(lines, many, size=8, under=8, over=10)
    assert want <= {(r["a"], r["b"]) for r in out.collect()} and len(want) >= 11
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_signatures_are_of_whole_numbers_of_32_bits(spark):
    lines = spark.createDataFrame([(1, "some words that are here to be signed " * 3)], "h long, line string")
    assert dict(line_dedup.with_minima(lines, 8).dtypes)["minima"] == "array<array<int>>"


def test_pairs_of_lines_are_compared_a_slice_at_a_time(spark, monkeypatch):
    """Texts and signatures move with few pairs at once, and every link is found all the same."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=30)) for _ in range(8)]
    rows = [(8 * k + i, b + f" x{k}") for k in range(6) for i, b in enumerate(base)]
    seen = []

    def noted(df, name="table", put=line_dedup.written):
        out = put(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(line_dedup, "written", noted)
    monkeypatch.setattr(line_dedup, "SLICE", 8)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert {i for i, d in got.items() if d} == {i for i, _ in rows if i >= 8}
    compared = [n for name, n in seen if name == "overlaps"]
    assert len(compared) > 4 and max(compared) < sum(compared) / 2 and sum(compared) >= 40


def test_rarity_of_runs_goes_by_a_byte_for_each_slot_and_slots_go_by_lines(spark):
    marks = line_dedup.rarity(spark.createDataFrame([(0,)] + [(65535,)] * 16 + [(-1,)] * 3, "r long"), 16).first()["marks"]
    assert len(marks) == 65536 and marks[0] == 1 and marks[1] == 1 and marks[65535] == 1 + 17
    lines = spark.range(3000).select(F.col("id").alias("h"), F.sha2(F.col("id").cast("string"), 256).alias("line"))
    many = lines.select("h", F.col("h").alias("component"))
    sizes = []
    real, line_dedup.rarity = line_dedup.rarity, lambda runs, bits: sizes.append(bits) or real(runs, bits)
    try:
        assert line_dedup.rare_pairs(lines, many, size=8, under=8, over=10).count() == 0
    finally:
        line_dedup.rarity = real
    assert sizes == [18]


def test_embedding_tiles_meet_in_rounds_that_send_no_more_than_the_table(spark, monkeypatch):
    """The rows are those of brute force; a round has few blocks, so no plan sends a tile to all that it meets."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(70, 6))
    rows = [(k, [float(x) for x in base[k % 70] + rng.normal(size=6) * 0.15]) for k in range(280)]
    put, names = embedding_dedup.written, []
    monkeypatch.setattr(embedding_dedup, "written", lambda df, name="table": names.append(name) or put(df, name))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(vectors(spark, rows), 0.95, tile_rows=8, round_bytes=0).collect()}
    v = np.array([x for _, x in rows], "float32").astype(float)
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    near = v @ v.T >= 0.95
    links = [(a, b) for a in range(280) for b in range(a) if near[a, b]]
    want = groups(links, range(280))
    assert {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == {k: (int(near[k].sum()) - 1, want[k]) for k in range(280)}
    assert names.count("tiles") == 1 and names.count("links") > 4


def test_ngram_join_leaves_out_copies_not_ids_and_deletes_what_it_is_done_with(spark):
    """An id that is a copy by one set and a representative by another enters; large tables go once they were read."""
    from lodestone.operators.shared import exists, made_so_far

    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, a), (None, a), (5, None)]
    before = set(made_so_far(spark))
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_join.jaccard_join(docs(spark, rows), n=5).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 1), (4, 1), (5, 5)]
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in made_so_far(spark) if p not in before and exists(spark, p)]
    assert left.count("members") == 1 and "sets" not in left
