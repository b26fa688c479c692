import hashlib
import math
import random
import re
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import hashes
from lodestone.operators import aggregates as agg
from lodestone.operators import layout, matching, ranking, state
from lodestone.plans import memory, study
from lodestone.sources import shards
from lodestone.streaming import feeds


def test_greedy_keeps_first(spark):
    df = spark.createDataFrame([("s", 1, 0b0), ("s", 2, 0b111), ("s", 3, 0b111111), ("s", 4, 0b111111)], "s string, n int, h long")
    assert [r["n"] for r in matching.greedy_first(df, ["s"], ["n"], "h", 3).orderBy("n").collect()] == [1, 3]


def test_greedy_is_the_fold_and_no_group_is_one_task(spark):
    rng = random.Random(4)
    near = lambda h: h ^ sum(1 << b for b in rng.sample(range(60), rng.randrange(4)))
    hashes = [rng.getrandbits(60) for _ in range(10)]
    for _ in range(150):
        hashes.append(near(rng.choice(hashes)))
    rows = [("st"[i % 2] if i % 5 else None, i, None if i % 40 == 7 else h) for i, h in enumerate(hashes)]
    want, kept = [], {}
    for s, n, h in rows:
        if h is None or all((h ^ k).bit_count() > 3 for k in kept.get(s, [])):
            want.append(n)
            kept.setdefault(s, []).extend([] if h is None else [h])
    out = matching.greedy_first(spark.createDataFrame(rows, "s string, n int, h long"), ["s"], ["n"], "h", 3)
    assert sorted(r["n"] for r in out.collect()) == want and len(want) < 120
    assert "InPandas" not in out._jdf.queryExecution().toString()


def test_question_set_runs_over_documents(spark):
    out = entry.queries()["q6_question_set"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.columns == ["doc_id", "fingerprint"] and docs.count() > out.count() > 40


def test_images_within_five_bits(spark):
    rng = random.Random(6)
    base = [[rng.random() < 0.5 for _ in range(64)] for _ in range(8)]
    grids = [[float(x != (i in flips)) for i, x in enumerate(b)] for b in base for flips in [rng.sample(range(64), k) for k in (0, 2, 4)]]
    df = spark.createDataFrame(list(enumerate(grids)), "id long, v array<double>").select("id", hashes.packed(hashes.average_hash(F.col("v"))).alias("h"))
    want = {(a, b) for a in range(24) for b in range(a + 1, 24) if sum(x != y for x, y in zip(grids[a], grids[b], strict=True)) <= 5}
    assert {(r["a"], r["b"]) for r in matching.near_hashes(df, "id", "h", 5).collect()} == want and len(want) >= 16


def test_bodies_by_two_keys(spark):
    out = entry.queries()["j9_bodies"](spark, "/root/testdata/sf0.001")
    t = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").count() for n in ("orders", "customer")}
    assert out.count() == sum(t.values()) and out.where("body is not null and (id % 2 = 0) <> (kind = 'mistake')").count() == 0
    assert entry.queries()["j5_near_images"](spark, "/root/testdata/sf0.001").where("distance > 5").count() == 0


def test_bands_find_what_brute_force_finds(spark):
    df = spark.range(60).select("id", F.pmod(F.xxhash64(F.col("id") % 20), F.lit(1 << 58)).alias("h"))
    df = df.withColumn("h", F.when(F.col("id") % 3 == 0, F.col("h").bitwiseXOR(5)).otherwise(F.col("h")))
    rows = df.collect()
    least = {}
    for r in rows:
        least[r["h"]] = min(r["id"], least.get(r["h"], r["id"]))
    want = {(min(least[x], least[y]), max(least[x], least[y])) for x in least for y in least if x != y and (x ^ y).bit_count() <= 3}
    same = {(least[r["h"]], r["id"]) for r in rows if r["id"] != least[r["h"]]}
    got = matching.near_hashes(df, "id", "h").collect()
    assert {(r["a"], r["b"]) for r in got if r["distance"]} == want and {(r["a"], r["b"]) for r in got if not r["distance"]} == same and want and same


def test_upsert_keeps_stale_vectors(spark):
    old = spark.createDataFrame([("a", "m", "fact", "old", [1.0, 0.0], 0.9)], "account_id string, id string, kind string, text string, vec array<double>, importance double")
    new = spark.createDataFrame(
        [("a", 1, "x", "goal", "turned", [0.95, 0.3], 0.1), ("a", 2, "y", "goal", "again", [1.0, 0.0], 0.2), ("a", 3, "z", "goal", "other", [0.0, 1.0], 0.2), ("b", 1, "w", "fact", "first", [1.0], 0.4)],
        "account_id string, seq long, id string, kind string, text string, vec array<double>, importance double",
    )
    got = {r["id"]: (r["text"], r["importance"], r["op"]) for r in matching.semantic_upsert(old, new).collect()}
    assert got == {"m": ("again", 0.9, "update"), "z": ("other", 0.2, "add"), "w": ("first", 0.4, "add")}


def vectors_by_account(rng, n=70):
    near = lambda v: [x + rng.gauss(0, 0.15) for x in v]
    base = [[1.0, 0.2, -0.3, 0.0], [0.1, 1.0, 0.4, 0.2], [-0.5, 0.1, 1.0, 0.3], [0.7, 0.7, 0.0, -0.2], [0.0, -0.4, 0.2, 1.0]]
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, near(rng.choice(base))) for i in range(n)]
    return [*rows, ("a", n, [0.0] * 4), ("a", n + 1, [1.0]), ("a", n + 2, None), ("a", n + 3, []), ("b", n + 4, rows[0][2]), ("b", n + 5, rows[0][2]), ("c", n + 6, rows[0][2])]


def cosine_brute(a, b):
    norm = math.sqrt(sum(x * x for x in a or []) * sum(x * x for x in b or []))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm and len(a) == len(b) else 0.0


@pytest.mark.parametrize("block", [1024, 7])
def test_blocks_of_vectors_find_what_pairs_find(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    rng = random.Random(5)
    stored, asked = vectors_by_account(rng), [(a, 1000 + i, v) for a, i, v in vectors_by_account(rng)]
    table = lambda rows: spark.createDataFrame(rows, "account_id string, id long, vec array<float>")
    stored, asked = ([(a, i, None if v is None else [float(np.float32(x)) for x in v]) for a, i, v in rows] for rows in (stored, asked))
    got = matching.nearest(table(asked).toDF("account_id", "cid", "cvec"), table(stored).withColumn("seq", F.col("id")), 0.9, keys=["account_id"])
    want = {}
    for a, c, v in asked:
        best = max(((cosine_brute(v, w), -i) for b, i, w in stored if a is not None and a == b and w is not None and v is not None), default=(0.0, 0))
        want[c] = (-best[1], best[0]) if best[0] >= 0.9 else (None, None)
    assert {r["cid"]: (r["id"], r["sim"] and pytest.approx(r["sim"])) for r in got.collect()} == want and sum(i is not None for i, _ in want.values()) > 20
    alone = {i for a, i, v in stored if any(a is not None and a == b and i != j and cosine_brute(v or [], w or []) >= 0.97 for b, j, w in stored)}
    assert {r["id"] for r in matching.exists_similar(table(stored), ["account_id"], 0.97).collect()} == alone and len(alone) > 20


def test_turns_are_retrieved_as_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(memory, "BLOCK_TURNS", 5)
    rng = random.Random(6)
    schema = "id string, account_id string, kind string, text string, embedding array<double>, importance double, status string, use_count long, updated_at timestamp"
    facts = [(f"f{i}", a, "fact", f"t{i}", v, rng.random(), rng.choice(["active", "active", "superseded"]), i % 9, datetime(2024, 1, 1 + i % 28)) for a, i, v in vectors_by_account(rng)]
    turns = [(i, a, v) for a, i, v in vectors_by_account(random.Random(7), 25)] + [(900, "nobody", [1.0] * 4)]
    now, gone = F.lit("2024-02-01").cast("timestamp"), spark.createDataFrame([(0, "f1"), (3, "f2"), (5, "f3")], "turn_id long, id string")
    table = spark.createDataFrame(facts, schema)
    got = memory.retrieve_turns(table, spark.createDataFrame(turns, "turn_id long, account_id string, query array<double>"), now, k=4, min_score=0.3, exclude=gone).collect()
    for t, a, v in turns:
        mine = sorted((r for r in got if r["turn_id"] == t), key=lambda r: r["rank"])
        want = [] if not v or a is None else memory.retrieve(table, v, now, account=a, k=4, min_score=0.3, exclude=gone.where(F.col("turn_id") == t).select("id")).collect()
        want = sorted(want, key=lambda r: (-r["score"], r["id"]))
        assert [(r["id"], r["score"], r["semantic"]) for r in mine] == [(r["id"], r["score"], r["semantic"]) for r in want], t
    assert len(got) > 60


def test_upsert_is_the_fold_one_by_one(spark):
    rng = random.Random(8)
    old = [(a or "a", f"s{i:03}", "fact", f"t{i}", v or [1.0], rng.random()) for a, i, v in vectors_by_account(rng, 30)]
    new = [(a or "b", i, f"n{i:03}", "goal", f"u{i}", v or [], rng.random()) for a, i, v in vectors_by_account(rng, 50)]
    want = {}
    for account in {r[0] for r in [*old, *new]}:
        rows = [[r[1], r[3], r[4], r[4], r[5], "keep"] for r in sorted(old, key=lambda r: r[1]) if r[0] == account]
        for _, _, i, _, t, v, importance in sorted((r for r in new if r[0] == account), key=lambda r: r[1]):
            sims = [cosine_brute(v, r[2]) for r in rows]
            best = max(range(len(sims)), key=lambda k: (sims[k], -k), default=None)
            if best is not None and sims[best] > 0 and sims[best] >= 0.95:
                rows[best][1], rows[best][4] = t, max(rows[best][4], importance)
                rows[best][5] = "add" if rows[best][5] == "add" else "update"
            else:
                rows.append([i, t, v, v, importance, "add"])
        want |= {(account, r[0]): (r[1], r[4], r[5]) for r in rows}
    stored = spark.createDataFrame(old, "account_id string, id string, kind string, text string, vec array<double>, importance double")
    offered = spark.createDataFrame(new, "account_id string, seq long, id string, kind string, text string, vec array<double>, importance double")
    assert {(r["account_id"], r["id"]): (r["text"], r["importance"], r["op"]) for r in matching.semantic_upsert(stored, offered, least=0.95).collect()} == want
    assert {op for _, _, op in want.values()} == {"keep", "update", "add"}
    with pytest.raises(Exception, match="prune it"):
        matching.semantic_upsert(stored, offered, cap=3).collect()


def test_excluding_does_not_refill(spark):
    facts = spark.createDataFrame([(c, "a", "fact", c, [1.0, x], 0.5, "active", 0, datetime(2024, 1, 1)) for c, x in (("A", 0.0), ("B", 0.5), ("C", 1.0))], "id string, account_id string, kind string, text string, embedding array<double>, importance double, status string, use_count long, updated_at timestamp")
    got = memory.retrieve(facts, [1.0, 0.0], F.lit("2024-01-01").cast("timestamp"), k=2, exclude=spark.createDataFrame([("A",)], "id string"))
    assert [r["id"] for r in got.collect()] == ["B"]


def test_state(spark):
    df = spark.createDataFrame([("1", "active", 3), ("2", "active", 1), ("3", "active", 2)], "id string, status string, importance int")
    df = df.withColumns({"account_id": F.lit("a"), "use_count": F.lit(0), "updated_at": F.lit(0)})
    assert {r["id"] for r in state.prune(df, cap=2).where("status = 'superseded'").collect()} == {"2"}
    with pytest.raises(ValueError):
        state.set_status(df, ["1"], "gone")
    empty = df.limit(0)
    assert state.prune(empty).count() == 0 and state.upsert(df, empty, "id").count() == 3


def test_pages(spark):
    out = ranking.page(spark.range(7), 2, 3, F.col("id")).orderBy("id").collect()
    assert [(r["id"], r["total"], r["has_prev"], r["has_next"], r["first"], r["last"]) for r in out] == [(i, 7, True, True, 4, 6) for i in (3, 4, 5)]


LINES = "page string, x double, y double, w double, h double, text string, confidence double"


def found(spark, rows, **how):
    out = layout.regions(spark.createDataFrame(rows, LINES), **how).orderBy("page", "index").collect()
    return [(r["index"], r["text"]) for r in out], [[round(r[c], 6) for c in ("x", "y", "w", "h")] for r in out]


def test_regions_by_question_numbers(spark):
    rows = [("p", 0.1, y, 0.8, 0.04, t, 0.9) for y, t in ((0.02, "head"), (0.1, "1. one"), (0.15, "more"), (0.5, "2. two"), (0.9, " "), (0.95, None))]
    texts, boxes = found(spark, rows)
    assert texts == [(1, "1. one\nmore"), (2, "2. two")]
    # Contents reach from 0.04 to 0.96, and the text is narrower, so crops are as wide, and 0.012 more all around. The first ends at
    # the second; the last grows to its column's end (0.54 + 5 * 0.04), but 0.42 or 14 lines are the cap, which is beyond.
    assert boxes[0] == [pytest.approx(v, abs=1e-6) for v in (0.028, 0.088, 0.944, 0.488 - 0.1 + 0.024)]
    assert boxes[1] == [pytest.approx(v, abs=1e-6) for v in (0.028, 0.488, 0.944, 0.32 + 0.024)]


def test_regions_by_gaps_below_the_whole_block(spark):
    plain = [("p", 0.1, y, 0.8, h, t, 0.9) for y, h, t in ((0.02, 0.04, "a"), (0.07, 0.04, "b"), (0.4, 0.04, "c"))]
    assert found(spark, plain)[0] == [(1, "a\nb"), (2, "c")]
    # The tall line reaches down to 0.5, so what stands beside its end belongs to its block although the line before ended at 0.14.
    tall = [("p", 0.1, 0.02, 0.2, 0.48, "tall", 0.9), ("p", 0.4, 0.1, 0.2, 0.04, "b", 0.9), ("p", 0.4, 0.5, 0.2, 0.04, "c", 0.9), ("p", 0.1, 0.9, 0.2, 0.04, "d", 0.9)]
    assert found(spark, tall)[0] == [(1, "tall\nb\nc"), (2, "d")]
    # One numbered line is no grid of numbers, but it starts a block.
    assert found(spark, [*plain[:1], ("p", 0.1, 0.07, 0.8, 0.04, "3) b", 0.9)])[0] == [(1, "a"), (2, "3) b")]
    assert found(spark, []) == ([], []) and found(spark, [("p", 0.1, 0.1, 0.1, 0.1, "  ", 0.5)]) == ([], [])


def test_two_columns(spark):
    rows = [("p", x, 0.1 * i, 0.35, 0.04, f"{i + 1}. {side}", 0.9) for i in range(4) for x, side in ((0.05, "left"), (0.55, "right"))]
    assert layout.column_split(spark.createDataFrame(rows, LINES)).first()["split_x"] == pytest.approx(0.475)
    assert layout.column_split(spark.createDataFrame(rows[::2], LINES)).count() == 0
    # A line across the middle for every four others is allowed, a second one is not.
    across = [("p", 0.12, 0.5 + 0.1 * i, 0.75, 0.04, "across", 0.9) for i in range(3)]
    assert layout.column_split(spark.createDataFrame(rows + across[:1], LINES)).count() == 1 and layout.column_split(spark.createDataFrame(rows + across, LINES)).count() == 0
    texts, boxes = found(spark, rows, by_column=True)
    assert [t for _, t in texts] == [f"{i + 1}. {side}" for i in range(4) for side in ("left", "right")]
    assert all(b[0] + b[2] <= 0.475 + 0.0121 or b[0] >= 0.475 - 0.0121 for b in boxes)
    mixed = [("p", x, 0.1 * i + dy, 0.35, 0.04, t, 0.9) for i in range(4) for x, dy, t in ((0.05, 0.0, f"{i + 1}. left"), (0.55, 0.05, "right"))]
    assert found(spark, mixed)[0][0] == (1, "1. left\nright") and sorted(t for _, t in found(spark, mixed, by_column=True)[0])[0] == "1. left"


def test_layout_is_one_shuffle_and_no_python(spark):
    plan = layout.regions(spark.createDataFrame([("p", 0.1, 0.1, 0.2, 0.1, "a", 0.5)], LINES), by_column=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Pandas" not in plan


def test_layout_makes_nothing_twice(spark):
    # An average, a fold into blocks and an average of confidences; the fold was made again to ask whether it found a block, and
    # text was stripped by a pattern, twice for a line and twice for a block.
    plan = layout.regions(spark.createDataFrame([("p", 0.1, 0.1, 0.2, 0.1, "a", 0.5)], LINES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 3 and "regexp_replace" not in plan


def test_straightening(spark):
    from lodestone.functions import geometry

    corners = lambda *ps: [(float(x), float(y)) for x, y in ps]
    askew = corners((0.1, 0.05), (0.95, 0.0), (1.0, 0.9), (0.0, 1.0))
    cases = {
        "askew": (askew, True), "straight": (corners((0, 0), (1, 0), (1, 1), (0, 1)), False), "small": (corners((0.3, 0.3), (0.6, 0.25), (0.6, 0.6), (0.25, 0.6)), False),
        "sharp": (corners((0, 0), (1, 0.4), (0.75, 1), (0, 0.9)), True), "blunt": (corners((0, 0), (1, 0), (1, 1), (0.45, 0.6)), False), "none": (None, False), "three": (askew[:3], False), "point": (corners(*[(0.5, 0.5)] * 4), False),
    }
    quad = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(n, q) for n, (q, _) in cases.items()], f"n string, quad {quad}").select("n", geometry.worth_straightening(F.col("quad")).alias("ok"), geometry.angles(F.col("quad")).alias("a"))
    got = {r["n"]: r for r in df.collect()}
    fair = lambda n: all(50 <= a <= 135 for a in got[n]["a"])
    assert {n: r["ok"] for n, r in got.items() if n != "sharp"} == {n: ok for n, (_, ok) in cases.items() if n != "sharp"} and got["sharp"]["ok"] == fair("sharp") and not fair("blunt")
    quads = spark.createDataFrame([("p", [(0.2, cases["straight"][0]), (0.8, askew), (0.8, cases["small"][0])]), ("q", [(0.9, cases["straight"][0]), (0.8, askew)]), ("r", [])], f"page string, candidates array<struct<confidence:double,quad:{quad}>>")
    rows = [(p, 1, 0.0, 0.0, 1.0, 1.0) for p in "pqrs"] + [("p", 2, 0.5, 0.5, 0.05, 0.05)]
    out = layout.straightened_regions(spark.createDataFrame(rows, "page string, index int, x double, y double, w double, h double"), quads)
    assert {(r["page"], r["index"], r["straightened"], round(r["x"], 6), round(r["y"], 6), round(r["w"], 6), round(r["h"], 6)) for r in out.collect()} == {("p", 1, True, 0.0, 0.0, 1.0, 1.0), *((p, 1, False, 0.0, 0.0, 1.0, 1.0) for p in "qrs")}


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1), ("7", 2), ("a_b", 3), ("", 4), (None, 5)], "account_id string, n int")
    shards.write_shards(df, f"{tmp_path}/t")
    own = lambda a: sorted(r["n"] for r in shards.read_shard(spark, f"{tmp_path}/t", a).collect())
    assert [own(a) for a in ("a/b", "a_b", "7", "", None, "x")] == [[1], [3], [2], [4, 5], [4, 5], []]
    assert {r[0] for r in shards.accounts(shards.read_all(spark, f"{tmp_path}/t")).collect()} == {"a/b", "a_b", "7", "local", "", None}
    assert shards.table_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0
    assert shards.backup_then_truncate(spark, {"t": f"{tmp_path}/t"}, f"{tmp_path}/b", dry_run=True) == {"t": 5}


def test_intermediate_tables_can_be_deleted(spark):
    from lodestone.operators import shared

    table = shared.written(spark.range(3), "some")
    assert table.count() == 3 and shared.exists(spark, table.lodestone_path)
    assert shared.forget_written(spark) >= 1 and not shared.exists(spark, table.lodestone_path) and shared.forget_written(spark) == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_services(spark):
    from lodestone.sources.services import answered, embedding_column, reply_column

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r["v"] for r in df.select(embedding_column(lambda xs: [[float(len(x))] for x in xs], 1)(F.col("t")).alias("v")).collect()] == [[2.0], [0.0]]
    assert [r["v"] for r in df.select(reply_column(lambda p: p[0])(F.col("t")).alias("v")).collect()] == ["a", ""]
    got = [r["v"] for r in df.select(answered(lambda p: p[0])(F.col("t")).alias("v")).collect()]
    assert (got[0]["reply"], got[0]["error"], got[1]["reply"]) == ("a", None, None) and got[1]["error"].startswith("IndexError")


def test_extract_and_store(spark):
    facts = spark.createDataFrame([("m", "a", "fact", "old fact", [1.0, 0.0], 0.9, "active", 2, datetime(2024, 1, 1))], "id string, account_id string, kind string, text string, embedding array<double>, importance double, status string, use_count long, updated_at timestamp")
    reply = '```json\n[{"text": "new fact", "kind": "GOAL", "importance": "x"}, {"text": "abc"}, 3]\n```'
    replies = spark.createDataFrame([("a", "e1", reply), ("a", "e2", "no json")], "account_id string, event_id string, reply string")
    out = memory.extract_and_store(facts, replies, lambda t: F.array(F.lit(0.0), F.lit(1.0)))
    assert {(r["id"], r["kind"], r["text"], r["importance"], r["op"]) for r in out.collect()} == {("m", "fact", "old fact", 0.9, "keep"), ("e1-0", "goal", "new fact", 0.5, "add")}


def test_extract_and_store_leaves_retired_facts_and_keeps_new_ones(spark):
    schema = "id string, account_id string, kind string, text string, embedding array<double>, importance double, status string, use_count long, updated_at timestamp"
    facts = spark.createDataFrame([("old", "a", "fact", "gone", [0.0, 1.0], 0.9, "superseded", 9, datetime(2024, 1, 1))] + [(f"m{i}", "a", "fact", f"f{i}", [1.0, i / 1.0], 0.5, "active", 0, datetime(2024, 1, 1 + i)) for i in range(2)], schema)
    reply = "[" + ", ".join(f'{{"text": "item number {i}", "kind": "fact", "importance": "0.5"}}' for i in range(12)) + "]"
    replies = spark.createDataFrame([("a", "e", reply)], "account_id string, event_id string, reply string")
    vectors = F.when(F.col("text").endswith("number 0"), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(-1.0), F.lit(0.0)))
    now = F.lit("2024-06-01").cast("timestamp")
    got = {r["id"]: r for r in memory.extract_and_store(facts, replies, lambda t: vectors, now=now, cap=3).collect()}
    assert got["old"]["status"] == "superseded" and got["old"]["text"] == "gone" and got["old"]["op"] == "keep"
    # The first item is new although a retired fact is the same; the last of those that are alike wins, by number and not by text.
    assert got["e-0"]["op"] == "add" and got["e-1"]["text"] == "item number 11"
    assert {i for i, r in got.items() if r["status"] == "active"} == {"e-0", "e-1", "m1"}
    assert got["e-0"]["updated_at"] == datetime(2024, 6, 1) and got["m0"]["updated_at"] == datetime(2024, 1, 1)


def test_scores_tie_after_rounding(spark):
    facts = spark.createDataFrame([(i, "a", "fact", i, [1.0, x], 0.5, "active", 0, datetime(2024, 1, 1)) for i, x in (("B", 0.001), ("A", 0.002))], "id string, account_id string, kind string, text string, embedding array<double>, importance double, status string, use_count long, updated_at timestamp")
    got = memory.retrieve(facts, [1.0, 0.0], F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r["id"], r["score"]) for r in got] == [("A", 0.85), ("B", 0.85)]


def test_block_column(spark):
    from lodestone.functions import geometry

    r = lambda *v: geometry.rect(*[F.lit(float(x)) for x in v])
    content, columns = r(0, 0, 1, 1), F.array(r(0, 0, 0.5, 1), r(0.5, 0, 0.5, 1))
    pick = lambda box: spark.range(1).select(layout.block_column(box, F.array(F.lit(0.7)), columns, content).alias("c")).first()["c"]["x"]
    assert pick(r(0.55, 0.1, 0.3, 0.1)) == 0.5 and pick(r(0.1, 0.1, 0.8, 0.1)) == 0.0


def simhash_brute(t):
    votes = [0] * 60
    for i in range(len(t) - 2):
        h = int(hashlib.md5(t[i : i + 3].encode()).hexdigest()[:15], 16)
        for b in range(60):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(60) if votes[b] > 0) if len(t) >= 3 else None


def test_simhash_counts_every_gram(spark):
    rng = random.Random(1)
    texts = ["", "ab", "abc", "a\U0001f600bc" * 50, "x" * 1000] + ["".join(rng.choice("abcdé中\U0001f600fgh") for _ in range(n)) for n in (3, 4, 62, 63, 64, 65, 66, 128, 129, 3000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", hashes.simhash(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in sorted(got)] == [simhash_brute(t) for t in texts]


def test_simhash_takes_linear_time(spark):
    """Ten times the text takes about ten times as long, not a hundred."""
    took = []
    for n in (40_000, 400_000):
        df = spark.createDataFrame([("".join(map(str, range(n)))[:n],)], "t string")
        began = time.perf_counter()
        df.select(hashes.simhash(F.col("t"))).collect()
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * max(took[0], 0.2)


QUESTIONS = "s string, n int, stem string, crop_hash long, box struct<x: double, y: double, w: double, h: double>"


def questions_brute(rows, short=12):
    plain = lambda t: re.sub(r"[\s,.!?;:]+", "", t.lower())
    bits = lambda a, b: (a ^ b).bit_count()
    seen, kept = {}, {}
    for s, n, stem, crop, box in sorted((r for r in rows if (r[2] or "").strip()), key=lambda r: r[1]):
        p = plain(stem)
        if p in seen.setdefault(s, set()):
            continue
        seen[s].add(p)
        mine = kept.setdefault(s, [])
        h = simhash_brute(p)
        mid = None if box is None else (box[0] + box[2] / 2, box[1] + box[3] / 2)
        if len(p) >= short:
            hit = any(k[1] is not None and bits(k[1], h) <= 3 for k in mine)
        else:
            hit = crop is not None and mid is not None and any(k[2] is not None and k[3] is not None and bits(k[2], crop) <= 5 and abs(k[3][0] - mid[0]) <= 0.05 and abs(k[3][1] - mid[1]) <= 0.05 for k in mine)
        if not hit:
            mine.append((n, h, crop, mid))
    return sorted(k[0] for ks in kept.values() for k in ks)


def test_short_questions_go_by_picture_and_place(spark):
    box = lambda x, y: (x, y, 0.2, 0.1)
    rows = [
        ("s", 1, "area?", 0b0, box(0.1, 0.1)),
        ("s", 2, "Area", 0b111, box(0.5, 0.5)),  # the same text
        ("s", 3, "sum", 0b11, box(0.12, 0.09)),  # another text, the picture of 1 in its place
        ("s", 4, "sum!", 0b11, box(0.8, 0.8)),  # the text of 3, which went
        ("s", 5, "side", 0b11, box(0.3, 0.1)),  # the picture of 1 elsewhere
        ("s", 6, "side a", 0b1111111111, box(0.1, 0.1)),  # another picture in the place of 1
        ("s", 7, "line", None, box(0.1, 0.1)), ("s", 8, "dot", 0, None), ("s", 9, " ", 0, box(0.1, 0.1)), ("s", 10, None, 0, box(0.1, 0.1)),
        ("t", 11, "sum", 0b11, box(0.1, 0.1)),
        ("t", 12, "how many apples are there in the basket on the table", 5, box(0.1, 0.1)),  # long: by text only
    ]
    keep = lambda rows: sorted(r["n"] for r in study.illustrated_question_set(spark.createDataFrame(rows, QUESTIONS), ["s"], ["n"]).collect())
    assert keep(rows) == questions_brute(rows) == [1, 5, 6, 7, 8, 11, 12]
    rng = random.Random(8)
    base = [("".join(rng.choice("abcd ") for _ in range(rng.choice((3, 6, 9, 30, 60)))), rng.getrandbits(60)) for _ in range(25)]
    more = []
    for n in range(260):
        stem, crop = rng.choice(base)
        stem = stem + rng.choice(("", "", "x", "yz")) if len(stem) > 12 else rng.choice(base)[0][:9]
        more.append((rng.choice("st"), n, stem, crop ^ sum(1 << rng.randrange(60) for _ in range(rng.randrange(5))), box(round(rng.random() * 0.3, 3), round(rng.random() * 0.3, 3))))
    assert keep(more) == questions_brute(more) and len(keep(more)) < 200
    assert study.illustrated_question_set(spark.createDataFrame([], QUESTIONS), ["s"], ["n"]).count() == 0


def test_progress_does_not_depend_on_the_order_of_rows(spark):
    schema = "k string, done boolean, ms double"
    # Ten times 0.1 are less than 1 in doubles, and 1.5 is a half.
    rows = [("a", True, 0.1)] * 10 + [("a", False, 9.0)] * 15 + [("b", True, x) for x in (0.1, 0.2, 0.3, 0.6, 0.7, 1e9, 0.4, 0.2)] + [("b", False, None)] * 4 + [("c", False, 1.0), ("d", True, float("nan")), ("e", True, -2.5), ("e", False, 0.0), ("f", True, None), ("f", True, 3.0), ("f", False, 1.0)]
    want = {"a": (10, 25, 0.1, 2), "b": (8, 12, 125000000.3125, 500000001), "c": (0, 1, None, None), "e": (1, 2, -2.5, -3), "f": (2, 3, 3.0, 3)}
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = {r["k"]: tuple(r)[1:] for r in agg.progress(spark.createDataFrame(rows, schema).repartition(seed + 1), F.col("done"), F.col("ms"), "k").collect()}
        assert {k: v for k, v in got.items() if k != "d"} == want


def test_progress_adds_in_an_order_as_its_sql_does(spark):
    """Sums of doubles in the order of events, however rows come: those of DuckDB over the table as it lies."""
    import duckdb

    rows = [("a", i, True, 0.1) for i in range(10)] + [("a", 10 + i, False, 9.0) for i in range(15)] + [("b", 30, False, 1.0), ("c", 31, True, None), ("c", 32, True, -2.5), ("c", 33, False, 0.0)]
    random.Random(2).shuffle(rows)
    got = agg.progress(spark.createDataFrame(rows, "k string, id long, done boolean, ms double").repartition(3), F.col("done"), F.col("ms"), "k", order="id")
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == {"a": (10, 25, sum_in_order([0.1] * 10) / 10, 1), "b": (0, 1, None, None), "c": (2, 3, -2.5, -3)}
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    want = con.execute(entry.oracle_sql()["a5_progress"]).fetchall()
    assert sorted(tuple(r) for r in entry.queries()["a5_progress"](spark, sf).collect()) == sorted(want)


def sum_in_order(xs):
    out = 0.0
    for x in xs:
        out += x
    return out


def test_accounts_of_the_joins_grow_with_the_table(spark):
    """An account is a seventh of the facts, not a block of 400; the rows are those of brute force."""
    sf = "/root/testdata/sf0.001"
    vec = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    cos = lambda a, b: float(vec[a] @ vec[b] / (np.linalg.norm(vec[a]) * np.linalg.norm(vec[b])))
    mates = {a: [b for b in vec if b % 7 == a % 7 and b != a] for a in vec}
    live = lambda a: a % 11 != 3
    q = entry.queries()
    near = {r["cid"]: (r["account_id"], r["id"]) for r in q["j3_nearest"](spark, sf).collect()}
    best = {a: max((b for b in mates[a] if live(b)), key=lambda b, a=a: cos(a, b)) for a in vec if not live(a)}
    assert near == {a: (str(a % 7), b if cos(a, b) >= 0.3 else None) for a, b in best.items()}
    assert {r["id"] for r in q["j7_exists_similar"](spark, sf).collect()} == {a for a in vec if any(cos(a, b) >= 0.3 for b in mates[a])}
    full = {k for k in range(7) if sum(live(a) for a in vec if a % 7 == k) >= 66}
    verdict = lambda a: "missing" if a not in vec else "ok" if live(a) else "capacity" if a % 7 in full else "duplicate" if any(live(b) and cos(a, b) >= 0.3 for b in mates[a]) else "ok"
    assert {r["id"]: r["verdict"] for r in q["q12_restorable"](spark, sf).collect()} == {2 * a: verdict(2 * a) for a in vec}


def test_simhash_of_many_texts_at_once(spark, monkeypatch):
    """Counters that are full, pieces of a batch, and more grams than the table holds; no lambdas left in the plan."""
    rng = random.Random(3)
    texts = ["ab" * 70_000 + "c", None, "", "é" * 65_540] + ["".join(rng.choice("abcdef é中\U0001f600") for _ in range(rng.randrange(40))) for _ in range(300)]
    want = [simhash_brute(t or "") for t in texts]
    lengths = np.array([len(t or "") for t in texts])
    some = np.flatnonzero(lengths >= 3)
    for table in (1 << 22, 10):
        monkeypatch.setattr(hashes, "TABLE", table)
        assert hashes.simhashes([texts[i] for i in some], lengths[some], 3).tolist() == [want[i] for i in some]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", hashes.simhash(F.col("t")).alias("h"))
    assert [r["h"] for r in sorted(out.collect())] == want
    assert "lambda" not in out._jdf.queryExecution().toString()


def test_near_hashes_of_a_crowd_meet_in_pieces(spark, monkeypatch):
    """Many hashes with the same low half: pairs that meet are far fewer than those of a slice of 16 bits, and none is lost or told twice."""
    monkeypatch.setattr(matching, "CROWD", 5)
    rng = random.Random(9)
    hashes_ = [(rng.getrandbits(28) << 32 if n % 2 else rng.choice((0, -1 << 63, 7 << 40))) ^ sum(1 << rng.randrange(63) for _ in range(n % 4)) for n in range(400)]
    got = [tuple(r) for r in matching.near_hashes(spark.createDataFrame(list(enumerate(hashes_)), "id long, h long"), "id", "h", 3).collect()]
    first = {h: n for n, h in reversed(list(enumerate(hashes_)))}
    apart = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    want = [(*sorted((first[x], first[y])), apart(x, y)) for x in first for y in first if x < y and apart(x, y) <= 3] + [(first[h], n, 0) for n, h in enumerate(hashes_) if first[h] != n]
    assert sorted(got) == sorted(want) and len(want) > 300
    # Every two within the bound are equal under a mask, which covers three slices of six.
    assert len(matching.masks(3, 3)) == 20 and all(m.bit_count() >= 30 or ((m + (1 << 64)) % (1 << 64)).bit_count() >= 30 for m in matching.masks(3, 3))


def test_distinct_stems_run_nothing_before_they_are_asked_for(spark):
    rows = spark.range(50, numPartitions=4).select(F.lit("s").alias("s"), "id", F.concat(F.lit("stem "), (F.col("id") % 9).cast("string")).alias("stem"))
    spark.sparkContext.setJobGroup("stems", "stems")
    try:
        out = study.distinct_stems(rows, ["s"], ["id"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("stems")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["id"] for r in out.collect()) == list(range(9))
