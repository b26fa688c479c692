"""Streams over two triggers and more: what state keeps, what timers remove, and what a replay repeats."""

import random
import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.operators import aggregates, state
from lodestone.plans import intent, study
from lodestone.streaming import feeds, stateful


class Stream:
    """A stream over a folder: each ``run`` adds a file and starts the query anew from its checkpoint."""

    def __init__(self, spark, make, schema, path):
        self.spark, self.make, self.schema, self.path, self.n = spark, make, schema, str(path), 0

    def run(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n}")
        out = []
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in/*")
        q = self.make(stream).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{self.path}/c").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        return out


DELTAS = "id string, text string, seen boolean, created_at timestamp"


def test_changes_are_delivered_once_and_marked_once(spark, tmp_path):
    day = lambda n: datetime(2024, 1, n)
    put = lambda n, rows: spark.createDataFrame(rows, DELTAS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    got = []

    def run(seen=f"{tmp_path}/seen"):
        got.clear()
        feeds.delta_feed(spark, f"{tmp_path}/in/*", DELTAS, lambda df, n: got.extend((n, r["id"]) for r in df.collect()), f"{tmp_path}/c", seen=seen, since=day(2), once=True).awaitTermination(120)
        return list(got)

    put(1, [("a", "x", False, day(3)), ("b", "x", True, day(3)), ("c", "x", False, day(2)), ("d", "x", None, day(5)), ("e", "x", False, day(4))])
    assert run() == [(0, "d"), (0, "e"), (0, "a")]  # unseen, strictly after the cursor, newest first
    put(2, [("e", "again", False, day(6)), ("f", "x", False, day(4)), ("g", "x", False, day(1))])
    assert run() == [(1, "f")]  # e was marked by the first batch
    marks = lambda: sorted((r["id"], r["batch"]) for r in feeds.seen_marks(spark, f"{tmp_path}/seen").collect())
    want = [("a", 0), ("d", 0), ("e", 0), ("f", 1)]
    assert marks() == want and len({r["query"] for r in feeds.seen_marks(spark, f"{tmp_path}/seen").collect()}) == 1

    # The second batch is replayed: its end is forgotten, its marks are not.
    for name in ("1", ".1.crc"):
        (tmp_path / "c" / "commits" / name).unlink(missing_ok=True)
    assert run() == [] and marks() == want
    # Replayed before it was marked: delivered again, marked once.
    for name in ("1", ".1.crc"):
        (tmp_path / "c" / "commits" / name).unlink(missing_ok=True)
    folder = next((tmp_path / "seen").glob("query=*/batch=1"))
    shutil.move(folder, tmp_path / "aside")
    assert run() == [(1, "f")] and marks() == want
    # Another query over the same folder of marks has its own, and repeats nothing.
    sink = feeds.deliver_once(lambda df, n: got.append([r["id"] for r in df.collect()]), f"{tmp_path}/seen")
    got.clear()
    batch = spark.createDataFrame([("a", "x", False, day(3)), ("z", "x", False, day(3)), ("z", "y", False, day(9))], DELTAS)
    sink(batch, 0)
    sink(batch, 0)
    assert got == [["z", "z"]] and marks() == sorted([*want, ("z", 0)])
    seen = state.mark_seen(spark.createDataFrame([("a", False), ("q", False)], "id string, seen boolean"), feeds.seen_marks(spark, f"{tmp_path}/seen").select("id"))
    assert {r["id"]: r["seen"] for r in seen.collect()} == {"a": True, "q": False}


def test_changes_without_marks_are_delivered_at_least_once(spark, tmp_path):
    spark.createDataFrame([("1", "x", False, datetime(2024, 1, 1)), ("2", "x", True, datetime(2024, 1, 2))], DELTAS).write.parquet(f"{tmp_path}/d")
    got = []
    q = feeds.delta_feed(spark, f"{tmp_path}/d", DELTAS, lambda df, n: got.extend(r["id"] for r in df.collect()), f"{tmp_path}/c", once=True)
    q.awaitTermination(60)
    assert got == ["1"]


QUESTIONS = "session string, n long, stem string"


def test_first_question_stays_over_triggers(spark, tmp_path):
    rng = random.Random(3)
    say = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(14))
    base = [say() for _ in range(12)]

    def near(t):
        at = rng.randrange(len(t))
        return t[:at] + rng.choice("xyz") + t[at + 1 :] if rng.random() < 0.6 else t.upper() + "!"

    rows = [(rng.choice("st"), n, rng.choice([near(rng.choice(base)), rng.choice(base), say(), "ab", " ", None])) for n in range(180)]
    stream = Stream(spark, lambda df: stateful.first_questions(df, ["session"], ["n"]), QUESTIONS, tmp_path)
    got = [r for part in (rows[:70], rows[70:71], rows[71:]) for r in stream.run(part)]
    want = study.question_set(spark.createDataFrame(rows, QUESTIONS), ["session"], ["n"]).collect()
    assert sorted(r["n"] for r in got) == sorted(r["n"] for r in want) and 60 < len(got) < 140
    # What comes later is later, whatever its order says; repeats of all triggers give nothing.
    assert stream.run([(s, -1 - n, t) for s, n, t in rows]) == []
    assert [r["n"] for r in stream.run([("u", 5, base[0]), ("u", 4, base[0])])] == [4]


COMMANDS = "id string, seq long, at timestamp, command string, account string, category string, reversible boolean, applied map<string,string>, current map<string,string>"
START = datetime(2024, 1, 1)


def command(id_, seq, at, name, account="a", category=None, reversible=None, applied=None, current=None):
    return (id_, seq, START + timedelta(seconds=at), name, account, category, reversible, applied, current)


def histories(rng):
    rows = []
    for p in range(90):
        at = 0
        applied = rng.choice([{"coach_preference_text": "short"}, {"memory": "true", "visual": "false"}, {"memory": None}, {}])
        for k in range(rng.randrange(1, 12)):
            at += rng.choice([0, 1, 30, 59, 60, 61, 599, 600, 601, 5000, 86_400, 86_401] if k > 2 else [0, 1, 600, 601])
            name = ("propose", "confirm")[k] if k < 2 and p % 5 else rng.choice(["propose", "confirm", "undo", "undo", "undo", "confirm", "dance"])
            current = rng.choice([None, {}, applied, {**applied, "more": "x"}, {k: "no" for k in applied}, dict(list(applied.items())[:1])])
            rows.append(command(f"p{p}", len(rows), at, name, rng.choice("aaaaab"), rng.choice(["preference", "context_toggle", "context_toggle", "colour"]), rng.choice([True, True, False, None]), applied, current))
    return rows


def test_streamed_proposals_are_the_folded_history(spark, tmp_path):
    rows = histories(random.Random(1))
    want = {r["seq"]: r["answer"] for r in intent.proposal_history(spark.createDataFrame(rows, COMMANDS)).collect()}
    stream = Stream(spark, lambda df: stateful.proposal_states(df, "30 days"), COMMANDS, tmp_path)
    # Each trigger has the next third of every proposal's commands.
    parts = [[r for i, r in enumerate(rows) if i * 3 // len(rows) == k] for k in range(3)]
    got = {r["seq"]: r["answer"] for part in parts for r in stream.run(part)}
    assert got == want and len(want) == len(rows)
    assert set(want.values()) == {"pending", "confirmed", "undone", "not found", "not pending", "not confirmed", "forbidden", "unknown", "not undoable", "unverifiable", "drifted", "unsupported"}


def test_proposal_history_by_hand(spark):
    now = {"memory": "true", "visual": "false"}
    rows = [
        command("p", 1, 0, "propose", category="context_toggle", reversible=True, applied=now), command("p", 2, 600, "confirm"), command("p", 3, 601, "undo", current={"memory": "true"}),
        command("p", 4, 602, "undo", current={"memory": "false", "visual": "false"}), command("p", 5, 603, "undo", "b", current=now), command("p", 6, 87_000, "undo", current=now), command("p", 7, 87_059, "undo", current=now), command("p", 8, 87_061, "undo", current=now),
        command("q", 9, 0, "propose", category="preference", reversible=False, applied={"coach_preference_text": "x"}), command("q", 10, 1, "confirm"), command("q", 11, 2, "undo", current={"coach_preference_text": "x"}),
        command("r", 12, 0, "propose", category="preference", reversible=True), command("r", 13, 601, "confirm"), (None, 14, START, "undo", "a", None, None, None, None), ("r", 15, None, "undo", "a", None, None, None, None),
    ]
    got = intent.proposal_history(spark.createDataFrame(rows, COMMANDS)).orderBy("seq").collect()
    assert [r["answer"] for r in got] == ["pending", "confirmed", "unverifiable", "drifted", "forbidden", "undone", "not confirmed", "not found", "pending", "confirmed", "not undoable", "pending", "not found"]
    assert intent.proposal_history(spark.createDataFrame([], COMMANDS)).count() == 0


def test_timers_remove_what_has_run_out(spark, tmp_path):
    stream = Stream(spark, stateful.proposal_states, COMMANDS, tmp_path)

    def held():
        df = spark.read.format("statestore").option("stateVarName", "proposal").load(f"{tmp_path}/c")
        return sorted((r["k"], r["phase"]) for r in df.select(F.col("key.id").alias("k"), F.col("value.phase").alias("phase")).collect())

    stream.run([command("p", 1, 0, "propose", category="preference", reversible=True, applied={"k": "v"}), command("q", 2, 0, "propose", category="preference", reversible=True, applied={"k": "v"})])
    assert held() == [("p", "pending"), ("q", "pending")]
    stream.run([command("q", 3, 10, "confirm"), command("r", 4, 500, "propose")])
    assert held() == [("p", "pending"), ("q", "confirmed"), ("r", "pending")]
    stream.run([command("s", 5, 700, "propose")])  # the watermark passes 600 s
    assert held() == [("q", "confirmed"), ("r", "pending"), ("s", "pending")]
    stream.run([command("t", 6, 80_000, "propose")])
    assert held() == [("q", "confirmed"), ("t", "pending")]
    stream.run([command("q", 7, 86_000, "undo", current={"k": "v"})])
    assert held() == [("q", "undone")]
    stream.run([command("u", 8, 90_000, "propose")])
    assert held() == [("u", "pending")]


FRAMES = "session_id string, image_id string, sequence_index long, visual_hash long, tokens array<string>"


def test_novelty_is_that_of_the_table_over_triggers(spark, tmp_path):
    """More frames than one Arrow batch holds, with hashes that floats cannot hold."""
    rng, base = random.Random(9), [(1 << 60) + 1, (1 << 59) + (1 << 30) - 1, 5]
    words = [["a", "b", "c"], ["a", "b", "d"], ["x", None, "y", "x"], [], None]
    rows = [(rng.choice("st"), f"{i:04}", i, rng.choice([None, *[b ^ (1 << rng.randrange(50)) ^ (1 << rng.randrange(50)) for b in base]]), rng.choice(words)) for i in range(240)]
    want = {r["image_id"]: tuple(r) for r in aggregates.novel_frames(spark.createDataFrame(rows, FRAMES)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        stream = Stream(spark, feeds.novelty, FRAMES, tmp_path)
        got = [r for part in (rows[:100][::-1], rows[100:]) for r in stream.run(part)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["image_id"]: (r["session_id"], r["image_id"], r["sequence_index"], r["novelty_status"], r["visual_distance"], r["text_distance"]) for r in got} == want
    assert {w[3] for w in want.values()} == {"novel", "duplicate", "invalid"}


def test_novelty_by_hand(spark):
    rows = [("s", "a", 1, 0, ["x", "y"]), ("s", "b", 2, 1, ["y", "x"]), ("s", "c", 3, None, ["x"]), ("s", "d", 4, 3, ["x", "z"]), ("s", "e", 5, 7, ["x", "z"]), ("s", "f", 6, (1 << 20) - 1, ["x", "z"]), ("t", "g", 1, 0, None), ("t", "h", 2, 0, [])]
    got = {r["image_id"]: (r["novelty_status"], r["visual_distance"], r["text_distance"]) for r in aggregates.novel_frames(spark.createDataFrame(rows, FRAMES)).collect()}
    # e is held against d, the last novel one, and not against the frame before it.
    assert got == {"a": ("novel", None, None), "b": ("duplicate", 1, 0.0), "c": ("invalid", None, None), "d": ("novel", 2, 1 - 1 / 3), "e": ("duplicate", 1, 0.0), "f": ("novel", 18, 0.0), "g": ("novel", None, None), "h": ("duplicate", 0, 0.0)}
