"""State that outlives a trigger: first of near questions, and proposals with timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions import hashes
from lodestone.functions.text import strip
from lodestone.plans.intent import CONFIRMED_S, PENDING_S, UNDONE_S

#: The state store that maps, lists and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(df: DataFrame) -> DataFrame:
    """``df``, once its session keeps streaming state in the store that these operators need."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return df


class FirstOfNear(StatefulProcessor):
    """Keeps what no earlier row of the group is like; its state is a map of fingerprints, and one of bands to kept hashes."""

    def __init__(self, fields: list[str], order: list[str], most: int, width: int) -> None:
        self.fields, self.order, self.most, self.width = fields, order, most, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prints = handle.getMapState("prints", "fingerprint string", "there boolean")
        self.bands = handle.getMapState("bands", "k int, band long", "kept array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            if self.prints.containsKey(mark := (r["fingerprint"],)):
                continue
            self.prints.updateValue(mark, (True,))
            held = self.near(r["simhash"])
            if held is not None:
                for slot, kept in held.items():
                    self.bands.updateValue(slot, ([*kept, r["simhash"]],))
                yield Row(**{c: r[c] for c in self.fields})

    def near(self, h: int | None) -> dict | None:
        """The bands of a hash with what they hold; null if that is near it. Without a hash there are none."""
        held = {}
        for k in range(self.most + 1 if h is not None else 0):
            slot = (k, h >> k * self.width & ((1 << self.width) - 1))
            held[slot] = list(self.bands.getValue(slot)[0]) if self.bands.containsKey(slot) else []
            if any((h ^ x).bit_count() <= self.most for x in held[slot]):
                return None
        return held

    def close(self) -> None:
        pass


def first_questions(questions: DataFrame, keys: list[str], order: list[str], stem: str = "stem", most: int = 3) -> DataFrame:
    """Questions of a stream that no earlier one of their group repeats, by fingerprint or near SimHash: the first to arrive stays.

    What ``plans.study.question_set`` gives for a table, kept over triggers. Rows of one trigger go by ``order``; a later trigger
    follows those before, whatever its order says. A stem that is near a kept one goes, and one near only to such as went
    stays; one with a fingerprint met before goes, also if what had it went. Blank stems go. State grows with what is kept: a
    fingerprint for each different stem, and for each kept one its hash under ``most + 1`` bands, of which a row reads only its own.
    """
    if not 0 <= most <= 31:
        raise ValueError("most must be from 0 to 31 bits")
    plain = hashes.normalized(F.col(stem))
    sound = questions.where(strip(F.coalesce(F.col(stem), F.lit(""))) != "").withColumn("fingerprint", hashes.fingerprint(F.col(stem))).withColumn("simhash", hashes.simhash(plain))
    step = FirstOfNear(sound.columns, order, most, -(-64 // (most + 1)))
    return with_state(sound).groupBy(*keys).transformWithState(step, sound.schema, "append", "none")


class Proposals(StatefulProcessor):
    """The life of a proposal: ``plans.intent.proposal_history`` with timers that remove what has run out."""

    LASTS = {"pending": PENDING_S, "confirmed": CONFIRMED_S, "undone": UNDONE_S}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("proposal", "phase string, since long, account string, category string, reversible boolean, applied string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.state.get() if self.state.exists() else None
        for c in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            at = int(c["at_us"])
            if state and at - state[1] > self.LASTS[state[0]] * 1_000_000:
                state = None
            answer = self.answer(state, c)
            if c["command"] == "propose":
                state = ("pending", at, c["account"], c["category"], bool(c["reversible"]), c["applied"])
            elif answer in ("confirmed", "undone"):
                state = (answer, at, *state[2:])
            yield Row(id=c["id"], seq=c["seq"], command=c["command"], at=c["at"], answer=answer)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            # The first millisecond at which it no longer lasts.
            self.handle.registerTimer((state[1] + self.LASTS[state[0]] * 1_000_000) // 1000 + 1)

    @staticmethod
    def answer(state, c: Row) -> str:
        if c["command"] == "propose":
            return "pending"
        if c["command"] not in ("confirm", "undo"):
            return "unknown"
        if state is None:
            return "not found"
        phase, _, account, category, reversible, applied = state
        if account != c["account"]:
            return "forbidden"
        if c["command"] == "confirm":
            return "confirmed" if phase == "pending" else "not pending"
        if phase != "confirmed":
            return "not confirmed"
        if not reversible:
            return "not undoable"
        current = c["current"]
        if current in (None, "{}"):
            return "unverifiable"
        if category not in ("preference", "context_toggle"):
            return "unsupported"
        current = json.loads(current)
        for k, v in json.loads(applied or "{}").items():
            if k not in current:
                return "unverifiable"
            if current[k] != v:
                return "drifted"
        return "undone"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def proposal_states(commands: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Answers to a stream of proposal commands: ``id, seq, command, at, answer``, by the rules of ``plans.intent.proposal_history``.

    Commands of a trigger go by ``at`` and ``seq``. A proposal is one value of state with one timer in event time, which removes
    it once the watermark has passed its end: 600 s after it was made, a day after it was confirmed, 60 s after it was
    undone. Commands more than ``late`` behind the newest of the triggers before are dropped. Commands without an id, a time or a
    command go.
    """
    sound = commands.where("id is not null and at is not null and command is not null").withWatermark("at", late)
    # Maps travel to the state as JSON.
    flat = [F.to_json(F.transform_values(c, lambda k, v: F.coalesce(v, F.lit("")))).alias(c) for c in ("applied", "current")]
    sound = sound.select("id", "seq", "at", F.unix_micros("at").alias("at_us"), "command", "account", "category", "reversible", *flat)
    kind = dict(commands.dtypes)
    return with_state(sound).groupBy("id").transformWithState(Proposals(), f"id {kind['id']}, seq {kind['seq']}, command string, at timestamp, answer string", "append", "EventTime")
