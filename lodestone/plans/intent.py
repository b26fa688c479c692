"""Settings requests: what a classified request would change, as rows to confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.labels import coded
from lodestone.functions.text import missing, strip

# Fixed values.
CONTEXT_KEYS = {"visual": "画面", "observation": "观察", "history": "历史", "mistakes": "错题", "knowledge": "知识点", "memory": "长期记忆", "strategy": "策略", "debug": "调试"}
INTENTS = ("update_coach_preference", "toggle_context", "qa", "grade_homework", "photo_answer")
CONFIDENCE_FLOOR = 0.6


def settled_intent(intent: Column, confidence: Column) -> Column:
    """An unknown intent, or one below the floor, is a question."""
    sure = intent.isin(*INTENTS) & (F.coalesce(confidence, F.lit(0.0)) >= CONFIDENCE_FLOOR)
    return F.when(F.coalesce(sure, F.lit(False)), intent).otherwise(F.lit("qa"))


def preference_change(text: Column, mode: Column, before: Column) -> Column:
    """``label, before, after`` of a preference that is replaced or appended to; null without a text."""
    new, old = strip(F.coalesce(text, F.lit(""))), strip(F.coalesce(before, F.lit("")))
    after = F.when((mode == "append") & (old != ""), F.concat(old, F.lit("\n"), new)).otherwise(new)
    return F.when(new != "", F.struct(F.lit("辅导偏好").alias("label"), F.coalesce(missing(old), F.lit("（默认）")).alias("before"), after.alias("after")))


def toggle_change(key: Column, value: Column, included: Column) -> Column:
    """``label, before, after`` of a switch; null unless the key is known and the value a boolean. ``included``: key to boolean."""
    k = strip(F.coalesce(key, F.lit("")))
    word = lambda x: F.when(x, F.lit("开")).otherwise(F.lit("关"))
    now = F.try_element_at(included, k)
    before = F.when(now.isNull(), F.lit("未知")).otherwise(word(now))
    return F.when(k.isin(*CONTEXT_KEYS) & value.isNotNull(), F.struct(coded(k, CONTEXT_KEYS, "").alias("label"), before.alias("before"), word(value).alias("after")))


def proposals(requests: DataFrame) -> DataFrame:
    """``id, category, change, reversible`` of requests ``id, intent, confidence, text, mode, key, value, preference, included``.

    Requests that change nothing give no row. A switch whose state is unknown cannot be undone.
    """
    intent = settled_intent(F.col("intent"), F.col("confidence"))
    pref = preference_change(F.col("text"), F.col("mode"), F.col("preference"))
    toggle = toggle_change(F.col("key"), F.col("value"), F.col("included"))
    change = F.when(intent == "update_coach_preference", pref).when(intent == "toggle_context", toggle)
    category = F.when(intent == "update_coach_preference", "preference").otherwise("context_toggle")
    out = requests.select("id", category.alias("category"), change.alias("change")).where("change is not null")
    return out.withColumn("reversible", (F.col("category") == "preference") | (F.col("change.before") != "未知"))


# Seconds that a proposal can be confirmed in, that it can then be undone in, and that an undone one is remembered.
PENDING_S, CONFIRMED_S, UNDONE_S = 600, 86_400, 60
#: What ``applied`` and ``current`` call the text of a preference.
PREFERENCE_KEY = "coach_preference_text"


def proposal_history(commands: DataFrame) -> DataFrame:
    """``id, seq, command, at, answer`` of commands on proposals, each answered by what the commands before it left.

    ``commands``: ``id, seq, at (timestamp), command (propose, confirm, undo), account, category, reversible, applied, current``.
    ``applied`` (of a propose) and ``current`` (of an undo) map keys to values as texts; a null value is the empty text.

    propose: ``pending``, in place of what the id stood for. Else ``not found`` if there is nothing: a pending proposal goes 600 s after it was
    made, a confirmed one after a day, an undone one after 60 s. Else ``forbidden`` to another account. confirm: ``confirmed``, or
    ``not pending``. undo, in this order: ``not confirmed``; ``not undoable`` if it is not reversible; ``unverifiable`` without a
    current state; by the first applied key that is missing or differs, ``unverifiable`` or ``drifted``; ``unsupported`` for
    another category; else ``undone``. Unknown commands answer ``unknown`` and change nothing.

    Commands go by ``at`` and then ``seq``, folded in one column expression: a shuffle by id, and no Python. Commands without an
    id, a time or a command have no place in an order and go.
    """
    sound = commands.where("id is not null and at is not null and command is not null")
    place = lambda c: F.struct(c["at"], c["seq"])
    before = lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)
    told = F.array_sort(F.collect_list(F.struct("at", "seq", "command", "account", "category", "reversible", "applied", "current")), before)
    # The folded state is a struct; the answers so far are its last field.
    none = F.struct(
        F.lit("none").alias("phase"), F.lit(None).cast("timestamp").alias("since"), F.lit(None).cast("string").alias("account"), F.lit(None).cast("string").alias("category"),
        F.lit(False).alias("reversible"), F.lit(None).cast("map<string,string>").alias("applied"), F.array().cast("array<string>").alias("answers"),
    )
    lasts = F.lit(float(PENDING_S)), F.lit(float(CONFIRMED_S)), F.lit(float(UNDONE_S))

    def step(state: Column, c: Column) -> Column:
        age = F.unix_micros(c["at"]) / 1e6 - F.unix_micros(state["since"]) / 1e6
        keep = F.when(state["phase"] == "pending", lasts[0]).when(state["phase"] == "confirmed", lasts[1]).when(state["phase"] == "undone", lasts[2]).otherwise(F.lit(-1.0))
        phase = F.when(age <= keep, state["phase"]).otherwise(F.lit("none"))
        text = lambda x: F.coalesce(x, F.lit(""))
        keys = F.map_keys(state["applied"])
        odd = F.filter(keys, lambda k: ~F.map_contains_key(c["current"], k) | (text(F.try_element_at(c["current"], k)) != text(F.try_element_at(state["applied"], k))))
        drift = F.when(F.coalesce(F.size(odd), F.lit(0)) > 0, F.when(F.map_contains_key(c["current"], odd[0]), F.lit("drifted")).otherwise(F.lit("unverifiable")))
        undo = (
            F.when(phase != "confirmed", "not confirmed").when(~F.coalesce(state["reversible"], F.lit(False)), "not undoable")
            .when(F.coalesce(F.size(c["current"]), F.lit(0)) <= 0, "unverifiable").when(~F.coalesce(state["category"].isin("preference", "context_toggle"), F.lit(False)), "unsupported")
            .otherwise(F.coalesce(drift, F.lit("undone")))
        )
        answer = (
            F.when(c["command"] == "propose", "pending").when(~c["command"].isin("confirm", "undo"), "unknown").when(phase == "none", "not found")
            .when(~state["account"].eqNullSafe(c["account"]), "forbidden").when(c["command"] == "confirm", F.when(phase == "pending", F.lit("confirmed")).otherwise(F.lit("not pending")))
            .otherwise(undo)
        )
        made, moved = c["command"] == "propose", answer.isin("confirmed", "undone")
        own = lambda f: F.when(made, c[f]).otherwise(state[f]).alias(f)
        return F.struct(
            F.when(made | moved, answer).otherwise(phase).alias("phase"), F.when(made | moved, c["at"]).otherwise(state["since"]).alias("since"),
            own("account"), own("category"), F.coalesce(F.when(made, c["reversible"]).otherwise(state["reversible"]), F.lit(False)).alias("reversible"), own("applied"),
            F.concat(state["answers"], F.array(answer)).alias("answers"),
        )

    folded = sound.groupBy("id").agg(told.alias("c")).select("id", "c", F.aggregate("c", none, step)["answers"].alias("answers"))
    each = folded.select("id", F.explode(F.arrays_zip("c", "answers")).alias("x"))
    return each.select("id", F.col("x.c.seq").alias("seq"), F.col("x.c.command").alias("command"), F.col("x.c.at").alias("at"), F.col("x.answers").alias("answer"))


def delta_line(adds: Column, updates: Column) -> Column:
    """How many facts were added and updated."""
    parts = F.concat_ws(" · ", F.when(adds > 0, F.concat(F.lit("新增 "), adds.cast("string"), F.lit(" 条"))), F.when(updates > 0, F.concat(F.lit("更新 "), updates.cast("string"), F.lit(" 条"))))
    return F.when(parts == "", F.lit("已更新你的学习档案")).otherwise(parts)
