"""The attempt machine as keyed state of a stream: what to try next for an item, as reports come in.

An item enters with its first budget. Every report on an attempt moves it: an accepted one ends it, a faulty one is
tried once more with focused contexts, one that ran out of tokens gets the next budget of the ladder. Reports may
arrive in any order; those ahead of their turn wait in the state. ``history_steps`` gives the same rows from a
complete table of reports.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillsift.config import Attempts

#: ``attempt`` 0 puts an item into the queue; ``budget`` and ``focused`` may be null, otherwise they have to be as scheduled.
REPORT = "id long, attempt int, budget int, focused boolean, accepted boolean, faulty boolean, hit_token_limit boolean"
STEP = "id long, attempts int, status string, budget int, focused boolean, waiting int, ignored int"
MACHINE = "attempts int, status string, budget int, focused boolean, refocused boolean, ignored int"
EARLY = "attempt int, budget int, focused boolean, accepted boolean, faulty boolean, hit_token_limit boolean"
STATES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(ladder) -> tuple:
    """State of an item that was queued: the first budget is scheduled."""
    return (0, "open", int(ladder[0]), False, False, 0)


def step(state: tuple, report: tuple, ladder, policy: Attempts) -> tuple:
    """State after the report on the scheduled attempt."""
    attempts, status, budget, focused, refocused, ignored = state
    told, shown, accepted, faulty, hit = report
    if status != "open":
        return (attempts, status, budget, focused, refocused, ignored + 1)
    if (told is not None and told != budget) or (shown is not None and shown != focused):
        raise ValueError(f"attempt {attempts + 1} was scheduled with {budget}, {focused} and reported with {told}, {shown}")
    attempts, larger = attempts + 1, next((b for b in ladder if b > budget), None)
    if accepted:
        return (attempts, "accepted", budget, focused, refocused, ignored)
    if attempts < policy.max_attempts:
        if faulty and not refocused:
            return (attempts, "open", budget, True, True, ignored)
        if not faulty and hit and larger is not None:
            return (attempts, "open", int(larger), focused, refocused, ignored)
    return (attempts, "unresolved", budget, focused, refocused, ignored)


def advance(now: tuple | None, held: dict[int, tuple], ladder, policy: Attempts) -> tuple | None:
    """State after the reports whose turn has come; these leave ``held``, reports by attempt."""
    turn = 1 if now is None else now[0] + 1 + now[5]
    while now is not None and turn in held:
        now = step(now, held.pop(turn), ladder, policy)
        turn += 1
    return now


class AttemptMachine(StatefulProcessor):
    """State per item: where it stands, and reports that wait for earlier ones.

    Either is read and written once per item and batch, since every call crosses to the JVM.
    """

    def __init__(self, ladder, policy: Attempts):
        self.ladder, self.policy = tuple(ladder), policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", MACHINE)
        self.early = handle.getListState("early", EARLY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get()
        now = None if before is None else tuple(before)
        held = {int(r[0]): tuple(r[1:]) for r in self.early.get()}
        waited = bool(held)
        plain = lambda v, kind: None if pd.isna(v) else kind(v)
        fields = ("attempt", "budget", "focused", "accepted", "faulty", "hit_token_limit")
        for frame in rows:
            for attempt, budget, focused, *told in zip(*(frame[c].tolist() for c in fields)):
                if attempt == 0:
                    now = start(self.ladder) if now is None else now
                else:
                    held[int(attempt)] = (plain(budget, int), plain(focused, bool), *map(bool, told))
        now = advance(now, held, self.ladder, self.policy)
        if held:
            self.early.put([(n, *held[n]) for n in sorted(held)])
        elif waited:
            self.early.clear()
        if now is not None:
            self.state.update(now)
            attempts, status, budget, focused, _, ignored = now
            yield pd.DataFrame({"id": [key[0]], "attempts": [attempts], "status": [status], "budget": [budget], "focused": [focused],
                                "waiting": [len(held)], "ignored": [ignored]})

    def close(self) -> None:
        pass


def schedule(reports: DataFrame, ladder, policy: Attempts = Attempts()) -> DataFrame:
    """A stream of reports to a stream of steps (update mode): where each item stands after the reports of a batch.

    Needs the state store provider ``STATES``.
    """
    return reports.groupBy("id").transformWithStateInPandas(
        AttemptMachine(ladder, policy), STEP, outputMode="Update", timeMode="None")


def history_steps(queue: DataFrame, reports: DataFrame, ladder, policy: Attempts = Attempts()) -> DataFrame:
    """The last step of every queued item from a table of reports ``(id, attempt, accepted, faulty, hit_token_limit)``.

    An item has at most ``max_attempts`` reports that matter; later ones are counted only. Reports of an item are
    numbered from 1 without gaps, otherwise those behind the gap wait.
    """
    told = reports.where("attempt > 0").groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("attempt") <= policy.max_attempts, F.struct("attempt", "accepted", "faulty", "hit_token_limit")))).alias("first"),
        F.count("*").alias("n"), F.max("attempt").alias("last"))
    rows = queue.select("id").distinct().join(told, "id", "left")
    none = F.array().cast("array<struct<attempt:int,accepted:boolean,faulty:boolean,hit_token_limit:boolean>>")
    seen = F.filter(F.coalesce("first", none), lambda r: r["attempt"].isNotNull())
    whole = F.filter(seen, lambda r, i: r["attempt"] == i + 1)
    state = lambda n, status, budget, focused, refocused: F.struct(
        n.cast("int").alias("attempts"), status.alias("status"), budget.cast("int").alias("budget"), focused.alias("focused"), refocused.alias("refocused"))

    def moved(s: Column, r: Column) -> Column:
        n = s["attempts"] + 1
        larger = reduce(lambda rest, b: F.when(s["budget"] < b, F.lit(b)).otherwise(rest), sorted(ladder, reverse=True), F.lit(None).cast("int"))
        refocus = r["faulty"] & ~s["refocused"]
        extend = ~r["faulty"] & r["hit_token_limit"] & larger.isNotNull()
        goes_on = n < policy.max_attempts
        end = lambda word: state(n, F.lit(word), s["budget"], s["focused"], s["refocused"])
        return (F.when(s["status"] != "open", s).when(r["accepted"], end("accepted"))
                .when(goes_on & refocus, state(n, F.lit("open"), s["budget"], F.lit(True), F.lit(True)))
                .when(goes_on & extend, state(n, F.lit("open"), larger, s["focused"], s["refocused"])).otherwise(end("unresolved")))

    first = state(F.lit(0), F.lit("open"), F.lit(ladder[0]), F.lit(False), F.lit(False))
    out = rows.select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("last", F.lit(0)).alias("last"), F.aggregate(whole, first, moved).alias("s"))
    dense = F.col("n") == F.col("last")
    ignored = F.when(dense & (F.col("s.status") != "open"), F.col("n") - F.col("s.attempts")).otherwise(0)
    return out.select("id", "s.attempts", "s.status", "s.budget", "s.focused",
                      F.when(dense, 0).otherwise(F.col("n") - F.col("s.attempts")).cast("int").alias("waiting"), ignored.cast("int").alias("ignored"))
