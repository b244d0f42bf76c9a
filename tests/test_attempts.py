"""The attempt machine on a stream and from a table, against a plain loop over each history."""

import random

import pytest

from quillsift.config import Attempts
from quillsift.streaming import attempts

LADDER = [2048, 3072, 4096]


def plain(reports, policy=Attempts()):
    """(attempts, status, budget, focused, ignored) by the rules, one history at a time."""
    budget, focused, n = LADDER[0], False, 0
    for accepted, faulty, hit in reports:
        n += 1
        if accepted:
            return n, "accepted", budget, focused, len(reports) - n
        if n >= policy.max_attempts or (faulty and focused):
            break
        larger = [b for b in LADDER if b > budget]
        if faulty:
            focused = True
        elif hit and larger:
            budget = larger[0]
        else:
            break
    else:
        return n, "open", budget, focused, 0
    return n, "unresolved", budget, focused, len(reports) - n


def histories():
    draw = random.Random(6)
    return {i: [(draw.random() < 0.2, draw.random() < 0.4, draw.random() < 0.7) for _ in range(draw.randint(0, 6))] for i in range(60)}


def test_steps_from_a_table(spark):
    want = histories()
    queue = spark.createDataFrame([(i,) for i in want], "id long")
    reports = spark.createDataFrame([(i, k + 1, *r) for i, h in want.items() for k, r in enumerate(h)],
                                    "id long, attempt int, accepted boolean, faulty boolean, hit_token_limit boolean")
    got = {r.id: (r.attempts, r.status, r.budget, r.focused, r.ignored) for r in attempts.history_steps(queue, reports, LADDER).collect()}
    assert got == {i: plain(h) for i, h in want.items()}
    assert {s for _, s, *_ in got.values()} == {"open", "accepted", "unresolved"} and {b for _, _, b, *_ in got.values()} == set(LADDER)


def test_stream_equals_table_when_reports_come_out_of_order(spark, tmp_path):
    want, draw = histories(), random.Random(2)
    rows = [(i, k + 1, None, None, *r) for i, h in want.items() for k, r in enumerate(h)] + [(i, 0, None, None, None, None, None) for i in want]
    draw.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], attempts.REPORT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/queue")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, attempts.STATES)
    kept = {}
    try:
        source = spark.readStream.schema(attempts.REPORT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/queue")
        for _ in range(2):  # the second session finds nothing left to do
            (attempts.schedule(source, LADDER).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/progress")
             .foreachBatch(lambda batch, n: kept.update({r.id: (n, tuple(r)[1:]) for r in batch.collect()})).trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(provider, before)
    got = {i: (n, s, b, f, g) for i, (_, (n, s, b, f, waiting, g)) in kept.items() if waiting == 0}
    assert got == {i: plain(h) for i, h in want.items()} and max(n for n, _ in kept.values()) == 3


def test_a_report_has_to_be_as_scheduled():
    state = attempts.start(LADDER)
    state = attempts.step(state, (2048, False, False, False, True), LADDER, Attempts())
    assert state == (1, "open", 3072, False, False, 0)
    with pytest.raises(ValueError, match="scheduled with 3072"):
        attempts.step(state, (2048, False, True, False, False), LADDER, Attempts())
    with pytest.raises(ValueError):
        attempts.step(state, (None, True, True, False, False), LADDER, Attempts())
    ended = attempts.step(state, (3072, False, True, False, False), LADDER, Attempts())
    assert ended[1] == "accepted" and attempts.step(ended, (1, True, True, True, True), LADDER, Attempts())[5] == 1


def test_state_is_read_and_written_once_per_item_and_batch():
    """Calls to the state do not grow with the reports of a batch; reports ahead of their turn wait in it."""
    import pandas as pd

    class Cell:
        def __init__(self, value):
            self.value, self.calls = value, 0

        def get(self):
            self.calls += 1
            return iter(self.value) if isinstance(self.value, list) else self.value

        def put(self, value):
            self.value, self.calls = value, self.calls + 1

        update = put

        def clear(self):
            self.value, self.calls = [], self.calls + 1

    machine = attempts.AttemptMachine(LADDER, Attempts(max_attempts=1 << 30))
    machine.state, machine.early = Cell(None), Cell([])
    row = lambda n: (n, None, None, False, True, False)
    names = ["attempt", "budget", "focused", "accepted", "faulty", "hit_token_limit"]
    send = lambda numbers: list(machine.handleInputRows((7,), iter([pd.DataFrame([row(n) for n in numbers], columns=names)]), None))
    out = send([0, *range(3, 300, 3)])[0].iloc[0]
    assert (out.attempts, out.waiting) == (0, 99)
    send(range(2, 300, 3))
    out = send(range(1, 300, 3))[0].iloc[0]
    assert (out.status, out.attempts, out.ignored, out.waiting) == ("unresolved", 2, 297, 0)
    assert machine.state.calls == 6 and machine.early.calls == 6
