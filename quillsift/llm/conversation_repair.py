"""Conversation structure repair by weighted CYK parsing over spans.

A conversation must read ``(s?(ua)+)?`` in the initials of its roles. Its rows are edited at a cost: Keep (K, 0),
Rerole to user or assistant (R, 1), Delete (D, 2, required for blank and duplicate rows), Insert a message without
text (I, 5); a truncated row that is not deleted adds 5. Of the cheapest edits the one whose initials come first in
ASCII order is taken.

The repair grammar is in Chomsky normal form: nonterminal (p, q) spans rows that lead from state p to state q of the
language, with rules (p, q) -> (p, r) (r, q), and single rows as terminals. The cell of a span holds the smallest
(cost, audit) of each nonterminal. The cell of the empty span is the insertion closure, and every terminal is closed on
both sides. Charts are filled bottom-up by span length up to ``BLOCK`` rows; cells of blocks combine pairwise into
longer spans. Any two audits of one span and cost differ before the shorter one ends (an insertion costs), so the
order of audits survives concatenation, and a span's cell does not depend on where it was divided. Equal role
patterns share cells through a table of bounded size.

On Spark rows are sorted by range over (conversation, turn, role, text hash), so a conversation of any length is
dealt over tasks; a task turns its part of a conversation into one cell, and only cells of conversations that cross a
border between tasks meet again. Texts move once, for the digest of the repaired conversation, which one stream per
conversation has to compute in order.

Defined cases: a null role or text is one space, a null turn comes first and is one space in the damage key, a null
conv_id is a conversation of its own. Rows of one turn are ordered by role and text hash after the damage. Repeated
rows all count. Roles that begin with neither s, u nor a cannot be kept. A conversation without rows after damage has
zeros, an empty audit and the digest of the empty string. An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillsift.operators.sizing import SALTS

BLOCK = 16
#: Cells of short spans that a worker keeps.
KEPT_CELLS = 200_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: state: {initial: next state}. States: nothing yet, after system, after user, after assistant.
MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
BLANK_CHARS = r"\x20\x09-\x0D"
SUMS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "distinct_turns")
RESULT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")

Cell = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cell, right: Cell) -> Cell:
    """Binary rules: the smallest (cost, audit) of (p, q) over all (p, r) on the left and (r, q) on the right."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None:
                whole = (cost + other[0], audit + other[1])
                if (p, q) not in out or whole < out[p, q]:
                    out[p, q] = whole
    return out


def closure() -> Cell:
    """The empty span: nothing, or insertions that move on."""
    step = {(p, q): (INSERT, "I") for p, moves in MOVES.items() for initial, q in moves.items() if initial in "ua"}
    cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(3):
        for key, value in joined(cell, step).items():
            cell[key] = min(value, cell.get(key, value))
    return cell


CLOSURE = closure()


def terminal(mark: str) -> Cell:
    """A row: its role initial in lower case if it is sound, upper case if truncated, ``-`` if it must be deleted."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if mark != "-":
        extra, own = (TRUNCATED if mark.isupper() else 0), mark.lower()
        for p, moves in MOVES.items():
            for initial, q in moves.items():
                options = [(KEEP + extra, "K")] if initial == own else []
                options += [(REROLE + extra, "R")] if initial in "ua" else []
                for option in options:
                    cell[p, q] = min(option, cell.get((p, q), option))
    return joined(joined(CLOSURE, cell), CLOSURE)


class Charts:
    """Cells by the marks of their rows."""

    def __init__(self):
        self.cells: dict[str, Cell] = {}

    def block(self, marks: str) -> Cell:
        """Chart over all spans of at most ``BLOCK`` rows, shorter spans first, every division tried."""
        if marks in self.cells:
            return self.cells[marks]
        if len(self.cells) > KEPT_CELLS:
            self.cells.clear()
        for size in range(1, len(marks) + 1):
            for at in range(len(marks) - size + 1):
                span = marks[at:at + size]
                if span in self.cells:
                    continue
                if size == 1:
                    self.cells[span] = terminal(span)
                    continue
                best: Cell = {}
                for cut in range(1, size):
                    for key, value in joined(self.cells[span[:cut]], self.cells[span[cut:]]).items():
                        if key not in best or value < best[key]:
                            best[key] = value
                self.cells[span] = best
        return self.cells[marks]


class Span:
    """A growing span: blocks combine like the digits of a counter carry, so spans of equal length meet."""

    def __init__(self, charts: Charts):
        self.charts, self.open, self.level = charts, [], []

    def add(self, mark: str, times: int = 1) -> None:
        while times > 0:
            taken = min(times, BLOCK - len(self.open))
            self.open += mark * taken
            times -= taken
            if len(self.open) == BLOCK:
                self._push(1, self.charts.block("".join(self.open)))
                self.open = []

    def _push(self, height: int, cell: Cell) -> None:
        while self.level and self.level[-1][0] == height:
            cell = joined(self.level.pop()[1], cell)
            height += 1
        self.level.append((height, cell))

    def cell(self) -> Cell:
        parts = [c for _, c in self.level] + ([self.charts.block("".join(self.open))] if self.open else [])
        return reduce(lambda right, left: joined(left, right), reversed(parts)) if parts else CLOSURE


def verdict(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in FINAL if (0, q) in cell)


# --- the damage and the rows as Spark columns ------------------------------------------------------------------------


def _or_space(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: copies is 0 for a dropped row and 2 for a repeated one."""
    kind = F.crc32(F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn")))) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                kind.alias("kind"), _or_space(F.col("role")).alias("role"), _or_space(F.col("text")).alias("text"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns for conversations that are repaired as they are."""
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), _or_space(F.col("role")).alias("role"),
        _or_space(F.col("text")).alias("text"), F.lit(1).alias("copies"))


def _bundles(rows: DataFrame) -> DataFrame:
    """One row per equal rows of a turn: how many there are, their mark, how many duplicate an earlier row."""
    last = F.regexp_extract("text", rf"([^{BLANK_CHARS}])[{BLANK_CHARS}]*+\z", 1)
    fault = F.when(last == "", F.lit("b")).when(F.instr(F.lit(".!?"), last) > 0, F.lit("")).otherwise(F.lit("t"))
    light = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("sha"), fault.alias("fault"), "copies")
    bundles = light.groupBy("conv_id", "turn", "role", "sha", "fault").agg(F.sum("copies").alias("n"))
    said = bundles.where("n > 0").withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    # Only texts said again need the turn in which they came first; its rows are repeated per salt for hot ones.
    first = (said.groupBy("conv_id", "role", "sha").agg(F.min("at").alias("first"), F.count("*").alias("turns")).where("turns > 1")
             .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s"), F.col("first.turn").alias("first_turn"),
                     F.explode(F.sequence(F.lit(0), F.lit(SALTS // 4 - 1))).alias("salt")))
    salted = bundles.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS // 4)).cast("int"))
    met = salted.alias("b").join(first.alias("f"), F.col("b.conv_id").eqNullSafe(F.col("c")) & (F.col("b.role") == F.col("r"))
                                 & (F.col("b.sha") == F.col("s")) & (F.col("b.salt") == F.col("f.salt")), "left")
    fresh = F.col("r").isNull() | F.col("turn").eqNullSafe(F.col("first_turn"))
    return met.select("conv_id", "turn", "role", "sha", "fault", "n", fresh.alias("fresh"))


PART = ("conv_id bigint, whole boolean, known boolean, turn bigint, role string, sha string, n_rows bigint, blank bigint, duplicate bigint, "
        "truncated bigint, illegal bigint, distinct_turns bigint, min_turn bigint, max_turn bigint, first_initial string, last_initial string, "
        "cost array<bigint>, audits array<string>")
STATES = [(p, q) for p in range(4) for q in range(4)]


class _Part:
    """The rows of one conversation that a task sees in order."""

    def __init__(self, charts: Charts, key: tuple):
        self.key, self.span = key, Span(charts)
        self.sums = dict.fromkeys(SUMS, 0)
        self.min_turn = self.max_turn = self.last_turn = None
        self.first = self.last = None

    def add(self, turn, role: str, fault: str, n: int, fresh: bool) -> None:
        if not n:
            return
        s, initial = self.sums, role[:1]
        s["n_rows"] += n
        if turn is not None:
            if turn != self.last_turn:
                s["distinct_turns"] += 1
            self.last_turn = turn
            self.min_turn = turn if self.min_turn is None else self.min_turn
            self.max_turn = turn
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            s["illegal"] += 1
        if n > 1 and 2 * initial not in ("su", "ua", "au"):
            s["illegal"] += n - 1
        self.last = initial
        if fault == "b":
            s["blank"] += n
            self.span.add("-", n)
            return
        alive = 1 if fresh else 0
        s["duplicate"] += n - alive
        if alive:
            mark = initial if initial in ("s", "u", "a") else "o"
            s["truncated"] += fault == "t"
            self.span.add(mark.upper() if fault == "t" else mark)
        self.span.add("-", n - alive)

    def row(self, whole: bool) -> tuple:
        cell = self.span.cell()
        if whole:
            cell = {(0, 0): verdict(cell)}
        conv, turn, role, sha = self.key
        cells = [cell.get(k) for k in STATES]
        return (conv, whole, turn is not None, turn, role, sha, *(self.sums[k] for k in SUMS), self.min_turn, self.max_turn,
                self.first, self.last, [c and c[0] for c in cells], [c and c[1] for c in cells])


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(),
             "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _parts(batches):
    """Sorted bundles to one row per conversation; the first and the last of a task may go on in other tasks."""
    charts, part, number = Charts(), None, 0
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "sha", "fault", "n", "fresh")]
        for conv, turn, role, sha, fault, n, fresh in zip(*columns):
            if part is None or part.key[0] != conv:
                if part is not None:
                    out.append(part.row(number > 0))
                    number += 1
                part = _Part(charts, (conv, turn, role, sha))
            part.add(turn, role, fault, n, fresh)
        if out:
            yield _table(out, PART)
    if part is not None:
        yield _table([part.row(False)], PART)


JUDGED = "conv_id bigint, n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _judged(batches):
    """Conversations with their parts in order to one row each."""
    for batch in batches:
        out = []
        for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist()):
            sums = {k: sum(p[k] for p in parts) for k in SUMS}
            shown = [p for p in parts if p["n_rows"]]
            for before, after in zip(shown, shown[1:]):
                sums["illegal"] += before["last_initial"] + after["first_initial"] not in ("su", "ua", "au")
                if before["max_turn"] is not None and before["max_turn"] == after["min_turn"]:
                    sums["distinct_turns"] -= 1
            turns = [t for p in shown for t in (p["min_turn"], p["max_turn"]) if t is not None]
            cells = [{k: (c, a) for k, c, a in zip(STATES, p["cost"], p["audits"]) if c is not None} for p in parts]
            cost, audit = verdict(reduce(joined, cells))
            gaps = max(turns) - min(turns) + 1 - sums["distinct_turns"] if turns else 0
            out.append((conv, sums["n_rows"], gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], cost, audit))
        yield _table(out, JUDGED)


def judged(rows: DataFrame) -> DataFrame:
    """Counts of faults, cost and audit of every conversation of ``rows`` (see ``damaged``)."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "sha"]
    bundles = _bundles(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = bundles.select("conv_id", "turn", "role", "sha", "fault", "n", "fresh").mapInArrow(_parts, PART)
    fields = [c.split()[0] for c in PART.split(", ")]
    # A conversation has as many parts as tasks that saw it: one for nearly all.
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields[2:6], *fields[6:]))).alias("parts"))
    return whole.mapInArrow(_judged, JUDGED)


# --- the repaired conversations ---------------------------------------------------------------------------------------


def _line(role: str, text: str) -> str:
    return f"{role}:{text}"


class _Repair:
    """Walks the audit of a conversation beside its rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0
        self.turn = "user"

    def _role(self, own: str | None) -> str:
        role = self.turn if own is None else own
        self.turn = "assistant" if role[:1] == "u" else "user"
        return role

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._role(None), ""

    def rows(self, role: str, text: str):
        """What becomes of the next row, insertions before it included."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._role(role if edit == "K" else None), text


def _streams(batches, emit):
    """Runs ``emit.begin(header)``, ``emit.line(role, text)`` and ``emit.end()`` over headers followed by their rows."""
    repair = None
    for batch in batches:
        columns = batch.to_pydict()
        for i in range(batch.num_rows):
            if columns["kind"][i] == 0:
                if repair is not None:
                    for line in repair.inserted():
                        emit.line(*line)
                    emit.end()
                emit.begin({k: v[i] for k, v in columns.items()})
                repair = _Repair(columns["audit"][i])
            else:
                for _ in range(columns["copies"][i]):
                    for line in repair.rows(columns["role"][i], columns["text"][i]):
                        emit.line(*line)
        yield from emit.flush()
    if repair is not None:
        for line in repair.inserted():
            emit.line(*line)
        emit.end()
    yield from emit.flush()


class _Digests:
    def __init__(self):
        self.out = []

    def begin(self, header):
        self.header, self.sha, self.empty = header, hashlib.sha256(), True

    def line(self, role, text):
        self.sha.update(("" if self.empty else "\n").encode() + _line(role, text).encode("utf-8", "surrogatepass"))
        self.empty = False

    def end(self):
        h = self.header
        self.out.append((*(h[k] for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), self.sha.hexdigest()))

    def flush(self):
        if self.out:
            yield _table(self.out, RESULT)
            self.out = []


class _Messages:
    def __init__(self):
        self.out = []

    def begin(self, header):
        self.conv, self.place = header["conv_id"], 0

    def line(self, role, text):
        self.out.append((self.conv, self.place, role, text))
        self.place += 1

    def end(self):
        pass

    def flush(self):
        if self.out:
            yield _table(self.out, "conv_id bigint, turn bigint, role string, text string")
            self.out = []


def _told(rows: DataFrame) -> DataFrame:
    """Every conversation as a header with its audit, followed by its rows in order."""
    headers = judged(rows).withColumn("kind", F.lit(0))
    lines = rows.where("copies > 0").withColumn("kind", F.lit(1)).withColumn("sha", F.sha2("text", 256))
    both = headers.unionByName(lines, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "sha")


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation: fault counts, cost, audit and the digest of the repaired ``role:text`` lines."""
    return _told(rows).mapInArrow(lambda batches: _streams(batches, _Digests()), RESULT)


def repaired(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` of the repaired conversations, turns numbered from 0."""
    return _told(rows).mapInArrow(lambda batches: _streams(batches, _Messages()), "conv_id bigint, turn bigint, role string, text string")
