"""One large JSON object read by many tasks.

Spark's text reader cuts a file into byte ranges; with the quotation mark as line separator a range begins right
behind a mark, wherever it lies. Whether that place is inside a string and how deep it is nested depends on everything
before it, so a first pass tells for every range how it would change both, for either beginning, and composing these
few numbers gives the state in which every range begins. A second pass cuts the ranges at the borders of the members
of one level; members that cross ranges are put together afterwards. Every member is parsed strictly by itself, and
keys that occur twice are found across ranges by grouping.

Files need to be uncompressed to be read by more than one task. A file without members (``{}``) gives no rows, an
empty file or anything that is not one object is an error, as are NaN and infinities, repeated keys at any depth,
members without key, and stray commas.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillsift.operators.sizing import hinted
from quillsift.session import settled
from quillsift.sources.json_objects import strict_object, require_none

MARK = "\ufeff"
MARKS = re.compile(r"[{}\[\],]")
CHANGE = "file string, start bigint, out_inside boolean, out_depth bigint, in_inside boolean, in_depth bigint"
STATE = "file string, start bigint, inside boolean, depth bigint"
#: kind: member (found whole in a range), text (all others, or a part of one), range (one per range, seq counts borders),
#: section (an object whose members are read, with its key).
PIECE = ("file string, start bigint, kind string, seq bigint, section_at bigint, section bigint, id string, value string, "
         "opener string, closer string, within boolean")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", '"').text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _escaped(segment: str) -> bool:
    """Is the quotation mark behind this part of a string escaped?"""
    return (len(segment) - len(segment.rstrip("\\"))) % 2 == 1


def _ranges(batches, columns) -> Iterator[tuple]:
    """Rows of Arrow batches with a flag for the first one of a range."""
    last = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            yield row, row[:2] != last
            last = row[:2]


def _changes(batches):
    """How a range changes (inside a string, depth), for a beginning outside (first) and inside a string."""
    out, state = [], None

    def close():
        if state is not None:
            (file, start), (a, b) = state
            out.append((file, start, a[0], a[1], b[0], b[1]))

    for (file, start, value), fresh in _ranges(batches, ("file", "start", "value")):
        if fresh:
            close()
            state = (file, start), [[False, 0], [True, 0]]
        deeper = value.count("{") + value.count("[") - value.count("}") - value.count("]")
        stays = _escaped(value)
        for way in state[1]:
            if way[0]:
                way[0] = stays
            else:
                way[0], way[1] = True, way[1] + deeper
    close()
    yield _batch(out, CHANGE)


def _begins(batches):
    """Files with the changes of their ranges in order to the state in which every range begins."""
    for batch in batches:
        out = []
        for file, changes in zip(batch.column("file").to_pylist(), batch.column("changes").to_pylist()):
            inside, depth = False, 0
            for c in changes:
                out.append((file, c["start"], inside, depth))
                inside, depth = (c["in_inside"], depth + c["in_depth"]) if inside else (c["out_inside"], depth + c["out_depth"])
            # A file ends without a mark, so its last part counts as the beginning of one more string.
            if depth or not inside:
                raise ValueError(f"not one complete JSON object: {file}")
        yield _batch(out, STATE)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


class _Cutter:
    """Cuts one range at the borders of the members of a level.

    A border is a comma between members or a bracket that begins or ends the object that holds them. A piece lies
    between two borders: within such an object it is a member, otherwise the text that leads to the next object.
    """

    def __init__(self, file: str, start: int, inside: bool, depth: int, level: int):
        self.file, self.start, self.inside, self.depth, self.level = file, start, inside, depth, level
        self.text: list[str] = []
        # The range that begins a file opens a piece, any other one goes on with a piece of an earlier range.
        self.opener = "" if start == 0 else None
        self.seq, self.section = 0, None

    def _piece(self, closer: str | None) -> list[tuple]:
        text, self.text = "".join(self.text), []
        within, opener, seq = self.depth >= self.level, self.opener, self.seq
        self.opener, self.seq = closer, seq + 1
        at = self.start if self.section is not None else None
        if within and opener is not None and closer is not None:
            return [(self.file, self.start, "member", seq, at, self.section, k, v, None, None, True) for k, v in members_of(text, opener, closer)]
        return [(self.file, self.start, "text", seq, at, self.section, None, text, opener, closer, within)]

    def feed(self, segment: str) -> list[tuple]:
        """Rows of the pieces that end in a segment, which a quotation mark follows."""
        if self.inside:
            self.text.append(segment + '"')
            self.inside = _escaped(segment)
            return []
        out, at = [], 0
        for mark in MARKS.finditer(segment):
            sign, here = mark.group(), mark.start()
            change = 1 if sign in "{[" else -1 if sign in "}]" else 0
            if (self.depth == self.level and change <= 0) or (self.depth == self.level - 1 and change == 1):
                self.text.append(segment[at:here])
                out += self._piece(sign)
                at = here + 1
                if change == 1:
                    self.section = self.seq
            self.depth += change
        self.text.append(segment[at:] + '"')
        self.inside = True
        return out

    def end(self) -> list[tuple]:
        borders = self.seq
        return self._piece(None) + [(self.file, self.start, "range", borders, self.start if self.section is not None else None, self.section,
                                     None, None, None, None, None)]


def members_of(text: str, opener: str, closer: str) -> list[tuple[str, str]]:
    """Key and value of the text between two borders, none between the braces of an empty object."""
    if opener == "[" or closer == "]":
        raise ValueError("members are read from objects, not from lists")
    if not text.strip():
        if opener == "{" and closer == "}":
            return []
        raise ValueError(f"nothing between {opener} and {closer}")
    whole = strict_object("{" + text + "}")
    if len(whole) != 1:
        raise ValueError("a member needs one key and one value")
    return [(k, json.dumps(v, ensure_ascii=False)) for k, v in whole.items()]


def leading_members(text: str, opener: str, closer: str | None, level: int) -> tuple[list[tuple[str, str]], str | None]:
    """The text before, between and behind the objects that hold members: its own plain members and the next object's key."""
    body = text.strip()
    if closer is None:
        body = body.removesuffix('"').rstrip()  # the mark that every last part is given
    if level == 1:
        if body:
            raise ValueError("text around the object")
        return [], None
    if closer is None:
        if not body.endswith("}"):
            raise ValueError("the object does not end")
        body = body[:-1].strip()
    if opener == "":
        if not body.startswith("{"):
            raise ValueError("expected an object")
        body = body[1:]
    elif body and not body.startswith(","):
        raise ValueError("a comma is missing")
    elif body:
        body = body[1:]
        if not body.strip():
            raise ValueError("a stray comma")
    whole = strict_object("{" + body + (" null}" if closer else "}"))
    found = [(k, json.dumps(v, ensure_ascii=False)) for k, v in whole.items()]
    return (found[:-1], found[-1][0]) if closer else (found, None)


def _cut(level: int):
    def run(batches):
        cutter, out = None, []
        for (file, start, value, inside, depth), fresh in _ranges(batches, ("file", "start", "value", "inside", "depth")):
            if fresh:
                out += cutter.end() if cutter is not None else []
                cutter = _Cutter(file, start, inside, depth, level)
            out += cutter.feed(value.removeprefix(MARK) if fresh and start == 0 else value)
            if len(out) >= 1000:
                yield _batch(out, PIECE)
                out = []
        yield _batch(out + (cutter.end() if cutter is not None else []), PIECE)
    return run


def _joined(level: int):
    """Pieces put together from their parts to members, and to the keys of the objects that they lead to."""
    def run(batches):
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("file", "parts", "section_at", "section")]
            for file, parts, section_at, section in zip(*columns):
                text, last = "".join(p["value"] for p in parts), parts[-1]
                opener, closer, within = parts[0]["opener"], last["closer"], last["within"]
                if within:
                    out += [(file, last["start"], "member", last["seq"], section_at, section, k, v, None, None, True)
                            for k, v in members_of(text, opener, closer)]
                    continue
                found, key = leading_members(text, opener, closer, level)
                out += [(file, last["start"], "member", last["seq"], None, None, k, v, None, None, False) for k, v in found]
                if closer is not None:
                    out.append((file, last["start"], "section", last["seq"], last["start"], last["seq"] + 1, key, None, None, None, False))
            yield _batch(out, PIECE)
    return run


def read_large(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """``(file, parent, id, value)`` of the members of level 1 or 2 of the object in each file below ``path``.

    On level 2 the members of the objects inside the object are rows with that object's key as ``parent``; members
    of the object that are no objects themselves are rows without parent. Values stay JSON.
    """
    segments = _segments(spark, path)
    changes = segments.mapInArrow(_changes, CHANGE)
    each = F.struct("start", "out_inside", "out_depth", "in_inside", "in_depth")
    # One row per file with a few numbers per range of it.
    states = settled(changes.groupBy("file").agg(F.array_sort(F.collect_list(each)).alias("changes")).mapInArrow(_begins, STATE))
    ranges = states.count()
    if states.select("file").distinct().count() < len(set(segments.inputFiles())):
        raise ValueError(f"an empty file below {path}")
    # The join has to keep the order of the parts of a range, which a broadcast does; ranges are large, so they are few.
    told = segments.join(F.broadcast(states), ["file", "start"])
    pieces = settled(told.select("file", "start", "value", "inside", "depth").mapInArrow(_cut(level), PIECE))

    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("start") == 0) | (F.col("seq") > 0)
    carried = pieces.where("kind = 'range'").select(
        "file", "start", F.last(F.when(opens, F.struct("start", "seq")), True).over(before).alias("tail"),
        F.last(F.when(F.col("section").isNotNull(), F.struct("section_at", "section")), True).over(before).alias("into"))
    found = pieces.where("kind IN ('member', 'text')").join(hinted(carried, ranges), ["file", "start"])
    found = found.withColumn("section_at", F.coalesce("section_at", "into.section_at")).withColumn("section", F.coalesce("section", "into.section"))
    whole = found.where("kind = 'member'").select(*[f.split()[0] for f in PIECE.split(", ")])
    own = F.when(F.col("opener").isNotNull(), F.struct("start", "seq")).otherwise(F.col("tail"))
    parts = found.where("kind = 'text'").withColumn("own", own)
    fields = F.struct("start", "seq", "value", "opener", "closer", "within", "section_at", "section")
    stitched = (parts.groupBy("file", "own").agg(F.array_sort(F.collect_list(fields)).alias("parts"))
                .select("file", "parts", F.get("parts", F.lit(0))["section_at"].alias("section_at"), F.get("parts", F.lit(0))["section"].alias("section")))
    stitched = settled(stitched.mapInArrow(_joined(level), PIECE))
    members = whole.unionByName(stitched.where("kind = 'member'"))
    sections = stitched.where("kind = 'section'").select("file", F.col("section_at").alias("at"), F.col("section").alias("no"), F.col("id").alias("parent"))
    here = (members["file"] == sections["file"]) & (members["section_at"] == sections["at"]) & (members["section"] == sections["no"])
    rows = members.join(hinted(sections, sections.count()), here, "left").select(
        members["file"], F.when(F.col("within"), F.col("parent")).alias("parent"), members["id"], members["value"])
    keys = rows.select("file", "parent", "id").unionByName(sections.where("parent IS NOT NULL").select("file", F.lit(None).cast("string").alias("parent"), F.col("parent").alias("id")))
    require_none(keys.groupBy("file", "parent", "id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate JSON key")
    return rows


def read_records(spark: SparkSession, path: str, records: str = "records", header: str = "identity") -> tuple[DataFrame, DataFrame]:
    """Header ``(id, value)`` and records ``(id, value)`` of a file that holds an identity object and many records."""
    rows = settled(read_large(spark, path, 2))
    odd = rows.where(F.col("parent").isNull() | ~F.col("parent").isin(records, header)).select("parent", "id")
    require_none(odd, "unexpected member")
    part = lambda name: rows.where(F.col("parent") == name).select("id", "value")
    require_none(spark.range(1).where(F.lit(part(header).isEmpty())), f"no {header}")
    return part(header), part(records)


def write_objects(entries: DataFrame, path: str, known: dict) -> None:
    """Write ``entries(entry)``, texts of the form ``"key": value``, as objects ``{"identity": ..., "records": {...}}``.

    Every task writes one object; its lines are the entries, streamed.
    """
    head = '{"identity": ' + json.dumps(known, ensure_ascii=False) + ', "records": {'

    def lines(batches):
        last = None
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for batch in batches:
            texts = batch.column("entry").to_pylist()
            if texts:
                out = ([last + ","] if last is not None else []) + [t + "," for t in texts[:-1]]
                last = texts[-1]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([*([last] if last is not None else []), "}}"])], ["value"])

    entries.mapInArrow(lines, "value string").write.text(path)
