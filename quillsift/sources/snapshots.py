"""Snapshots packed as zip archives, held against their manifest."""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LISTING = "archive string, path string, size bigint, sha256 string, safe boolean, sound boolean"
#: Bytes of a member that are unpacked at once.
PIECE = 1 << 20
PROBLEMS = ("unsafe", "corrupt", "duplicate", "missing", "unlisted", "size", "hash")


def safe_path(path: str) -> bool:
    """A relative path in plain form that stays inside its folder on any system."""
    plain = path and "\\" not in path and ":" not in path and "\0" not in path and not path.startswith("/")
    return bool(plain) and posixpath.normpath(path) == path and path.split("/")[0] not in ("..", ".")


def _member(archive: zipfile.ZipFile, entry: zipfile.ZipInfo) -> tuple[int, str | None, bool]:
    """Unpacked size, digest and whether the stored check sum holds; nothing is unpacked beyond the stated size."""
    whole, size = hashlib.sha256(), 0
    try:
        with archive.open(entry) as source:
            while piece := source.read(PIECE):
                size += len(piece)
                if size > entry.file_size:
                    return size, None, False
                whole.update(piece)
    except (zipfile.BadZipFile, EOFError, OSError, RuntimeError, NotImplementedError):
        return size, None, False
    return size, whole.hexdigest(), size == entry.file_size


def listing(archives: DataFrame) -> DataFrame:
    """One row per member of the zip archives ``(archive, content)``; folders are left out.

    Unsafe members are listed but never unpacked. A content that is no archive gives one unsound row without path.
    """
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer() or b"")) as archive:
                        for entry in archive.infolist():
                            if entry.is_dir():
                                continue
                            safe = safe_path(entry.filename)
                            size, digest, sound = _member(archive, entry) if safe else (entry.file_size, None, True)
                            rows.append((name, entry.filename, size, digest, safe, sound))
                except zipfile.BadZipFile:
                    rows.append((name, None, None, None, True, False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))],
                    [c.split()[0] for c in LISTING.split(", ")])

    return archives.select("archive", "content").mapInArrow(run, LISTING)


def violations(members: DataFrame, manifest: DataFrame, may_miss=None) -> DataFrame:
    """``(archive, path, problem)`` of all members and manifest rows that do not fit, the first problem of each.

    ``manifest`` is ``(archive, path, size, sha256)``; ``may_miss`` is a condition on its rows that may be absent.
    """
    copies = members.groupBy("archive", "path").agg(
        F.count("*").alias("copies"), F.max("size").alias("size"), F.max("sha256").alias("sha256"), F.min("safe").alias("safe"), F.min("sound").alias("sound"))
    wanted = manifest.select(F.col("archive").alias("in_archive"), F.col("path").alias("stated_path"), F.col("size").alias("size_stated"), F.col("sha256").alias("sha_stated"),
                             (F.lit(False) if may_miss is None else may_miss).alias("may_miss"))
    rows = copies.join(wanted, (F.col("archive") == F.col("in_archive")) & F.col("path").eqNullSafe(F.col("stated_path")), "full")
    problem = (F.when(~F.col("safe"), "unsafe").when(~F.col("sound"), "corrupt").when(F.col("copies") > 1, "duplicate")
               .when(F.col("copies").isNull(), F.when(~F.col("may_miss"), "missing")).when(F.col("sha_stated").isNull(), "unlisted")
               .when(F.col("size") != F.col("size_stated"), "size").when(F.col("sha256") != F.col("sha_stated"), "hash"))
    return rows.select(F.coalesce("archive", "in_archive").alias("archive"), F.coalesce("path", "stated_path").alias("path"),
                       problem.alias("problem")).where(F.col("problem").isNotNull())


def packed(files: DataFrame) -> DataFrame:
    """``(archive, content)``: the files ``(archive, path, data)`` of each archive as one zip, paths in order.

    An archive is one value of a row, so keep archives small.
    """
    def pack(table: pa.Table) -> pa.Table:
        rows, out = sorted(table.to_pylist(), key=lambda r: (r["path"], r["data"])), io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for r in rows:
                archive.writestr(zipfile.ZipInfo(r["path"], (1980, 1, 1, 0, 0, 0)), r["data"])
        return pa.table({"archive": [rows[0]["archive"]], "content": pa.array([out.getvalue()], pa.binary())})

    return files.select("archive", "path", "data").groupBy("archive").applyInArrow(pack, "archive string, content binary")
