"""Web archives as seekable Zstandard bundles.

Every task writes its pages as WARC records into bundles. Records are grouped into frames of about
``FRAME_BYTES``, each an independent Zstandard frame; a skippable frame with the seek table (compressed and raw size
of every frame) ends the bundle. The index maps a record to bundle, frame and place inside the raw frame, so one
record is read by decompressing one frame. A page whose payload equals that of another page becomes a revisit of
the one with the largest id if the payload has at least ``REVISIT_BYTES`` bytes.

Bundles go to the shared folder through a file system that pyarrow can open (file, s3, gs, hdfs). Names are unique
per attempt and only the index of the attempt that Spark accepted names a bundle, so lost or repeated tasks
leave no wrong record. A null html is the empty payload; a null url leaves out the target. Rows that share the
largest id of a payload are all responses; rows without id count as smaller than any. Reading checks the digest
of every response and the sizes in the seek table and raises on a difference.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from quillsift.session import ensure_checkpoint_dir, settled

FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 256 << 20
REVISIT_BYTES = 0
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format: magic of a skippable frame, magic of its footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id bigint, bundle string, frame int, place int, length int"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, response: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest32(payload)}"))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", name(response)), ("X-Payload-Length", str(len(payload)))]
        payload = b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header, payload and the place after the record that starts at ``at``."""
    stop = raw.index(b"\r\n\r\n", at)
    lines = raw[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    end = stop + 4 + int(head["Content-Length"])
    if raw[end:end + 4] != b"\r\n\r\n":
        raise ValueError("record without end")
    return head, raw[stop + 4:end], end + 4


class Bundle:
    """Writes one bundle; ``add`` returns frame and place of a record."""

    def __init__(self, stream):
        self.stream, self.coder = stream, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.sizes, self.waiting, self.raw, self.written = [], [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.raw and self.raw + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.sizes), self.raw
        self.waiting.append(data)
        self.raw += len(data)
        return place

    def flush(self) -> None:
        if self.raw:
            packed = self.coder.compress(b"".join(self.waiting))
            self.stream.write(packed)
            self.sizes.append((len(packed), self.raw))
            self.written += len(packed)
            self.waiting, self.raw = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


def seek_table(stream) -> list[tuple[int, int, int]]:
    """Offset, compressed and raw size of every frame, from the end of a bundle."""
    size = stream.seek(0, io.SEEK_END)
    stream.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != FOOTER or flags:
        raise ValueError("no seek table")
    stream.seek(size - 9 - 8 * count - 8)
    if struct.unpack("<II", stream.read(8)) != (SKIPPABLE, 8 * count + 9):
        raise ValueError("damaged seek table")
    out, at = [], 0
    for packed, raw in struct.iter_unpack("<II", stream.read(8 * count)):
        out.append((at, packed, raw))
        at += packed
    return out


def frame(stream, entry: tuple[int, int, int]) -> bytes:
    at, packed, raw = entry
    stream.seek(at)
    data = zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=max(raw, 1))
    if len(data) != raw:
        raise ValueError("frame differs from its seek table")
    return data


def described(head: dict[str, str], payload: bytes) -> tuple:
    """Row of ``RECORDS`` from a parsed record."""
    number = lambda name: int(name[10:-1]) if len(name) > 11 else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "revisit":
        return number(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), digest, "revisit", number(head["WARC-Refers-To"])
    if digest32(payload) != digest:
        raise ValueError("payload differs from its digest")
    return number(head["WARC-Record-ID"]), len(payload), digest, "response", None


def _write(folder: str):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        bundle, name = None, ""
        rows: list[tuple] = []
        for batch in batches:
            for page, url, html, response, shared in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "response", "shared"))):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(store.open_output_stream(f"{root}/{name}", compression=None))
                payload = (html or "").encode("utf-8", "surrogatepass")
                revisit = bool(shared) and len(payload) >= REVISIT_BYTES and page != response
                data = record(page, url, payload, response, revisit)
                at, place = bundle.add(data)
                rows.append((page, name, at, place, len(data)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if len(rows) >= 10_000:
                yield _index(rows)
        if bundle is not None:
            bundle.close()
        yield _index(rows)
    return run


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    columns = list(zip(*rows)) or [()] * 5
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "bundle", "frame", "place", "length"])


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as bundles below ``folder``; returns the index of the records."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    keyed = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    groups = keyed.groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    joined = keyed.join(groups.select("sha", "response", F.lit(True).alias("shared")), "sha", "left")
    return settled(joined.select("page_id", "url", "html", "response", "shared").mapInArrow(_write(folder), INDEX))


def read(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that the index names, as ``RECORDS`` rows."""
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with store.open_input_file(f"{root}/{name}") as stream:
                    for entry in seek_table(stream):
                        raw, at, rows = frame(stream, entry), 0, []
                        while at < len(raw):
                            head, payload, at = parse(raw, at)
                            rows.append(described(head, payload))
                        yield _records(rows)

    # One row per bundle: few rows, but each is minutes of work, so they are dealt out one by one.
    bundles = index.select("bundle").distinct()
    return bundles.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, RECORDS)


def fetch(wanted: DataFrame, folder: str) -> DataFrame:
    """Single records by their index rows (``INDEX``), each read through its frame alone."""
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for name, number, place in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "place"))):
                with store.open_input_file(f"{root}/{name}") as stream:
                    head, payload, _ = parse(frame(stream, seek_table(stream)[number]), place)
                rows.append(described(head, payload))
            yield _records(rows)

    return wanted.select("bundle", "frame", "place").mapInArrow(run, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names)


def fresh_folder(spark) -> str:
    """A new folder for bundles in the folder that the cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
