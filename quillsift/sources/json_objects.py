"""Strict JSON objects, question sets, references and corpora as DataFrames.

Spark's JSON reader keeps the last of two equal keys and accepts NaN. Files of this kind are one
object each, so every file is parsed strictly by one small function and exploded into rows; many
files are parsed in parallel.
"""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MEMBERS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("value", T.StringType())]))


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        seen = set()
        twice = next(k for k, _ in pairs if k in seen or seen.add(k))
        raise ValueError(f"duplicate JSON key: {twice}")
    return out


def _no_constant(name):
    raise ValueError(f"{name} is not allowed")


def strict_object(text: str) -> dict:
    """A JSON object without duplicate keys, NaN or infinities; a byte-order mark is ignored."""
    value = json.loads(text.removeprefix("\ufeff"), object_pairs_hook=_unique, parse_constant=_no_constant)
    if not isinstance(value, dict):
        raise ValueError("expected a JSON object")
    return value


@F.pandas_udf(MEMBERS)
def _members(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"id": k, "value": json.dumps(v, ensure_ascii=False)} for k, v in strict_object(t).items()])


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """``(id, value)`` for the members of the JSON object in each file; values stay JSON."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(_members("value")).alias("m")).select("m.id", "m.value")


def require_none(violations: DataFrame, message: str) -> None:
    """Raise with an example when a table of violations is not empty."""
    example = violations.first()
    if example is not None:
        raise ValueError(f"{message}: {example.asDict()}")


def read_questions(spark: SparkSession, path: str, answers: bool = False) -> DataFrame:
    """``(id, question[, answer])``; blank or missing texts are an error, answers stay verbatim."""
    fields = ["question", "answer"] if answers else ["question"]
    rows = read_members(spark, path)
    rows = rows.select("id", *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])
    bad = F.lit(False)
    for f in fields:
        bad = bad | F.col(f).isNull() | ~F.col(f).rlike("\\S")
    require_none(rows.where(bad).select("id"), "invalid question record")
    return rows


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``(id, answer)`` from either ``{id: text}`` or ``{id: {"answer": text}}``."""
    rows = read_members(spark, path)
    plain = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]
    rows = rows.select("id", F.when(F.startswith("value", F.lit("{")), F.get_json_object("value", "$.answer"))
                       .otherwise(plain).alias("answer"))
    require_none(rows.where(F.col("answer").isNull() | ~F.col("answer").rlike("\\S")).select("id"), "invalid reference")
    return rows


def archive_members(archives: DataFrame) -> DataFrame:
    """``(name, value)``: the JSON texts inside zip archives given as ``content``, one row per member."""
    def texts(batches):
        for batch in batches:
            for packed in batch["content"]:
                archive = zipfile.ZipFile(io.BytesIO(packed))
                wanted = (m for m in archive.infolist() if m.filename[-5:] == ".json" and m.filename.split("/")[0] != "__MACOSX")
                for member in wanted:
                    yield pd.DataFrame({"name": [member.filename], "value": [str(archive.read(member), "utf-8-sig")]})

    return archives.select("content").mapInPandas(texts, "name string, value string")


def plain_text(value: Column) -> Column:
    """A JSON value as text: strings decoded, other values as written, null as null."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Source documents, one JSON object per file, from a folder or from zip archives.

    Folders are searched recursively for ``context_*.json``; archive members under ``__MACOSX/`` are
    skipped. Documents without id or passage, or with a passage that is neither text nor null, are an
    error. The scan order of the results is the order of ``source_file``.
    """
    if path.endswith(".zip"):
        files = archive_members(spark.read.format("binaryFile").load(path))
    else:
        reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "context_*.json")
        inside = "^.*?" + path.strip("/").replace(".", "\\.") + "/"
        files = reader.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_path", inside, "").alias("name"), "value")
    fields = files.select("name", F.map_from_entries(_members("value")).alias("f"))
    passage = F.col("f")["passage"]
    odd = ~F.map_contains_key("f", "id") | ~F.map_contains_key("f", "passage") | ~(passage.startswith('"') | (passage == "null"))
    fields = fields.select("f", "name", F.when(odd, F.raise_error(F.concat(F.lit("invalid id or passage at "), F.col("name")))).alias("bad"))
    optional = lambda key: F.coalesce(plain_text(F.col("f")[key]), F.lit(""))
    return fields.select(F.coalesce(F.col("bad").cast("string"), plain_text(F.col("f")["id"])).alias("id"), optional("name").alias("name"),
                         optional("link").alias("link"), plain_text(passage).alias("passage"), F.col("name").alias("source_file"))
