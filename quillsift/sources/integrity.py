"""Id sets, manifests and identities: checks that decide whether results may be combined or reused."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillsift.functions import text as tx


def id_difference(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Ids found on one side only: ``(id, side)`` with side ``missing`` (right) or ``extra`` (left)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    extra = a.join(b, key, "left_anti").withColumn("side", F.lit("extra"))
    return extra.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("missing")))


def leaks(train: DataFrame, held_out: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the training side whose key also occurs on the held-out side."""
    return train.join(held_out.select(key).distinct(), key, "left_semi")


def subset(part: DataFrame, whole: DataFrame, key: str = "id") -> DataFrame:
    """One row: distinct keys of ``part``, how many ``whole`` lacks, and whether none is missing."""
    found = whole.select(key, F.lit(1).alias("_found")).distinct()
    rows = part.select(key).distinct().join(found, key, "left")
    missing = F.count_if(F.col("_found").isNull())
    return rows.agg(F.count("*").alias("n"), missing.alias("missing"), (missing == 0).alias("is_subset"))


def pending(work: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Work not yet in the journal."""
    return work.join(done.select(key), key, "left_anti")


def question_mismatches(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Ids without a cached record or with one for a different question text."""
    r = records.select("id", F.col("question").alias("cached"))
    return questions.join(r, "id", "left").where(~F.col("question").eqNullSafe(F.col("cached"))).select("id", "cached")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size, sha256)`` of all files below a folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/") + "/"
    return files.select(
        F.substring_index("path", root, -1).alias("path"), F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"))


def manifest_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows whose file is absent or different, and files outside the manifest."""
    a = manifest.select("path", F.col("size").alias("size_expected"), F.col("sha256").alias("sha_expected"))
    rows = a.join(files, "path", "full")
    problem = (F.when(F.col("sha256").isNull(), "missing").when(F.col("sha_expected").isNull(), "unlisted")
               .when(F.col("size") != F.col("size_expected"), "size").when(F.col("sha256") != F.col("sha_expected"), "hash"))
    return rows.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


def table_digest(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """One row identifying a table regardless of row order: count and combined row hashes.

    Row hashes are summed, so nothing is sorted or collected.
    """
    text = F.concat_ws(",", *[tx.json_text(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (key, *values)])
    digest = F.sha2(text, 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("identity"))


def write_small_json(path: str, value) -> None:
    """Replace a small driver-side file as a whole; readers see the old or the new one."""
    temporary = path + ".tmp"
    with open(temporary, "w", encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, indent=2, allow_nan=False)
        out.write("\n")
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Does a path exist on whatever file system it names?"""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def claim(spark: SparkSession, path: str, identity: dict) -> None:
    """Record the identity of an output folder, or fail if it belongs to different inputs."""
    marker, text = f"{path}/_identity", json.dumps(identity, sort_keys=True, ensure_ascii=False)
    if exists(spark, marker):
        if spark.read.text(marker).first()["value"] != text:
            raise ValueError("inputs or settings changed; choose a new output")
    else:
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(marker)


def with_provenance(rows: DataFrame, identity: dict) -> DataFrame:
    """Carry the identity of the run that produced the rows as a column."""
    return rows.withColumn("provenance", F.lit(json.dumps(identity, sort_keys=True, ensure_ascii=False)))


def find_snapshot(spark: SparkSession, root: str, stage: str, name: str = "manifest.json") -> str:
    """The one folder below ``root`` whose manifest says it holds ``stage``; names do not matter."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    match = found.where(F.get_json_object("value", "$.stage") == stage).select(
        F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).limit(2).collect()
    if len(match) != 1:
        raise ValueError(f"{'several' if match else 'no'} snapshots of stage {stage} below {root}")
    return match[0]["folder"]
