"""Registered queries on id sets, journals, prompts and training examples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from quillsift.catalog.answers import _contexts
from quillsift.config import Attempts, Generation
from quillsift.functions import text as tx
from quillsift.operators import prompt
from quillsift.session import ensure_checkpoint_dir
from quillsift.sources import integrity, json_stream, snapshots, tables
from quillsift.streaming import attempts, journal


def id_set_diff(spark, folder) -> DataFrame:
    """Documents without labels and labels without documents."""
    docs = tables.load(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    labels = tables.load(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return integrity.id_difference(labels, docs)


def leak_check(spark, folder) -> DataFrame:
    """Labelled documents stand for the held-out side: which document ids occur on both sides."""
    docs = tables.load(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source")
    held_out = tables.load(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return integrity.leaks(docs, held_out)


def subset_check(spark, folder) -> DataFrame:
    """Are all labelled documents there, and are all documents labelled?"""
    ids = lambda name: tables.load(spark, folder, name).select(F.col("doc_id").alias("id"))
    one = lambda part, whole: integrity.subset(ids(part), ids(whole)).withColumn("part", F.lit(part))
    return one("labels", "documents").unionByName(one("documents", "labels"))


def record_stream(spark, folder) -> DataFrame:
    """Documents as records of JSON objects, one object per task, read again by byte ranges."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    docs = tables.documents(spark, folder, "doc_id", "text", "source")
    entry = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('": '), F.to_json(F.struct("source", "text")))
    json_stream.write_objects(docs.select(entry.alias("entry")), path, {"rows": "documents"})
    header, rows = json_stream.read_records(spark, path)
    body = F.from_json("value", "source string, text string")
    return rows.select(F.col("id").cast("bigint").alias("doc_id"), body["source"].alias("source"), F.sha2(body["text"], 256).alias("text_sha"))


def snapshot_check(spark, folder) -> DataFrame:
    """Pages packed into archives of 64; by their number some are left out, renamed, changed or not in the manifest."""
    pages = tables.load(spark, folder, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    kind, plain = F.pmod("page_id", F.lit(16)), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    rows = pages.select("page_id", kind.alias("kind"), F.concat(F.lit("part-"), F.floor(F.col("page_id") / 64).cast("string")).alias("archive"), plain.alias("plain"), "html")
    path = F.when(F.col("kind") == 1, F.concat(F.lit("../"), "plain")).otherwise(F.col("plain"))
    data = F.when(F.col("kind") == 2, F.concat("html", F.lit("!"))).when(F.col("kind") == 3, F.reverse("html")).otherwise(F.col("html"))
    files = rows.where("kind <> 0").select("archive", path.alias("path"), data.cast("binary").alias("data"))
    manifest = rows.where("kind <> 4").select("archive", F.col("plain").alias("path"), F.octet_length("html").cast("bigint").alias("size"),
                                              F.sha2("html", 256).alias("sha256"))
    return snapshots.violations(snapshots.listing(snapshots.packed(files)), manifest)


def journal_pending(spark, folder) -> DataFrame:
    """Orders without a shipped line item are the work still to do."""
    work = tables.load(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    done = tables.load(spark, folder, "lineitem").where(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("id"))
    return integrity.pending(work, done)


def journal_stream(spark, folder) -> DataFrame:
    """Events carried by a stream into a journal keyed by event id, read back as a table."""
    schema = tables.load(spark, folder, "events").select("event_id", "user_id", "event_type", "value").schema
    source = (spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
              .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).parquet(folder))
    root = ensure_checkpoint_dir(spark)
    target = f"{root}/journal-{uuid.uuid4().hex}"
    ddl = "event_id long, user_id long, event_type string, value double"
    journal.follow(source, target, {"source": folder}, ddl, key="event_id")
    return journal.open_journal(spark, target, {"source": folder}, ddl)


def next_attempts(spark, folder) -> DataFrame:
    """Each user's events are the attempts of one item, numbered by event id."""
    events = tables.load(spark, folder, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("attempt"),
        F.when(F.col("value") < 20, 2048).otherwise(3072).alias("budget"), F.lit(False).alias("focused"),
        (F.col("event_type") == "purchase").alias("accepted"), (F.col("event_type") == "error").alias("faulty"),
        (F.col("event_type") != "error").alias("hit_token_limit"))
    return journal.next_attempts(events, journal.token_ladder(8192), Attempts(max_attempts=1 << 30))


def _reports(spark, folder) -> DataFrame:
    """Each user's events are the reports on its attempts, numbered by event id."""
    turn = Window.partitionBy("user_id").orderBy("event_id")
    kind = F.col("event_type")
    return tables.load(spark, folder, "events").select(
        F.col("user_id").cast("long").alias("id"), F.row_number().over(turn).alias("attempt"), F.lit(None).cast("int").alias("budget"),
        F.lit(None).cast("boolean").alias("focused"), (kind == "purchase").alias("accepted"), (kind == "error").alias("faulty"),
        kind.isin("view", "click").alias("hit_token_limit"))


def attempt_stream(spark, folder) -> DataFrame:
    """Reports arrive in three files, out of order; every batch keeps the steps it made, the last one of an item counts."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/attempts-{uuid.uuid4().hex}"
    reports = _reports(spark, folder)
    queued = reports.groupBy("id").agg(F.lit(0).alias("attempt"))
    both = reports.unionByName(queued, allowMissingColumns=True).select(*[c.split()[0] for c in attempts.REPORT.split(", ")])
    both.repartitionByRange(3, F.pmod("attempt", F.lit(3))).write.parquet(f"{root}/queue")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/steps/batch={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, attempts.STATES)
    try:
        source = spark.readStream.schema(attempts.REPORT).option("maxFilesPerTrigger", 1).parquet(f"{root}/queue")
        steps = attempts.schedule(source, journal.token_ladder(8192))
        (steps.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{root}/progress")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(provider, before)
    fields = [c.split()[0] for c in attempts.STEP.split(", ")[1:]]
    rows = spark.read.parquet(f"{root}/steps").groupBy("id").agg(F.max_by(F.struct(*fields), "batch").alias("s"))
    return rows.select("id", *[F.col(f"s.{c}").alias(c) for c in fields])


def attempt_history(spark, folder) -> DataFrame:
    """The same steps from the complete table of reports."""
    reports = _reports(spark, folder)
    return attempts.history_steps(reports.select("id"), reports, journal.token_ladder(8192))


def _seeded(spark, folder) -> DataFrame:
    """The middle of each reply is its seed."""
    rows = _contexts(spark, folder).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("parent_id", F.concat_ws(":", "qid", "context"))
    middle = F.floor(F.length("text") / 2).cast("int")
    return rows.withColumn("seed_start", middle).withColumn("seed_end", F.least(middle + 40, F.length("text")))


def prompt_budget(spark, folder) -> DataFrame:
    """Small enough a budget that long replies have to be cut."""
    cfg = Generation(max_input_tokens=640, contexts_k=2, min_context_tokens=64, parent_max_tokens=200)
    packed = prompt.pack_prompts(_seeded(spark, folder), cfg)
    return packed.select("qid", F.size("packed").alias("n_contexts"), "input_tokens", F.sha2(
        F.array_join(F.transform("packed", lambda c: c["text"]), "\n"), 256).alias("texts_sha"))


def prompt_messages(spark, folder) -> DataFrame:
    """The user message of every user turn, all its replies as excerpts."""
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("context", "text")))), lambda s: s["text"])
    prompts = _contexts(spark, folder).groupBy("qid").agg(F.first("question").alias("question"), texts.alias("texts"))
    return prompt.messages(prompts).select("qid", F.size("texts").alias("n_texts"), F.sha2(F.get("messages", F.lit(1))["content"], 256).alias("content_sha"))


def training_examples(spark, folder) -> DataFrame:
    """The first code point of a word stands for its token id."""
    ids = lambda c: F.transform(tx.words(F.col(c)), lambda w: F.ascii(w))
    rows = tables.qa_pairs(spark, folder).select("id", ids("question").alias("prompt_ids"), ids("answer").alias("answer_ids"))
    out = prompt.training_examples(rows, eos=2, limit=400, prompt_limit=200, minimum=100)
    total = lambda c: F.aggregate(F.coalesce(c, F.array().cast("array<int>")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("id", "skipped", F.coalesce(F.size("input_ids"), F.lit(0)).cast("bigint").alias("n_tokens"),
                      total("input_ids").alias("id_sum"), total("labels").alias("label_sum"))


def padded_batches(spark, folder) -> DataFrame:
    """Batches of 16 examples, padded with token 1."""
    ids = lambda c: F.transform(tx.words(F.col(c)), lambda w: F.ascii(w))
    rows = tables.qa_pairs(spark, folder).select("id", ids("question").alias("prompt_ids"), ids("answer").alias("answer_ids"))
    out = prompt.padded_batches(prompt.training_examples(rows, eos=2, limit=4096, prompt_limit=2048, minimum=512), 16, 1)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("id", "batch", "slot", "width", "padding", total("input_ids").alias("id_sum"), total("attention_mask").alias("mask_sum"),
                      total("labels").alias("label_sum"))


QUERIES = {f.__name__: f for f in (
    id_set_diff, leak_check, subset_check, record_stream, snapshot_check, journal_pending, journal_stream, next_attempts, attempt_stream, attempt_history, prompt_budget, prompt_messages, training_examples, padded_batches)}
