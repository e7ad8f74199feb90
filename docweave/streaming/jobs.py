"""Structured Streaming jobs.

* ``answer_stream``: question bodies ``{"query": ...}`` arriving as JSON
  files -> contexts and completion prompts (and answers when a
  ``complete_fn`` is given) per micro-batch, against a chunk table that is
  indexed once, when the stream starts; a batch reads the clusters of vectors
  that its questions need and the texts kept.
* ``page_version_stream``: captured pages arriving as parquet -> a store of
  page texts, keyed by (netloc, page_key), in which the newest version of
  each page stays (the largest page_id, as in the batch ``dedup_pages``),
  whatever the order in which versions arrive.
* ``page_text_stream``: the same texts appended to a plain file sink, where
  nothing can be replaced: the first page seen for a (netloc, page_key) wins.
* ``section_index_stream``: documents arriving as parquet -> sections
  upserted into the index table per micro-batch.

Every job needs a checkpoint location on shared storage; restarts
resume from it (exactly-once for the file sinks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import schemas
from ..operators import prompts as PR
from ..operators import retrieval as R
from ..operators import sections as SE
from ..operators import web as W
from ..sinks import index_store
from ..sinks.bucket_store import BUCKETS, BucketStore


def answer_batch(questions: DataFrame, chunks: DataFrame, embedder=None, complete_fn=None,
                 **context_kw) -> DataFrame:
    """One micro-batch: (question_id, question) -> prompt and answer;
    ``answer_error`` tells a failed call from an empty reply."""
    q = R.embed(questions, "question", "q_embedding", embedder)
    ctx = R.build_context(chunks, q.select("question_id", "q_embedding"), **context_kw)
    p = PR.completion_prompt(ctx.join(questions, "question_id"))
    return PR.answer(p, complete_fn).select("question_id", "question", "context", "prompt", "answer", "answer_error")


def answer_stream(spark: SparkSession, source_dir: str, chunks: DataFrame, sink_path: str,
                  checkpoint: str, embedder=None, complete_fn=None, trigger_once: bool = False):
    body = spark.readStream.schema(schemas.QUESTION_BODY).json(source_dir)
    qs = body.select(F.col("query").alias("question")).filter(F.col("question").isNotNull())
    index = R.chunk_index(chunks)

    def run(batch: DataFrame, batch_id: int) -> None:
        # unique ids per question row (equal questions stay separate);
        # persisted so every action of this batch sees the same ids
        b = batch.select(F.concat_ws("-", F.lit(batch_id).cast("string"), F.monotonically_increasing_id().cast("string"))
                         .alias("question_id"), "question").persist()
        try:
            out = answer_batch(b, chunks, embedder, complete_fn, index=index)
            # one folder per micro-batch, overwritten on replay: a batch
            # re-run after a failure replaces its own output (exactly once)
            out.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")
        finally:
            b.unpersist()

    w = qs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def page_text_stream(spark: SparkSession, source_dir: str, sink_path: str, checkpoint: str,
                     trigger_once: bool = False, event_time: str | None = None,
                     watermark: str = "1 day", schema=schemas.PAGE):
    """Without ``event_time`` every (netloc, page_key) ever seen is kept in
    the state store (use the RocksDB state store for large sites); with
    an event-time column, duplicates are dropped within ``watermark``
    and older state is evicted."""
    pages = spark.readStream.schema(schema).parquet(source_dir)
    texts = W.page_texts(pages, keep=(event_time,) if event_time else ()).filter(F.col("saved"))
    if event_time:
        texts = texts.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["netloc", "page_key"])
    else:
        texts = texts.dropDuplicates(["netloc", "page_key"])
    w = (texts.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


TEXT_FIELDS = T.StructType([
    T.StructField("netloc", T.StringType()), T.StructField("page_key", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_text_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(spark, path, TEXT_FIELDS, ["netloc", "page_key"], buckets)


class NewestVersion(StatefulProcessor):
    """Passes a page on if it is newer than all seen for its key. The state of
    a key is one number. With ``forget_ms`` a processing-time timer clears a
    key that had no newer page for so long; an older version that comes later
    still is then taken for new."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("page_id", T.LongType()), T.StructField("timer", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        newest, timer = self.newest.get() or (None, None)
        best = None
        for part in rows:
            row = part.loc[[part["page_id"].idxmax()]]
            if best is None or row["page_id"].iloc[0] > best["page_id"].iloc[0]:
                best = row
        page_id = int(best["page_id"].iloc[0])
        if newest is None or page_id > newest:
            if self.forget_ms:
                if timer:
                    self.handle.deleteTimer(timer)
                timer = timerValues.getCurrentProcessingTimeInMs() + self.forget_ms
                self.handle.registerTimer(timer)
            self.newest.update((page_id, timer or 0))
            yield best

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def page_version_stream(spark: SparkSession, source_dir: str, store_path: str, checkpoint: str, trigger_once: bool = False,
                        forget_ms: int | None = None, buckets: int = BUCKETS, schema=schemas.PAGE):
    """Pages without an output file (page_key '') and rows without a page_id
    are left out. A key's state is one number in the RocksDB state store; the
    texts pass through. Each micro-batch replaces the versions that it brings
    in the store; one that is run again after a failure replaces them by the
    same rows. A stream with timers (``forget_ms``) has no last batch, so it is
    not for ``trigger_once``."""
    if trigger_once and forget_ms:
        raise ValueError("a stream with timers does not end by itself")
    pages = spark.readStream.schema(schema).parquet(source_dir).filter(F.col("page_id").isNotNull())
    texts = W.page_texts(pages).filter(F.col("saved")).select(*TEXT_FIELDS.names)
    newest = texts.groupBy("netloc", "page_key").transformWithStateInPandas(
        statefulProcessor=NewestVersion(forget_ms), outputStructType=TEXT_FIELDS, outputMode="Update",
        timeMode="ProcessingTime" if forget_ms else "None")

    def run(batch: DataFrame, batch_id: int) -> None:
        page_text_store(batch.sparkSession, store_path, buckets).change(batch)

    w = newest.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    # a query keeps the settings that it starts with; the session's own stay as they are
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        return w.start()
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def section_index_stream(spark: SparkSession, source_dir: str, index_path: str, checkpoint: str,
                         doc_schema: str = "sourcefile string, text string, category string",
                         trigger_once: bool = False, buckets: int | None = index_store.BUCKETS):
    """The index table is bucketed by a hash of the file name (``buckets``
    folders); None makes a folder for each source file."""
    docs = spark.readStream.schema(doc_schema).parquet(source_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        secs = SE.sections(batch, category="category" if "category" in batch.columns else None)
        index_store.upsert_into(spark, index_path, secs, buckets=buckets)

    w = docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
