"""Exact duplicates by a stateful stream: one entry per content, kept on disk without expiry.

Arrivals (digest, length, id, locator) stream into a keyed aggregation whose state lives in
RocksDB: per digest the number of rows and the best row so far. There is no watermark, so an
entry never expires. Partial aggregation runs before the shuffle, so a content with any number
of copies reaches its state as one row per task. The state is read back as a table. Every
document that hits an entry of another row is then compared with that row byte by byte.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import SPACE, is_scan, new_folder, remove, saved, table, text_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalized(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def arrivals(docs: DataFrame) -> DataFrame:
    """(digest, n_chars, doc_id, locator): what the stream takes in for each row."""
    text = text_of()
    return docs.select(
        F.sha2(normalized(text).cast("binary"), 256).alias("digest"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.col("doc_id").cast("long").alias("doc_id"), _locator(docs).alias("locator"),
    )


def _locator(docs: DataFrame) -> Column:
    """Where a row's content lies: file and row number, or a running number without files."""
    if is_scan(docs):
        return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rank(n_chars: str, doc_id: str, locator: str) -> Column:
    """Larger is better: the longest original, then the least id (null last), then the place."""
    return F.struct(
        (-F.col(n_chars)).alias("n"), F.col(doc_id).isNull().alias("no_id"),
        F.col(doc_id).alias("doc_id"), F.col(locator).alias("locator"),
    )


def stream_into_state(spark: SparkSession, landing: str, schema, state: str,
                      max_bytes_per_batch: int = 1 << 40) -> None:
    """Take every file in ``landing`` that the state at ``state`` has not seen yet into it.

    Calling it again after new files have landed carries on from the kept state.
    """
    incoming = (
        spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_batch).parquet(landing)
    )
    best = incoming.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(_rank("n_chars", "doc_id", "locator")).alias("best")
    )
    with _settings(spark, {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        # A finished run leaves no open store, with its 4 MB of reserved disk, per partition.
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        # An executor keeps this much outside its heap; a store's share of a batch is far less.
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    }):
        query = (
            best.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """(digest, group_size, best): the entries of the state."""
    rows = spark.read.format("statestore").load(state)
    size, best = rows.schema["value"].dataType.names
    return rows.select(
        F.col("key.digest").alias("digest"), F.col("value")[size].alias("group_size"),
        F.col("value")[best].alias("best"),
    )


def different_bytes(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``members`` whose bytes differ from those of the row their digest stands for.

    ``members`` holds the rows of groups of two or more. Their texts are joined by locator;
    then each is held against the text of the best row. Only the copies are a hot key here,
    on the side that the optimizer can split, against one row per digest.
    """
    text = docs.select(_locator(docs).alias("locator"), normalized(text_of()).alias("content"))
    full = saved(members.join(text, "locator"), "dedup-hits")
    best = full.where(F.col("locator") == F.col("best.locator")).select(
        "digest", F.col("content").alias("best_content")
    )
    return full.where(F.col("locator") != F.col("best.locator")).join(best, "digest").where(
        F.col("content") != F.col("best_content")
    ).select("locator", "content")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which row of its group stays.

    Texts are equal if they are once ASCII white space is deleted; null counts as the empty
    text, and all empty texts are equal. The row with the most code points stays, then the
    one with the least doc_id, then (for repeated ids) the first by place, so exactly one row
    of a group has ``kept``. A null doc_id loses every tie. Other columns are ignored; an
    empty table gives no row.

    Two texts with one digest but different bytes are set apart: their group is keyed by the
    content itself.
    """
    spark = docs.sparkSession
    if not is_scan(docs):  # rows need a place that stays the same when they are read again
        docs = saved(docs.select("doc_id", "text"), "dedup-docs")
        if not docs.inputFiles():
            return _result(docs.select(
                F.lit("").alias("digest"), F.lit(0).cast("long").alias("group_size"), "doc_id",
                F.lit(0).alias("locator"), F.struct(F.col("doc_id"), F.lit(0).alias("locator")).alias("best"),
            ))
    landing, state = new_folder(spark, "dedup-arrivals"), new_folder(spark, "dedup-state")
    rows = arrivals(docs)
    rows.write.mode("append").option("compression", "zstd").parquet(landing)
    stream_into_state(spark, landing, rows.schema, state)
    members = spark.read.schema(rows.schema).parquet(landing).join(read_state(spark, state), "digest")
    members = saved(members.select("digest", "group_size", "n_chars", "doc_id", "locator", "best"), "dedup-members")
    remove(spark, state)
    strangers = different_bytes(docs, members.where("group_size > 1"))
    if strangers.isEmpty():
        return _result(members)
    # Equal digests of different contents: number the contents apart and choose again.
    apart = saved(members.join(strangers, "locator", "left"), "dedup-apart")
    again = apart.groupBy("digest", "content").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(_rank("n_chars", "doc_id", "locator")).alias("best")
    )
    return _result(apart.drop("group_size", "best").alias("a").join(
        again.alias("g"),
        (F.col("a.digest") == F.col("g.digest")) & F.col("a.content").eqNullSafe(F.col("g.content")),
    ).select("a.digest", "group_size", "doc_id", "locator", "best"))


def _result(members: DataFrame) -> DataFrame:
    return members.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("locator") == F.col("best.locator")).alias("kept"), F.col("digest").alias("text_sha256"),
        "locator",
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("locator")


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
