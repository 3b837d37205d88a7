"""Captured messages as a stream: duplicates are the normal case, edits replace, and the store holds the newest text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["channel", "message_id"]


def newest(captures: DataFrame) -> DataFrame:
    """Per message the newest capture (ties: the larger hash): channel, message_id, captured_at, text, content_hash."""
    rows = captures.withColumn("content_hash", F.sha1("text"))
    last = F.max_by(F.struct("captured_at", "text", "content_hash"), F.struct("captured_at", "content_hash"))
    return rows.groupBy(*KEY).agg(last.alias("x")).select(*KEY, "x.captured_at", "x.text", "x.content_hash")


def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The store after a batch: rows new or of another hash and not older than what is stored wait for the parser, others stay as they are.

    ``stored``: channel, message_id, captured_at, text, content_hash, edited_at, parse_state, parsed_at.
    """
    old = stored.select(*KEY, *[F.col(c).alias(f"o_{c}") for c in stored.columns if c not in KEY])
    rows = old.join(newest(batch), KEY, "full")
    fresh = F.col("content_hash").isNotNull() & (F.col("o_content_hash").isNull() | ((F.col("content_hash") != F.col("o_content_hash")) & (F.col("captured_at") >= F.col("o_captured_at"))))
    edited = fresh & F.col("o_content_hash").isNotNull()
    pick = lambda c: F.when(fresh, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c)
    return rows.select(
        *KEY,
        pick("captured_at"),
        pick("text"),
        pick("content_hash"),
        F.when(edited, F.col("captured_at")).otherwise(F.col("o_edited_at")).alias("edited_at"),
        F.when(fresh, "pending").otherwise(F.col("o_parse_state")).alias("parse_state"),
        F.when(~fresh, F.col("o_parsed_at")).alias("parsed_at"),
    )


STORE = "channel string, message_id long, captured_at timestamp, text string, content_hash string, edited_at timestamp, parse_state string, parsed_at timestamp"


#: Into how many buckets a store divides its messages; a bucket is what a batch rewrites, and one task.
BUCKETS = 256


def ingest(captures: DataFrame, store: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge a stream of captures (channel, message_id, captured_at, text) into the table under ``store``; see ``write``."""
    return captures.writeStream.foreachBatch(lambda batch, n: write(batch, store, n, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def write(batch: DataFrame, store: str, number: int, buckets: int = BUCKETS) -> None:
    """One batch: the buckets in which something is new or edited are written anew, the log then says which batch holds which bucket.

    Repeated captures, the normal case, write nothing. The batch reads the newest log before its own, so if it runs again, it reads and
    writes the same; what it wrote counts once its log is complete. The driver holds a row a bucket. A store keeps its number of buckets.
    """
    spark = batch.sparkSession
    held = _log(spark, store, number)
    if any(of != buckets for _, _, of in held):
        raise ValueError(f"the store has {held[0][2]} buckets")
    rows = newest(batch).withColumn("bucket", _bucket(buckets)).persist()
    try:
        met = {x.bucket for x in rows.select("bucket").distinct().collect()}
        old = _read(spark, store, [x for x in held if x[0] in met]).select(*KEY, F.col("captured_at").alias("o_at"), F.col("content_hash").alias("o_hash"))
        fresh = "o_hash is null or (content_hash <> o_hash and captured_at >= o_at)"
        changed = {x.bucket for x in rows.join(old, KEY, "left").where(fresh).select("bucket").distinct().collect()}
        if not changed:
            return
        stored = _read(spark, store, [x for x in held if x[0] in changed])
        mine = rows.where(F.col("bucket").isin(*changed)).select(*KEY, "captured_at", "text")
        merged = merge(stored, mine).withColumn("bucket", _bucket(buckets)).repartition("bucket")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/data/batch={number}")
    finally:
        rows.unpersist()
    now = [x for x in held if x[0] not in changed] + [(b, number, buckets) for b in sorted(changed)]
    spark.createDataFrame(now, "bucket int, batch long, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{store}/log/batch={number}")


def _batches(spark, folder: str, complete: bool = True) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(path(folder))] if files.exists(path(folder)) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch=") and (not complete or files.exists(path(f"{folder}/{n}/_SUCCESS"))))


def _log(spark, store: str, before: int | None = None) -> list[tuple[int, int, int]]:
    """(bucket, batch, buckets) of the newest complete log, older than ``before``."""
    found = [n for n in _batches(spark, f"{store}/log") if before is None or n < before]
    return [tuple(x) for x in spark.read.parquet(f"{store}/log/batch={found[-1]}").collect()] if found else []


def _read(spark, store: str, held: list[tuple[int, int, int]]) -> DataFrame:
    paths = [f"{store}/data/batch={n}/bucket={b}" for b, n, _ in held]
    return spark.read.schema(STORE).parquet(*paths) if paths else spark.createDataFrame([], STORE)


def version(spark, store: str, before: int | None = None) -> DataFrame:
    """The store after its newest batch (older than ``before``), empty if there is none."""
    return _read(spark, store, _log(spark, store, before))


def compact(spark, store: str, keep: int = 2) -> int:
    """Delete what none of the newest ``keep`` logs refers to, and older logs: the number of buckets deleted. Run it between batches."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    logs = _batches(spark, f"{store}/log")
    if not logs:
        return 0
    used = {(n, b) for log in logs[-keep:] for b, n, _ in _log(spark, store, log + 1)}
    for n in logs[:-keep]:
        files.delete(path(f"{store}/log/batch={n}"), True)
    gone = 0
    for n in [n for n in _batches(spark, f"{store}/data", complete=False) if n <= logs[-1]]:
        names = [x.getPath().getName() for x in files.listStatus(path(f"{store}/data/batch={n}"))]
        dead = [x for x in names if x.startswith("bucket=") and (n, int(x.partition("=")[2])) not in used]
        gone += len(dead)
        for x in dead:
            files.delete(path(f"{store}/data/batch={n}/{x}"), True)
    return gone
