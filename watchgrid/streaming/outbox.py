"""Warnings delivered: an outbox of messages with keys of their own, and a ledger that holds only what some channel took."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchgrid.operators.notices import LedgerRules
from watchgrid.session import ship

#: A channel: whether it took each message of a batch (key, subscriber_id, text). It runs on executors and may see a key twice.
Sink = Callable[[pd.DataFrame], "pd.Series[bool]"]

LEDGER = "subscriber_id long, subject string, said_at timestamp, distance_km double"
LINES = "subscriber_id long, subject string, line_id long, at timestamp, distance_km double, line string, verdict string"
DELIVERED = "key string, subscriber_id long, n_lines int, channels array<string>"


def _send(sinks: dict[str, Sink]) -> Callable:
    def run(batches):
        for batch in batches:
            took = {}
            for name, sink in sinks.items():
                try:
                    took[name] = [bool(x) for x in sink(batch[["key", "subscriber_id", "text"]])]
                except Exception:  # a channel that fails took nothing; the others still count
                    took[name] = [False] * len(batch)
                if len(took[name]) != len(batch):
                    raise ValueError(f"{name} answered for {len(took[name])} of {len(batch)} messages")
            channels = [[name for name in sinks if took[name][k]] for k in range(len(batch))]
            yield pd.DataFrame({"key": batch["key"], "subscriber_id": batch["subscriber_id"], "n_lines": batch["n_lines"], "channels": channels})

    return run


def already_said(at: Column, km: Column, said_at: Column, said_km: Column, rules: LedgerRules = LedgerRules()) -> Column:
    """Whether a line at ``at`` would repeat what was said at ``said_at`` (null: nothing was)."""
    since = F.unix_micros(at) - F.unix_micros(said_at)
    moved = F.when(said_km <= 0, km > 0).otherwise(F.abs(km - said_km) / said_km >= rules.material_change)
    said = (since < int(rules.cooldown_min * 6e7)) | ((since < int(rules.repeat_min * 6e7)) & ~F.coalesce(moved, F.lit(False)))
    return F.coalesce(said, F.lit(False))


def deliver(lines: DataFrame, sinks: dict[str, Sink], store: str, number: int, rules: LedgerRules = LedgerRules()) -> None:
    """One pass: what isn't said already goes out, a message a reader, nearest line first; what any channel took goes into the ledger.

    ``lines``: subscriber_id, subject, line_id, at, distance_km, line. The pass happens at the newest ``at`` of its lines, each line is held
    against the ledger as it was before the pass, so lines of one subject go out together; the one farthest away is what the ledger then
    says. A message that no channel took leaves no trace in the ledger, so the next line of its subject goes out. Repeated line ids are
    lines of their own. A pass without lines writes nothing but an empty verdict.

    A message's key is made of the pass and its reader. If a pass runs again, it reads the ledger before its own and takes
    what was delivered from the outbox, if that was complete; a task lost midway calls its channels again with the same keys, by which a
    channel can tell. The ledger keeps what is younger than the repeat time, so it doesn't grow with history.
    """
    spark = lines.sparkSession
    ship(spark)
    before = ledger(spark, store, number)
    rows = lines.select(*[x.split()[0] for x in LINES.split(", ")[:-1]]).withColumn("at", F.col("at").cast("timestamp"))
    rows = rows.persist()
    try:
        now = rows.agg(F.max("at")).first()[0]
        if now is None:
            spark.createDataFrame([], LINES).write.mode("overwrite").parquet(f"{store}/verdicts/batch={number}")
            return
        held = rows.join(before.withColumnRenamed("distance_km", "said_km"), ["subscriber_id", "subject"], "left")
        held = held.withColumn("said", already_said(F.lit(now), F.col("distance_km"), F.col("said_at"), F.col("said_km"), rules)).drop("said_at", "said_km")
        waiting = held.where(~F.col("said"))
        messages = waiting.groupBy("subscriber_id").agg(F.array_sort(F.collect_list(F.struct("distance_km", "line_id", "line"))).alias("x"))
        key = F.sha1(F.concat_ws("|", F.lit(str(number)), F.col("subscriber_id").cast("string")))
        messages = messages.select(key.alias("key"), "subscriber_id", F.array_join("x.line", "\n").alias("text"), F.size("x").alias("n_lines"))
        at = f"{store}/sent/batch={number}"
        if not _complete(spark, at):
            messages.mapInPandas(_send(sinks), DELIVERED).write.mode("overwrite").parquet(at)
        took = spark.read.schema(DELIVERED).parquet(at).where(F.size("channels") > 0).select("subscriber_id", F.lit(True).alias("took"))
        verdict = F.when(F.col("said"), "suppressed").when(F.col("took"), "sent").otherwise("failed")
        told = held.join(took, "subscriber_id", "left").withColumn("verdict", verdict)
        told.select(*[x.split()[0] for x in LINES.split(", ")]).write.mode("overwrite").parquet(f"{store}/verdicts/batch={number}")
    finally:
        rows.unpersist()
    sent = spark.read.schema(LINES).parquet(f"{store}/verdicts/batch={number}").where("verdict = 'sent'")
    last = sent.groupBy("subscriber_id", "subject").agg(F.max(F.struct("distance_km", "line_id"))["distance_km"].alias("distance_km"))
    last = last.select("subscriber_id", "subject", F.lit(now).alias("said_at"), "distance_km")
    young = before.where(F.unix_micros("said_at") > F.unix_micros(F.lit(now)) - int(rules.repeat_min * 6e7))
    kept = young.join(last, ["subscriber_id", "subject"], "left_anti").select(*last.columns)
    kept.unionByName(last).write.mode("overwrite").parquet(f"{store}/ledger/batch={number}")


def _folder(spark, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _complete(spark, at: str) -> bool:
    files, path = _folder(spark, f"{at}/_SUCCESS")
    return files.exists(path)


def ledger(spark, store: str, before: int | None = None) -> DataFrame:
    """What readers were told lately: the newest complete ledger (of a pass before ``before``), empty if there is none."""
    files, path = _folder(spark, f"{store}/ledger")
    names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
    passes = sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch=") and _complete(spark, f"{store}/ledger/{n}"))
    passes = [n for n in passes if before is None or n < before]
    return spark.read.schema(LEDGER).parquet(f"{store}/ledger/batch={passes[-1]}") if passes else spark.createDataFrame([], LEDGER)


def verdicts(spark, store: str) -> DataFrame:
    """All lines of all passes with their verdict: suppressed, sent or failed; ``batch`` is the pass."""
    return spark.read.schema(LINES + ", batch long").parquet(f"{store}/verdicts")


def passes(spark, store: str) -> DataFrame:
    """(batch, scanned, sent, recipients): lines looked at, lines that some channel took, readers that a message was made for."""
    waiting = F.col("verdict") != "suppressed"
    return verdicts(spark, store).groupBy("batch").agg(F.count("*").alias("scanned"), F.count_if(F.col("verdict") == "sent").alias("sent"), F.count_distinct(F.when(waiting, F.col("subscriber_id"))).alias("recipients"))


def notify(lines: DataFrame, sinks: dict[str, Sink], store: str, checkpoint: str, rules: LedgerRules = LedgerRules()) -> StreamingQuery:
    """Deliver a stream of lines; each batch is a pass, see ``deliver``."""
    step = lambda batch, n: deliver(batch, sinks, store, n, rules)
    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
