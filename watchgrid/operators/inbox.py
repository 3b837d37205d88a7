"""Messages between capture and map: versions, fallback answers, context carried from line to line, and what is missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a fallback's answer may hold.
TYPES = ("uav", "jet_uav", "cruise", "ballistic", "kab", "aviation", "recon", "unknown")
RELATIONS = ("towards", "past", "through", "over", "from")
ANSWER = "targets array<struct<type:string,count:double,from:string,to:string,relation:string,oblast:string,time:string,confidence:double>>"
# Fixed value: a word that names an object.
TARGET = "(?iu)бпла|шахед|герань|каб|ракет|реактивн|балістик|авіаці"


def reports_replace(reports: DataFrame) -> DataFrame:
    """Of each message the reports of its newest version only, numbered from 0 in their order.

    ``reports``: message_id, version, line, and more. Versions are combined before the shuffle; a message's reports are few.
    """
    newest = reports.groupBy("message_id").agg(F.max("version").alias("version"))
    kept = reports.join(newest, ["message_id", "version"])
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("message_id").orderBy("line")) - 1)


def fallback_cache(rules: DataFrame, answers: DataFrame) -> DataFrame:
    """(message_id, source, n): the cached answer of a message's text, taken only if it has more rows than the rules gave.

    ``rules``: message_id, content_hash, n; ``answers``: content_hash, n (one row a hash).
    """
    a = answers.select("content_hash", F.col("n").alias("n_cached"))
    better = F.coalesce(F.col("n_cached") > F.col("n"), F.lit(False))
    return rules.join(a, "content_hash", "left").select("message_id", F.when(better, "fallback").otherwise("rules").alias("source"), F.when(better, F.col("n_cached")).otherwise(F.col("n")).alias("n"))


def fallback_budget(waiting: DataFrame, answers: DataFrame, calls: int) -> DataFrame:
    """(batch, message_id): the first ``calls`` messages of each batch that were never called for and have no cached answer.

    A batch's own messages are numbered together; it is bounded by what a parser takes at once.
    """
    fresh = waiting.where("called_at is null").join(answers.select("content_hash"), "content_hash", "left_anti")
    return fresh.withColumn("k", F.row_number().over(Window.partitionBy("batch").orderBy("posted_at", "message_id"))).where(F.col("k") <= calls).select("batch", "message_id")


def cache_time(shift: Column, posted_at: Column) -> Column:
    """The time of a cached report for another post of the same text: as far from the post as it was then."""
    return posted_at + shift


def extraction(raw: Column) -> Column:
    """The targets of a fallback's answer, with defaults; null where it isn't valid: no object, an unknown type or relation, a count
    outside 1 to 200, a confidence outside 0 to 1."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.regexp_extract(F.when(raw.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced).otherwise(raw), r"(?s)\{.*\}", 0)
    rows = F.from_json(text, ANSWER)["targets"]

    def valid(t):
        count, sure = F.coalesce(t["count"], F.lit(1.0)), F.coalesce(t["confidence"], F.lit(0.5))
        return t["type"].isin(*TYPES) & F.coalesce(t["relation"], F.lit("towards")).isin(*RELATIONS) & count.between(1, 200) & (count == F.floor(count)) & sure.between(0, 1)

    def whole(t):
        text_of = lambda k, d: F.coalesce(t[k], F.lit(d)).alias(k)
        return F.struct(t["type"].alias("type"), F.coalesce(t["count"], F.lit(1.0)).cast("int").alias("count"), text_of("from", ""), text_of("to", ""), text_of("relation", "towards"), text_of("oblast", ""), text_of("time", ""), F.coalesce(t["confidence"], F.lit(0.5)).alias("confidence"))

    ok = rows.isNotNull() & F.forall(rows, lambda t: F.coalesce(valid(t), F.lit(False)))
    return F.when(ok, F.transform(rows, whole))


def sticky_context(lines: DataFrame, *columns: str) -> DataFrame:
    """``lines`` with each column as the last line of the message that had it says, up to and with the line itself."""
    by = Window.partitionBy("message_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({c: F.last(c, ignorenulls=True).over(by) for c in columns})


def miss_reasons(lines: DataFrame, most: int = 4) -> DataFrame:
    """(reason, n, samples): why lines that name an object gave nothing; the first ``most`` lines of each as samples.

    ``lines``: message_id, line, text, type, has_cue, n_names, n_resolved. The samples are a report's feature, no limit on what is counted.
    """
    reason = (
        F.when(F.col("type") == "unknown", "type not recognised")
        .when(~F.col("has_cue"), "no relation cue")
        .when(F.col("n_names") == 0, "cue but no capitalised name")
        .when(F.col("n_resolved") == 0, "no name resolves")
        .otherwise("other")
    )
    rows = lines.where(F.col("text").rlike(TARGET)).withColumn("reason", reason)
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("reason", F.pmod(F.xxhash64("message_id"), F.lit(64))).orderBy("message_id", "line"))).where(F.col("k") <= most)
    some = first.groupBy("reason").agg(F.slice(F.array_sort(F.collect_list(F.struct("message_id", "line", F.substring("text", 1, 78).alias("t")))), 1, most).alias("s"))
    return rows.groupBy("reason").agg(F.count("*").alias("n")).join(some, "reason").select("reason", "n", F.transform("s", lambda x: x["t"]).alias("samples"))


def channel_state(polls: DataFrame) -> DataFrame:
    """(channel, last_id, oldest_id, last_success, failures, last_error): 0 where never seen; failures since the last success; an error is
    cut to 300 characters and gone after a success.

    ``polls``: channel, at, min_id, max_id, error (null is a success).
    """
    ok = F.col("error").isNull()
    done = polls.groupBy("channel").agg(
        F.coalesce(F.max(F.when(ok, F.col("max_id"))), F.lit(0)).alias("last_id"),
        F.coalesce(F.min(F.when(ok, F.col("min_id"))), F.lit(0)).alias("oldest_id"),
        F.max(F.when(ok, F.col("at"))).alias("last_success"),
    )
    late = polls.where(~ok).join(done.select("channel", "last_success"), "channel").where("last_success is null or at > last_success")
    bad = late.groupBy("channel").agg(F.count("*").alias("failures"), F.max_by(F.substring("error", 1, 300), "at").alias("last_error"))
    return done.join(bad, "channel", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))


def health_summary(sources: DataFrame) -> DataFrame:
    """One row: level ok, warn or bad, and how many fail; of no sources nothing is known, which is a warning."""
    n, bad = F.count("*"), F.coalesce(F.sum((~F.col("healthy")).cast("long")), F.lit(0))
    level = F.when(F.col("n") == 0, "warn").when(F.col("n_bad") == 0, "ok").when(F.col("n_bad") == F.col("n"), "bad").otherwise("warn")
    return sources.agg(n.alias("n"), bad.alias("n_bad")).select(level.alias("level"), "n_bad", "n")


def resume(consumers: DataFrame, log: DataFrame) -> DataFrame:
    """(consumer, how, from_seq): replay after the consumer's seq where all that follows is still held, else a snapshot, then what is newer."""
    ends = log.agg(F.min("seq").alias("oldest"), F.coalesce(F.max("seq"), F.lit(0)).alias("head"))
    rows = consumers.crossJoin(F.broadcast(ends))  # one row
    can = F.col("seq").isNotNull() & (F.col("seq") <= F.col("head")) & (F.col("oldest").isNull() | (F.col("seq") >= F.col("oldest") - 1))
    return rows.select("consumer", F.when(can, "replay").otherwise("snapshot").alias("how"), F.when(can, F.col("seq")).otherwise(F.col("head")).alias("from_seq"))


def append_log(changes: DataFrame, last_seq: int) -> DataFrame:
    """``changes`` with the next numbers after ``last_seq`` in the order of ``at`` and ``change_id``.

    Changes are counted by blocks of time first, so that only the blocks' counts meet in one window.
    """
    block = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / 6e7).cast("long")
    rows = changes.withColumn("_block", block)
    counts = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    # minutes of a batch: bounded by its length, not by its rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_block").orderBy("at", "change_id"))
    return rows.join(before, "_block").withColumn("seq", F.lit(last_seq) + F.col("_before") + nth).drop("_block", "_n", "_before")
