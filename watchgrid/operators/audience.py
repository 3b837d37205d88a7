"""Who may be written to: an allowlist of ids and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(allowed: DataFrame) -> DataFrame:
    """Entries as they are compared: without a leading @, in lower case, each once."""
    return allowed.select(F.lower(F.regexp_replace(F.trim("entry"), "^@", "")).alias("key")).where("key <> ''").distinct()


def audience(subscribers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Subscribers (subscriber_id, name) whose id or name is on the list (entry); an empty list lets nobody in."""
    keys = _keys(allowed)
    by_id = subscribers.withColumn("key", F.col("subscriber_id").cast("string")).join(keys, "key", "left_semi")
    by_name = subscribers.withColumn("key", F.lower("name")).join(keys, "key", "left_semi")
    return by_id.union(by_name).drop("key").distinct()


def removed(subscribers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Subscribers who aren't on the list, or no longer."""
    return subscribers.join(audience(subscribers, allowed).select("subscriber_id"), "subscriber_id", "left_anti")
