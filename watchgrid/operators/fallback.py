"""A fallback reads what the rules can't: a function of the user's answers texts, and its answers count only where the lexicon knows the places."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.functions import geo
from watchgrid.functions import text as tx
from watchgrid.operators import places as pl
from watchgrid.operators.inbox import extraction
from watchgrid.session import cut, ship

#: An extractor: the raw answer to each text of a batch, None where there is none. It runs on executors.
Extractor = Callable[[pd.Series], pd.Series]


def disabled(texts: pd.Series) -> pd.Series:
    """The extractor of those who have none."""
    return pd.Series([None] * len(texts), dtype=object)


def extract(messages: DataFrame, extractor: Extractor = disabled) -> DataFrame:
    """(content_hash, raw, targets): the extractor's answer to each distinct text of ``messages`` (text), and its targets if it is valid.

    Null texts aren't asked. The answers are written, so that nothing later asks again; a task that is lost does.
    """
    ship(messages.sparkSession)

    def run(batches):
        for batch in batches:
            raw = list(extractor(batch["text"]))
            if len(raw) != len(batch):
                raise ValueError(f"the extractor answered {len(raw)} of {len(batch)} texts")
            yield pd.DataFrame({"content_hash": batch["content_hash"], "raw": pd.Series(raw, dtype=object)})

    texts = messages.where("text is not null").groupBy(F.sha1("text").alias("content_hash")).agg(F.first("text").alias("text"))
    answers = cut(texts.mapInPandas(run, "content_hash string, raw string"))
    return answers.withColumn("targets", extraction(F.col("raw")))


def ground(answers: DataFrame, lexicon: DataFrame, made: DataFrame) -> DataFrame:
    """One row a target whose destination the lexicon knows: message_id, nth, type, count, oblast, relation, to_name, to_lat, to_lon, to_area,
    from_name, from_lat, from_lon, course_deg, confidence, observed_at.

    ``answers``: message_id, posted_at, targets (as ``inbox.extraction`` gives them; null gives nothing); ``lexicon`` and ``made`` as for
    ``places.place_resolve``. Coordinates never come from an answer: names are looked up in the region that it states, distinct ones once; equal
    answers are grounded once, and only times differ by message. A target without a destination that resolves is dropped, an origin that doesn't is left out. The answer's confidence is multiplied by that of
    the place. A stated time counts within 6 hours of the post.
    """
    t = F.col("t")
    said = answers.where("size(targets) > 0").select("message_id", "posted_at", F.sha1(F.to_json("targets")).alias("said"), "targets")
    rows = said.groupBy("said").agg(F.first("targets").alias("targets")).select("said", F.posexplode("targets").alias("nth", "t"))
    rows = rows.select("said", "nth", t["type"].alias("type"), t["count"].alias("count"), t["relation"].alias("relation"), t["to"].alias("to"), t["from"].alias("from"), t["oblast"].alias("token"), t["time"].alias("time"), t["confidence"].alias("sure"))
    rows = cut(pl.region_match(rows.where(F.col("to") != "")))
    asked = lambda c: F.concat(F.coalesce("region", F.lit("")), F.lit("\x01"), F.col(c))
    names = rows.select(F.col("to").alias("phrase"), "region", asked("to").alias("mention_id")).union(rows.where(F.col("from") != "").select("from", "region", asked("from"))).distinct()
    known = cut(pl.place_resolve(names, lexicon, made))
    side = lambda c: known.select(F.col("mention_id").alias(f"_{c}"), F.struct("kind", "name", "region", "lat", "lon", "confidence").alias(f"at_{c}"))
    found = rows.withColumns({"_to": asked("to"), "_from": F.when(F.col("from") != "", asked("from"))}).join(side("to"), "_to").join(side("from"), "_from", "left")
    to, since = F.col("at_to"), F.col("at_from")
    once = cut(found.select(
        "said", "nth", "type", "count", F.coalesce(to["region"], F.col("region")).alias("oblast"), "relation",
        to["name"].alias("to_name"), to["lat"].alias("to_lat"), to["lon"].alias("to_lon"), (to["kind"] == "oblast").alias("to_area"),
        since["name"].alias("from_name"), since["lat"].alias("from_lat"), since["lon"].alias("from_lon"),
        geo.bearing(since["lat"], since["lon"], to["lat"], to["lon"]).alias("course_deg"), F.round(F.col("sure") * to["confidence"], 6).alias("confidence"), "time",
    ))
    rows = said.drop("targets").join(once, "said")
    return rows.select("message_id", *once.columns[1:-1], tx.observed_at(F.col("time"), F.col("posted_at")).alias("observed_at"))


def recovery(waiting: DataFrame, answers: DataFrame, grounded: DataFrame) -> DataFrame:
    """One row: messages that wait for the fallback, and of how many it gave a report, a valid answer without one, or no usable answer.

    ``waiting``: message_id, content_hash; ``answers``: content_hash, targets, one row a hash; ``grounded``: message_id. Of no messages all are 0.
    """
    rows = waiting.join(answers.select("content_hash", F.col("targets").isNotNull().alias("valid")), "content_hash", "left")
    rows = rows.join(grounded.select("message_id", F.lit(True).alias("got")).distinct(), "message_id", "left")
    got, valid = F.coalesce("got", F.lit(False)), F.coalesce("valid", F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count_if(got).alias("recovered"), F.count_if(~got & valid).alias("empty"), F.count_if(~got & ~valid).alias("no_answer"))
