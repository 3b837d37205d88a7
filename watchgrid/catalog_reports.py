"""Queries of reports read from messages. SQL can't carry what a message's lines hand on; tests/test_reports.py holds the operators."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

from watchgrid.operators import fallback, places, reports
from watchgrid.session import cut
from watchgrid.sources.fixtures import view


def _parsed(spark, sf):
    lexicon = view(spark, sf, "fx_lexicon")
    return reports.parsed_reports(view(spark, sf, "fx_raids"), lexicon, places.place_forms(lexicon))


def q_sites(spark, sf):
    lines = view(spark, sf, "fx_raids").select("message_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("message_id", "line", F.array_join(reports.launch_sites(F.col("text")), "|").alias("sites")).where("sites <> ''")


def q_header_city(spark, sf):
    """Reports over the city of a header line."""
    return _parsed(spark, sf).where("source_line rlike '(?i)над містом'").select("message_id", "line", "type", "to_name", "oblast", "confidence")


def q_coverage(spark, sf):
    """Parsed, unparsed and fallback messages, and reports by type."""
    return reports.coverage(view(spark, sf, "fx_raids"), cut(_parsed(spark, sf)))


def answer(texts: pd.Series) -> pd.Series:
    """A stand-in for a model: it takes the names after "на" for destinations, the one after "з" for the origin, and now and then says nothing
    usable, speaks around its answer or makes a place up. Its answers depend on the text alone."""
    out = []
    for text in texts:
        names = re.findall(r"\bна\s+([А-ЯІЇЄҐ]\w+(?:\s[А-ЯІЇЄҐ]\w+)?)", text)
        since = re.search(r"\bз\s+([А-ЯІЇЄҐ]\w+)", text)
        region = re.match(r"\s*([А-ЯІЇЄҐ]\w+щина)", text)
        targets = [{"type": "uav", "to": name, "from": since[1] if since else "", "oblast": region[1] if region else "", "time": "11:40", "confidence": 0.8} for name in names]
        kind = sum(map(ord, text)) % 10
        if kind == 0:
            out.append(None)
        elif kind == 1:
            out.append("no targets here")
        elif kind == 2:
            out.append(json.dumps({"targets": [*targets, {"type": "uav", "to": "Небувале"}]}))
        else:
            out.append("Here:\n```json\n" + json.dumps({"targets": targets}, ensure_ascii=False) + "\n```")
    return pd.Series(out, dtype=object)


def _answered(spark, sf, messages):
    """Messages with the answers' targets, and the answers."""
    answers = fallback.extract(messages, answer)
    return messages.join(answers.select("content_hash", "targets"), "content_hash"), answers


def _asked(spark, sf):
    at = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("string").alias("message_id"), F.col("ts").cast("timestamp_ntz").alias("posted_at"))
    return view(spark, sf, "fx_raids").withColumn("content_hash", F.sha1("text")).join(at, "message_id")


def q_ground(spark, sf):
    """Every message's answer, by places that the lexicon knows."""
    lexicon = view(spark, sf, "fx_lexicon")
    return fallback.ground(_answered(spark, sf, _asked(spark, sf))[0], lexicon, places.place_forms(lexicon)).withColumn("course_deg", F.round("course_deg", 6))


def q_recovery(spark, sf):
    """What the fallback makes of all messages that need it."""
    lexicon, raids = view(spark, sf, "fx_lexicon"), _asked(spark, sf)
    states = reports.message_states(raids, cut(_parsed(spark, sf).select("message_id", "confidence")))
    waiting = cut(raids.join(states.where("needs_fallback").select("message_id"), "message_id"))
    rows, answers = _answered(spark, sf, waiting)
    return fallback.recovery(waiting, answers, fallback.ground(rows, lexicon, places.place_forms(lexicon)))


def queries() -> dict:
    return {"fallback_ground": q_ground, "fallback_recovery": q_recovery, "origin_destination": _parsed, "launch_sites": q_sites, "header_city": q_header_city, "message_coverage": q_coverage}


def oracle_sql() -> dict:
    marks = """'^[«"(]+|[»".,;:!?)]+$'"""
    site = lambda w: "CASE " + " ".join(f"WHEN {w} IN ({', '.join(repr(f) for f in forms)}) THEN '{name}'" for name, _, _, forms in reports.SITES) + " END"
    from watchgrid.sources.fixtures import with_views

    # in this table only forms of one word occur, and at most two sites a line; brackets count only without others outside of them
    return {
        "launch_sites": with_views(
            f""", l AS (SELECT message_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10)))))::INT AS line FROM fx_raids),
a AS (SELECT message_id, line, CASE k WHEN 0 THEN regexp_replace(t, '\\([^)]*\\)', ' ', 'g') ELSE t END AS t, k FROM l, (VALUES (0), (1)) v(k)),
w AS (SELECT message_id, line, k, unnest(string_split(lower(t), ' ')) AS w0, unnest(range(len(string_split(t, ' ')))) AS i FROM a),
s AS (SELECT message_id, line, k, i, regexp_replace(w0, {marks}, '', 'g') AS w FROM w),
f AS (SELECT message_id, line, k, {site('w')} AS site, min(i) AS i FROM s GROUP BY 1, 2, 3, 4 HAVING site IS NOT NULL),
g AS (SELECT message_id, line, k, string_agg(site, '|' ORDER BY i) AS sites FROM f GROUP BY 1, 2, 3)
SELECT message_id, line, sites FROM g QUALIFY row_number() OVER (PARTITION BY message_id, line ORDER BY k) = 1""",
            "fx_raids",
        ),
    }
