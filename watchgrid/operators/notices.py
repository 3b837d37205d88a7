"""Warnings as text, and the ledger that keeps them from repeating themselves. All in built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a type is called, and the note below a notification.
LABELS = {"uav": "БпЛА", "jet_uav": "Реактивний БпЛА", "cruise": "Крилата ракета", "ballistic": "Балістика", "kab": "КАБ", "aviation": "Авіація", "recon": "Розвідник"}
OTHER = "Ціль"
DISCLAIMER = "Дані з відкритих джерел, не є офіційним попередженням."


@dataclass(frozen=True)
class LedgerRules:
    cooldown_min: float = 5.0
    repeat_min: float = 20.0
    material_change: float = 0.25


def subject_key(kind: Column, place: Column, reason: Column) -> Column:
    """What a warning is about."""
    return F.concat_ws("|", kind, F.coalesce(place, F.lit("")), reason)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("string")


def lines(warnings: DataFrame) -> DataFrame:
    """``warnings`` (type, n, place, reason, distance_km, eta_min, closest_km) with ``line``. The distance stands beside the place
    that it belongs to; times are given only where they are known."""
    label = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in LABELS.items()], F.lit(OTHER))
    count = F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise("")
    km = F.concat(F.lit("~"), _whole(F.col("distance_km")), F.lit(" км від вас"))
    name = escape_html(F.col("place"))
    at = F.concat(name, F.lit(" ("), km, F.lit(")"))
    coming = F.col("reason") == "approaching"
    where = F.when(name.isNull(), km).when(F.col("reason").isin("in_radius", "approaching"), at).otherwise(F.concat(F.lit("курс на "), at))
    passes = F.when(~coming | F.col("closest_km").isNull(), "").when(F.col("closest_km") < 2, " · курс прямо на вас").otherwise(F.concat(F.lit(" · пройде за ~"), _whole(F.col("closest_km")), F.lit(" км")))
    minutes = _whole(F.col("eta_min"))
    when = (
        F.when(F.col("eta_min").isNull(), "")
        .when(F.col("eta_min") < 1, " · вже поруч")
        .when(coming, F.concat(F.lit(" · ~"), minutes, F.lit(" хв (орієнтовно)")))
        .otherwise(F.concat(F.lit(" · до вас ~"), minutes, F.lit(" хв")))
    )
    return warnings.withColumn("line", F.concat(F.lit("⚠️ "), label, count, F.lit(" — "), where, passes, when))


def title(first: Column, n_lines: Column) -> Column:
    """A notification's headline: the first line up to its dash, at most 60 characters, and how many lines follow."""
    cut = F.instr(first, " — ")
    head = F.when(cut > 1, F.substr(first, F.lit(1), cut - 1)).otherwise(first)
    short = F.when(F.length(head) > 60, F.concat(F.substr(head, F.lit(1), F.lit(59)), F.lit("…"))).otherwise(head)
    return F.concat(short, F.when(n_lines > 1, F.concat(F.lit(" +"), (n_lines - 1).cast("string"))).otherwise(""))


def body(text: Column) -> Column:
    """The rest of a message's lines and the disclaimer, at most 500 characters."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.get(rows, F.lit(0)), F.lit(""))
    cut = F.instr(first, " — ")
    details = F.concat(F.array(F.when(cut > 1, F.substr(first, cut + 3)).otherwise("")), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))))
    whole = F.array_join(F.concat(F.filter(details, lambda x: x != ""), F.array(F.lit(DISCLAIMER))), "\n")
    return F.when(F.length(whole) > 500, F.concat(F.substr(whole, F.lit(1), F.lit(499)), F.lit("…"))).otherwise(whole)


def ledger(rows: DataFrame, rules: LedgerRules = LedgerRules()) -> DataFrame:
    """``rows`` (subscriber_id, subject, line_id, at, distance_km) with ``verdict``: sent, or suppressed.

    Within the cooldown of the last one sent a line is suppressed; after the repeat time it is sent; between, it is sent if
    its distance moved by the material share (of a distance of 0: if it isn't 0). Lines go by (at, line_id). A pause of the repeat time
    always releases the next line, so what stands between two pauses is folded on its own. The fold keeps the places of the lines
    sent, which are a cooldown apart, so its answer grows with a run's time, not with its lines.
    """
    by = Window.partitionBy("subscriber_id", "subject").orderBy("at", "line_id")
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    fresh = F.coalesce((micros - F.lag(micros).over(by) >= int(rules.repeat_min * 6e7)).cast("int"), F.lit(1))
    run = rows.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(by))
    item = F.struct(micros.alias("at"), "line_id", "distance_km")
    runs = run.groupBy("subscriber_id", "subject", "_run").agg(F.array_sort(F.collect_list(item)).alias("x"))
    runs = runs.withColumn("x", F.transform("x", lambda x, i: x.withField("i", i)))
    start = F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("double").alias("km"), F.array().cast("array<int>").alias("sent"))

    def step(s, x):
        since = x["at"] - s["at"]
        moved = F.when(s["km"] <= 0, x["distance_km"] > 0).otherwise(F.abs(x["distance_km"] - s["km"]) / s["km"] >= rules.material_change)
        send = s["at"].isNull() | (since >= int(rules.repeat_min * 6e7)) | ((since >= int(rules.cooldown_min * 6e7)) & moved)
        sent = F.coalesce(send, F.lit(False))
        return F.struct(F.when(sent, x["at"]).otherwise(s["at"]).alias("at"), F.when(sent, x["distance_km"]).otherwise(s["km"]).alias("km"), F.when(sent, F.concat(s["sent"], F.array(x["i"]))).otherwise(s["sent"]).alias("sent"))

    out = runs.withColumn("sent", F.aggregate("x", start, step, lambda s: s["sent"]))
    found = out.select("subscriber_id", "subject", "sent", F.explode("x").alias("x"))
    verdict = F.when(F.array_contains("sent", F.col("x.i")), "sent").otherwise("suppressed")
    return found.select("subscriber_id", "subject", "x.line_id", "x.distance_km", verdict.alias("verdict"))
