"""The ledger against a plain loop, and texts of warnings."""

import random
from datetime import datetime, timedelta

from watchgrid.operators import notices

T0 = datetime(2024, 1, 15, 10, 0)


def brute(rows):
    said, out = {}, {}
    for who, subject, line, at, km in sorted(rows, key=lambda x: (x[3], x[2])):
        before = said.get((who, subject))
        send = True
        if before:
            minutes = (at - before[0]).total_seconds() / 60
            if minutes < 5:
                send = False
            elif minutes < 20:
                send = km > 0 if before[1] <= 0 else abs(km - before[1]) / before[1] >= 0.25
        if send:
            said[who, subject] = (at, km)
        out[line] = "sent" if send else "suppressed"
    return out


def test_ledger(spark):
    r = random.Random(3)
    rows = [(r.randrange(4), r.choice(["uav|A|in_radius", "uav|B|in_radius"]), i, T0 + timedelta(seconds=r.randrange(0, 14400)), float(r.choice([0, 0, 4, 5, 6, 20]))) for i in range(700)]
    rows += [(9, "x", 1000, T0, 5.0), (9, "x", 1001, T0, 5.0), (9, "x", 1002, T0 + timedelta(minutes=5), 6.25), (9, "x", 1003, T0 + timedelta(minutes=25), 6.25), (9, "x", 1004, T0 + timedelta(minutes=44, seconds=59), 6.25)]
    schema = "subscriber_id long, subject string, line_id long, at timestamp, distance_km double"
    got = {x.line_id: x.verdict for x in notices.ledger(spark.createDataFrame(rows, schema).repartition(5)).collect()}
    assert got == brute(rows)
    assert [got[k] for k in range(1000, 1005)] == ["sent", "suppressed", "sent", "sent", "suppressed"]
    assert notices.ledger(spark.createDataFrame([], schema)).count() == 0


def test_texts(spark):
    rows = [("uav", 1, None, "in_radius", 12.4, None, None), ("kab", 3, "A & <b>", "approaching", 12.5, 0.5, 1.0), ("x", 1, "B", "approaching", 9.0, 11.5, 7.5), ("recon", 2, "C", "heading_towards", 9.0, 4.4, None)]
    df = spark.createDataFrame(rows, "type string, n long, place string, reason string, distance_km double, eta_min double, closest_km double")
    got = [x.line for x in notices.lines(df).collect()]
    assert got == [
        "⚠️ БпЛА — ~12 км від вас",
        "⚠️ КАБ ×3 — A &amp; &lt;b&gt; (~13 км від вас) · курс прямо на вас · вже поруч",
        "⚠️ Ціль — B (~9 км від вас) · пройде за ~8 км · ~12 хв (орієнтовно)",
        "⚠️ Розвідник ×2 — курс на C (~9 км від вас) · до вас ~4 хв",
    ]
    t = spark.createDataFrame([("a — b\n\n c", 2), ("x" * 70, 1), ("", 1)], "t string, n long")
    from pyspark.sql import functions as F

    assert [x[0] for x in t.select(notices.title(F.regexp_extract("t", r"^[^\n]*", 0), F.col("n"))).collect()] == ["a +1", "x" * 59 + "…", ""]
    assert [x[0] for x in t.select(notices.body(F.col("t"))).collect()] == [f"b\nc\n{notices.DISCLAIMER}", notices.DISCLAIMER, notices.DISCLAIMER]
