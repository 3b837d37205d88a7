"""Deliveries against a plain loop: only what some channel took is in the ledger; passes that run again, channels that fail."""

import random
from datetime import datetime, timedelta

import pandas as pd

from watchgrid.sources import files
from watchgrid.streaming import outbox, sessions

T0 = datetime(2024, 1, 15, 10, 0)
LINES = "subscriber_id long, subject string, line_id long, at timestamp, distance_km double, line string"


def logged(folder, name, takes):
    """A channel that notes each key that it is called with, in a file of its own."""

    def sink(rows: pd.DataFrame) -> pd.Series:
        import uuid

        rows.to_json(f"{folder}/{name}-{uuid.uuid4().hex}", orient="records", lines=True)
        return rows["subscriber_id"].map(takes)

    return sink


def calls(folder, name):
    return [x for f in folder.glob(f"{name}-*") for x in pd.read_json(f, orient="records", lines=True, dtype={"key": str}).to_dict("records")]


def brute(portions, takes):
    said, out = {}, {}
    for rows in portions:
        now = max(x[3] for x in rows)
        waiting = []
        for row in rows:
            before = said.get(row[:2])
            minutes = (now - before[0]).total_seconds() / 60 if before else 99
            moved = before and (row[4] > 0 if before[1] <= 0 else abs(row[4] - before[1]) / before[1] >= 0.25)
            if minutes < 5 or (minutes < 20 and not moved):
                out[row[2]] = "suppressed"
            else:
                waiting.append(row)
        for row in sorted(waiting, key=lambda x: (x[4], x[2])):
            out[row[2]] = "sent" if takes(row[0]) else "failed"
            if takes(row[0]):
                said[row[:2]] = (now, row[4])
    return out


def test_stream(spark, tmp_path):
    r = random.Random(6)
    portions = []
    for k in range(7):
        start = T0 + timedelta(minutes=4 * k)
        portions.append([(r.randrange(6), r.choice("ab"), 100 * k + i, start + timedelta(seconds=r.randrange(240)), float(r.choice([0, 0, 4, 5, 9])), f"{k}.{i}") for i in range(25)])
    takes = lambda who: who not in (2, 5)
    both = {"direct": logged(str(tmp_path), "direct", lambda who: who in (0, 1)), "browser": logged(str(tmp_path), "browser", lambda who: who in (1, 3, 4))}
    store = str(tmp_path / "store")
    for k, rows in enumerate(portions):
        spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(LINES).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        outbox.notify(source, both, store, f"{tmp_path}/checkpoint").awaitTermination()
    got = {x.line_id: x.verdict for x in outbox.verdicts(spark, store).collect()}
    assert got == brute(portions, takes) and set(got.values()) == {"suppressed", "sent", "failed"}
    # each message reached each channel once, nearest line first, with every line that wasn't suppressed
    told = calls(tmp_path, "direct")
    assert len({x["key"] for x in told}) == len(told) == sum(x.recipients for x in outbox.passes(spark, store).collect())
    by_line = {x[5]: x for rows in portions for x in rows}
    written = [text.split("\n") for text in (x["text"] for x in told)]
    assert sorted(line for text in written for line in map(str, text)) == sorted(by for by, x in by_line.items() if got[x[2]] != "suppressed")
    assert all(text == sorted(text, key=lambda line: (by_line[line][4], by_line[line][2])) for text in written)
    # the ledger holds what can still suppress, nothing older
    assert all(x.said_at > portions[-1][0][3] - timedelta(minutes=30) for x in outbox.ledger(spark, store).collect())


def test_runs_again_and_failures(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a", 1, T0, 5.0, "x"), (1, "a", 2, T0, 7.0, "y"), (2, "a", 3, T0, 5.0, "z"), (2, "a", 3, T0, 5.0, "z")], LINES)

    def broken(_):
        raise OSError("no network")

    outbox.deliver(rows, {"broken": broken}, store, 0)
    assert {x.verdict for x in outbox.verdicts(spark, store).collect()} == {"failed"} and outbox.ledger(spark, store).count() == 0
    # nothing was delivered, so a minute later nothing is suppressed
    later = rows.selectExpr("subscriber_id", "subject", "line_id + 10 as line_id", "at + interval 1 minute as at", "distance_km", "line")
    fine = {"broken": broken, "fine": logged(str(tmp_path), "fine", lambda _: True)}
    for _ in range(3):
        outbox.deliver(later, fine, store, 1)
    assert len(calls(tmp_path, "fine")) == 2
    assert [x.verdict for x in outbox.verdicts(spark, store).where("batch = 1").collect()] == ["sent"] * 4
    assert sorted((x.subscriber_id, x.distance_km) for x in outbox.ledger(spark, store).collect()) == [(1, 7.0), (2, 5.0)]
    outbox.deliver(rows.limit(0), fine, store, 2)
    assert outbox.verdicts(spark, store).count() == 8 and outbox.ledger(spark, store).count() == 2


def test_sessions_late(spark, tmp_path):
    schema = "report_id long, type string, channel_no long, observed_at timestamp"
    at = lambda m: T0 + timedelta(minutes=m)
    portions = [
        [(1, "uav", 1, at(0)), (2, "uav", 1, at(25)), (3, "uav", 2, at(40))],
        [(4, "uav", 1, at(50)), (2, "uav", 1, at(25)), (5, "uav", 2, at(200))],
        # nothing but what is too late, and a time that is missing
        [(6, "uav", 1, at(60)), (7, "uav", 1, None), (8, "uav", 9, at(300))],
    ]
    got = []
    for k, rows in enumerate(portions):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        frame = sessions.closed_sessions(source)
        frame.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((x.channel_no, x.first_seen, x.last_seen, x.n_reports) for x in got) == [(1, at(0), at(50), 3), (2, at(40), at(40), 1), (2, at(200), at(200), 1)]


def test_pages_with_blocks_within(spark):
    one = lambda k, text: f'<div class="tgme_widget_message_wrap"><div data-post="Ch/{k}"><div class="tgme_widget_message_text js-message_text">{text}</div><span class="tgme_widget_message_date"><time datetime="2024-01-15T10:00:00+00:00"></time></span></div></div>'
    html = "<html>" + one(1, "a <div>b <div>c</div></div> d") + one(2, "e") + one(3, "") + "</html>"
    df = spark.createDataFrame([("ch", html), ("ch", ""), ("ch", None)], "channel string, html string")
    got = sorted((x.message_id, " ".join(x.text.split())) for x in files.page_messages(df).collect())
    assert got == [(1, "a b c d"), (2, "e"), (3, "")]
