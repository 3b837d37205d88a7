"""Streams give what the batch operators give over the same rows."""

import random
from datetime import datetime, timedelta

from watchgrid.operators import alerts, live, notices
from watchgrid.streaming import ingest, state
from watchgrid.streaming.live import live_changes

T0 = datetime(2024, 1, 15)


def stream(spark, folder, portions, schema):
    for k, rows in enumerate(portions):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(frame, folder):
    got = []
    query = frame.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return got


def test_ledger(spark, tmp_path):
    r = random.Random(4)
    rows = sorted(((r.randrange(3), r.choice("ab"), i, T0 + timedelta(seconds=r.randrange(7200)), float(r.choice([0, 4, 5, 9]))) for i in range(200)), key=lambda x: (x[3], x[2]))
    schema = "subscriber_id long, subject string, line_id long, at timestamp, distance_km double"
    want = {x.line_id: x.verdict for x in notices.ledger(spark.createDataFrame(rows, schema)).collect()}
    got = run(state.ledger(stream(spark, str(tmp_path), [rows[:60], rows[60:61], rows[61:]], schema)), str(tmp_path))
    assert {x.line_id: x.verdict for x in got} == want and len(got) == 200


def test_transitions_and_intervals(spark, tmp_path):
    r = random.Random(5)
    polls = [(k, T0 + timedelta(hours=h), r.choice([0, 0, 1, 2])) for h in range(40) for k in range(4)]
    schema = "region long, poll_at timestamp, level int"
    batch = spark.createDataFrame(polls, schema)
    portions = [polls[:52], polls[52:100], polls[100:]]
    got = run(state.alert_transitions(stream(spark, f"{tmp_path}/a", portions, schema)), f"{tmp_path}/a")
    assert sorted(map(tuple, got)) == sorted(map(tuple, alerts.transitions(batch).select("region", "poll_at", "before", "level").collect()))
    got = run(state.alert_intervals(stream(spark, f"{tmp_path}/b", portions, schema)), f"{tmp_path}/b")
    want = [tuple(x) for x in alerts.intervals(batch).select("region", "level", "started_at", "ended_at").collect() if x.ended_at]
    assert sorted(map(tuple, got)) == sorted(want)


def test_ingest(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"c{r.randrange(3)}", r.randrange(12), T0 + timedelta(minutes=i), r.choice(["x", "y", "z"])) for i in range(90)]
    schema = "channel string, message_id long, captured_at timestamp, text string"
    store = f"{tmp_path}/store"
    query = ingest.ingest(stream(spark, str(tmp_path), [rows[:40], rows[:40], rows[40:]], schema), store, f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    got = {(x.channel, x.message_id): x for x in ingest.version(spark, store).collect()}
    last = {}
    for c, m, at, text in rows:
        last[c, m] = text
    assert {k: x.text for k, x in got.items()} == last
    assert all(x.parse_state == "pending" and x.parsed_at is None for x in got.values())


def test_merge_keeps_what_is_stored(spark):
    stored = [("c", 1, T0, "same", None, None, "parsed", T0), ("c", 2, T0, "old", None, None, "parsed", T0), ("c", 3, T0, "only stored", None, None, "parsed", T0)]
    from pyspark.sql import functions as F

    s = spark.createDataFrame(stored, ingest.STORE).withColumn("content_hash", F.sha1("text"))
    later = T0 + timedelta(hours=1)
    b = spark.createDataFrame([("c", 1, later, "same"), ("c", 2, later, "new"), ("c", 4, later, "first"), ("c", 4, later, "first")], "channel string, message_id long, captured_at timestamp, text string")
    got = {x.message_id: (x.text, x.parse_state, x.edited_at, x.parsed_at) for x in ingest.merge(s, b).collect()}
    assert got == {1: ("same", "parsed", None, T0), 2: ("new", "pending", later, None), 3: ("only stored", "parsed", None, T0), 4: ("first", "pending", None, None)}


CHANGE = "kind string, id long, seq long, at timestamp, seen timestamp, gone boolean, value double"


def changes(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        at = T0 + timedelta(minutes=6 * i)
        out.append((r.choice(["track", "track", "alert", "source"]), r.randrange(9), i, at, at - timedelta(minutes=r.choice([0, 0, 5, 100, 400])), r.random() < 0.2, float(i)))
    return out


def plain_state(rows, base=0, minutes=180):
    """All rows one after another, as one reader would take them; numbers up to the first gap."""
    state, head, now = {}, base, None
    for k, i, seq, at, seen, gone, value in sorted(set(rows), key=lambda x: x[2]):
        if seq <= base:
            continue
        if seq != head + 1:
            break
        head, now = seq, at if now is None else max(now, at)
        state.pop((k, i), None)
        if not gone:
            state[k, i] = (seq, seen, value)
    return {x for x in ((*k, v[0], v[2]) for k, v in state.items() if k[0] != "track" or v[1] >= now - timedelta(minutes=minutes))}


def test_live_is_the_fold_of_all_changes(spark):
    rows = changes(1, 200)
    frame = lambda x: spark.createDataFrame(x, CHANGE)
    got = lambda d: {(x.kind, x.id, x.seq, x.value) for x in d.collect()}
    log = frame(rows + rows[50:90])
    assert got(live.live(None, log)) == plain_state(rows)
    snap = live.live(None, log.where("seq <= 120"))
    assert got(live.live(snap, log, 120)) == plain_state(rows)
    holed = rows[:150] + rows[151:]
    assert got(live.live(None, frame(holed))) == plain_state(holed) == plain_state(rows[:150])
    assert got(live.live(None, frame([]))) == set() and live.head(frame([]), 7).first()[0] == 7
    assert live.head(frame(holed), 0).first()[0] == 150 and live.head(frame(holed), 150).first()[0] == 150


def test_events_become_changes(spark):
    schema = "type string, seq long, at timestamp, id long, seen timestamp, ended boolean, new_id long, value double"
    e = [("alert.started", 1, 5, None, False, None), ("alert.started", 2, 6, None, True, None), ("alert.ended", 3, 5, None, None, None), ("track.observed", 4, 7, T0, None, None)]
    e += [("track.revised", 5, 7, T0, None, 8), ("track.revised", 6, 8, T0, None, None), ("track.revised", 7, 9, T0, None, 9), ("source.status", 8, 1, None, None, None), ("pong", 9, 1, None, None, None)]
    rows = [(t, q, T0, i, s, x, n, 1.0) for t, q, i, s, x, n in e]
    got = sorted((x.seq, x.kind, x.id, x.gone) for x in live.changes(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "alert", 5, False), (2, "alert", 6, True), (3, "alert", 5, True), (4, "track", 7, False), (5, "track", 7, True), (5, "track", 8, False), (6, "track", 8, True), (7, "track", 9, False), (8, "source", 1, False)]


def test_live_stream_with_late_repeated_and_expired(spark, tmp_path):
    rows = changes(2, 160)
    late = [x for x in rows if x[2] % 9 == 0]
    first = [x for x in rows[:60] if x not in late]
    portions = [first, rows[60:110] + [x for x in late if x[2] <= 60], first[:20] + rows[110:] + late]
    want = plain_state(rows)
    for name, minutes in (("track", 180), ("alert", None), ("source", None)):
        folder = f"{tmp_path}/{name}"
        source = stream(spark, folder, portions, CHANGE).where(f"kind = '{name}'")
        got = run(live_changes(source, minutes), folder)
        last = {}
        for x in got:
            if (x.seq, x.gone) > last.get((x.kind, x.id), (0, False, None))[:2]:
                last[x.kind, x.id] = (x.seq, x.gone, x)
        shown = {(*k, v[0], v[2].value) for k, v in last.items() if not v[1] and (minutes is None or v[2].seen >= rows[-1][3] - timedelta(minutes=minutes))}
        assert shown == {x for x in want if x[0] == name}
        assert len({(x.id, x.seq, x.gone) for x in got}) == len(got)  # repeats and older changes gave nothing
        if minutes:
            stated = {(x[1], x[2]) for x in rows if x[5]}
            assert any(x.gone and (x.id, x.seq) not in stated for x in got)  # some went by their timer


def test_entities_share_a_bucket(spark, tmp_path):
    """One call holds entities of all sorts: some change, some are late or repeated, some only expire, null ids too."""
    rows = [(k, i, q, t, s, g, v) for k, i, q, t, s, g, v in changes(3, 160) if k == "track"]
    rows += [("track", None, 500, T0, T0, False, 7.0), ("track", 2**60 + 1, 501, T0, T0, False, 8.0)]
    late = [x for x in rows if x[2] % 9 == 0]
    first = [x for x in rows[:20] if x not in late] + rows[-2:]
    results = []
    for buckets in (1, 64):
        folder = f"{tmp_path}/{buckets}"
        source = stream(spark, folder, [first, rows[20:40] + late, first[:9] + rows[40:]], CHANGE)
        got = run(live_changes(source, 180, buckets), folder)
        results.append(sorted((str(x.id), x.seq, x.gone, x.at, x.seen, x.value is None or x.value != x.value) for x in got))
    assert results[0] == results[1] and any(x[:3] == (str(2**60 + 1), 501, False) for x in results[0]) and any(x[:3] == ("None", 500, False) for x in results[0])


def test_store_rewrites_only_what_changes(spark, tmp_path):
    schema = "channel string, message_id long, captured_at timestamp, text string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    store = f"{tmp_path}/store"
    rows = [("c", i, T0, f"text {i}") for i in range(200)]
    ingest.write(frame(rows), store, 0, 16)
    assert {b for _, b, _ in ingest._log(spark, store)} == {0}
    ingest.write(frame(rows), store, 1, 16)  # repeats write nothing
    assert not (tmp_path / "store/data/batch=1").exists()
    later = T0 + timedelta(hours=1)
    edit = [("c", 7, later, "edited"), ("c", 8, later, "text 8"), ("c", 9, T0 - timedelta(hours=1), "older")]
    for _ in range(2):  # a batch that runs again gives the same
        ingest.write(frame(edit), store, 2, 16)
        assert [b for _, b, _ in ingest._log(spark, store)].count(2) == 1
        got = {x.message_id: (x.text, x.edited_at) for x in ingest.version(spark, store).collect()}
        assert len(got) == 200 and got[7] == ("edited", later) and got[8] == ("text 8", None) and got[9] == ("text 9", None)
    assert ingest.version(spark, store, 2).where("text = 'edited'").count() == 0
    assert ingest.compact(spark, store, keep=2) == 0 and ingest.compact(spark, store, keep=1) == 1
    assert ingest.version(spark, store).count() == 200
    try:
        ingest.write(frame(edit), store, 3, 8)
        raise AssertionError
    except ValueError:
        pass
    assert ingest.version(spark, f"{tmp_path}/none").count() == 0 and ingest.compact(spark, f"{tmp_path}/none") == 0


def test_polls_of_one_time_are_one_poll(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    polls = [(1, at(0), 0), (1, at(1), 2), (1, at(1), 0), (1, at(2), 0), (1, at(2), 1), (1, at(2), 0), (1, at(3), 0)]
    schema = "region long, poll_at timestamp, level int"
    for k, rows in enumerate((polls, polls[::-1])):
        got = run(state.alert_transitions(stream(spark, f"{tmp_path}/a{k}", [rows], schema)), f"{tmp_path}/a{k}")
        assert sorted((x.poll_at, x.before, x.level) for x in got) == [(at(1), 0, 2), (at(2), 2, 1), (at(3), 1, 0)]
        got = run(state.alert_intervals(stream(spark, f"{tmp_path}/b{k}", [rows], schema)), f"{tmp_path}/b{k}")
        assert sorted((x.level, x.started_at, x.ended_at) for x in got) == [(1, at(2), at(3)), (2, at(1), at(2))]
