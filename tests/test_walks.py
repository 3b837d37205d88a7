"""Walks through archived pages and intervals open at many times, against plain Python."""

import datetime as dt
import random

from watchgrid.operators import walks

START = dt.datetime(2024, 1, 1)


def test_walks_against_loops(spark):
    r = random.Random(3)
    archive, want_messages, want = [], set(), set()
    for channel in [f"c{i}" for i in range(12)]:
        pages = {}
        ids = sorted(r.sample(range(1, 400), 90), reverse=True)
        asked = None
        for k in range(0, 90, 10):
            pages[asked] = ids[k : k + 10]
            asked = min(pages[asked])
        if channel in ("c1", "c2"):  # a hole, and a page that doesn't go back
            gone = list(pages)[4]
            pages[gone] = [] if channel == "c1" else [gone, gone + 1]
        if channel == "c3":
            del pages[None]
        archive += [(channel, b, m, "x") for b, some in pages.items() for m in some for _ in range(r.randint(1, 2))]
        asked, n, seen, low, ended = None, 0, {}, None, "end"
        while pages.get(asked):
            n += 1
            for m in pages[asked]:
                seen.setdefault(m, n)
            low = min(pages[asked]) if low is None else min(low, *pages[asked])
            if asked is not None and min(pages[asked]) >= asked:
                ended = "stuck"
                break
            if n == 6:
                ended = "limit"
                break
            asked = min(pages[asked])
        want_messages |= {(channel, m, k) for m, k in seen.items()}
        want |= {(channel, n, low, ended)} if n else set()
    given = spark.createDataFrame([*archive, (None, None, 5, "x"), ("c9", None, None, "x")], "channel string, before long, message_id long, page string")
    messages, walked = walks.backfill_pages(given, most=6)
    assert {tuple(x) for x in messages.collect()} == want_messages and messages.count() == len(want_messages)
    assert {tuple(x) for x in walked.collect()} == want and {x[3] for x in want} == {"stuck", "limit", "end"}


def test_intervals_at_times_against_loops(spark):
    r = random.Random(8)
    at = lambda s: START + dt.timedelta(seconds=s)
    span = lambda: r.choice([0, 1, 30, 59, 61, 500, 10_000, 10**6, 10**8])
    rows = [(i, at(a), None if r.random() < 0.1 else at(a + span())) for i, a in enumerate(r.randrange(10**6) for _ in range(300))]
    rows += [(900, None, at(5)), (901, at(50), at(50)), (902, at(50), at(20)), (903, at(60), at(120)), (903, at(60), at(120))]
    times = [(k, at(r.randrange(-5000, 2 * 10**6))) for k in range(400)] + [(1000, None), (1001, at(60)), (1002, at(120)), (1003, at(10**9))]
    got = walks.open_at(spark.createDataFrame(times, "k int, at timestamp_ntz"), spark.createDataFrame(rows, "i int, started_at timestamp_ntz, ended_at timestamp_ntz"))
    want = sorted((k, i) for k, t in times if t for i, a, b in rows if a and a <= t and (b is None or b > t))
    assert sorted((x.k, x.i) for x in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    none = spark.createDataFrame([], "i int, started_at timestamp_ntz, ended_at timestamp_ntz")
    assert walks.open_at(spark.createDataFrame(times, "k int, at timestamp_ntz"), none).count() == 0
