"""Hand cases of the alert feeds, region states and messages, with odd input."""

from watchgrid.functions import text as tx
from watchgrid.operators import feeds, inbox

SITREP = """# head
## 3. CURRENT WARNING STATUS
**Nominal alerts (Луганська область)** — air raid alert
**Ternopil (Тернопільська область)** — air raid alert. 3 areas affected: A (Тернопільський), B (Кременецький район), C (Чортківський)
**Sumy (Сумська область)** — air raid alert. 2 areas affected: (Сумський), m. Sumy (м. Суми)
**Kharkiv (Харківська область)** — artillery threat. 1 area affected: (Липецька)
**Kyiv (м. Київ)** — air raid alert
## 4. THREAT ACTIVITY
- **21:05 — UAV (БпЛА)** over Sumy — west
## 5. END
"""


def test_sitrep(spark):
    df = spark.createDataFrame([(1, SITREP), (2, SITREP.replace("CURRENT WARNING", "OTHER")), (3, None), (4, "")], "poll_id long, raw string")
    rows = feeds.sitrep(df).collect()
    got = {x.region: (x.level, x.areas) for x in rows}
    assert len(rows) == len(feeds.REGIONS) and {x.poll_id for x in rows} == {1}
    assert got["ternopilska"] == ("full", ["тернопільський", "кременецький", "чортківський"])
    assert got["sumska"] == ("partial", ["сумський", "суми"]) and got["kyiv"] == ("partial", [])
    assert got["kharkivska"] == got["luhanska"] == ("none", [])
    assert [tuple(x) for x in feeds.threats(df.where("poll_id = 1")).select("at", "kind", "place").collect()] == [("21:05", "UAV", "Sumy")]


def test_short_feeds_give_nothing(spark):
    df = spark.createDataFrame([(1, "A" * 26), (2, "AP" + "N" * 25), (3, None), (4, "N" * 40)], "poll_id long, raw string")
    rows = feeds.fixed_string(df).collect()
    assert {x.poll_id for x in rows} == {2, 4} and len(rows) == 54
    assert {(x.region, x.level) for x in rows if x.poll_id == 2 and x.level != "none"} == {("vinnytska", "full"), ("volynska", "partial")}
    names = [f'{{"name":"{n} область","alert":true}}' for _, n, _ in feeds.REGIONS[:20]]
    df = spark.createDataFrame([(1, f"[{','.join(names)}]"), (2, f"[{','.join(names[:19])}]"), (3, "x"), (4, None)], "poll_id long, raw string")
    rows = feeds.states(df).collect()
    assert len(rows) == 20 and all(x.level == "full" and x.region for x in rows)


def test_districts_and_readers(spark):
    districts = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "region string, district string")
    levels = spark.createDataFrame([(1, "a", "partial", ["x", "q"]), (2, "a", "partial", ["q"]), (3, "a", "none", ["x"]), (4, "b", "full", [])], "poll_id long, region string, level string, areas array<string>")
    got = {(x.poll_id, x.district): x.active for x in feeds.district_states(levels, districts).collect()}
    assert got == {(1, "x"): True, (1, "y"): False, (2, "x"): True, (2, "y"): True, (3, "x"): False, (3, "y"): False, (4, "z"): True}
    wanted = sorted((x.poll_id, x.region_id, x.level, x.severity, tuple(x.areas)) for x in feeds.desired_alerts(levels, districts).collect())
    assert wanted == [(1, "oblast:a", "hromada", "partial", ("q",)), (1, "raion:a:x", "raion", "full", ()), (2, "oblast:a", "hromada", "partial", ("q",)), (4, "oblast:b", "oblast", "full", ())]
    readers = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, None), (4, "b", "z"), (5, "a", "y")], "subscriber_id long, region string, district string")
    changes = spark.createDataFrame([("a", "x", "stop"), ("a", "x", "start"), ("a", None, "stop"), ("b", None, "start")], "region string, district string, kind string")
    assert {(x.subscriber_id, x.kind) for x in feeds.subscriber_alerts(readers, changes).collect()} == {(1, "start"), (2, "stop")}


def test_texts(spark):
    rows = ["Підписатись\n3 БпЛА курсом на Суми", "Картка 4441-1111-2222-3333", "збито шахед", "", None, "п’ять на Суми", "250 шахедів", "о 9:05 та орієнтовно о 10:00", "орієнтовно о 10:00, [15.01.2024 11:22]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    from pyspark.sql import functions as F

    t = F.col("text")
    got = {x.i: x for x in df.select("i", tx.strip_boilerplate(t).alias("c"), tx.is_fundraising(t).alias("f"), tx.is_sensitive(t).alias("s"), tx.extract_count(t).alias("n"), tx.stated_time(t).alias("at"), tx.classify_type(t).alias("k")).collect()}
    assert (got[0].c, got[1].f, got[2].s, got[3].c, got[4].c) == ("3 БпЛА курсом на Суми", True, True, "", None)
    assert (got[5].n, got[6].n, got[0].n) == (5, 1, 1) and (got[7].at, got[8].at, got[3].at) == ("9:05", "11:22", None)
    assert (got[0].k, got[5].k, got[4].k) == ("uav", "unknown", "unknown")


def test_answers(spark):
    good = '{"targets":[{"type":"uav","count":2}]}'
    rows = [good, f"```json\n{good}\n```", f"well {good} so", "{", None, '{"targets":[{"type":"uav","count":0}]}', '{"targets":[{"type":"x"}]}', '{"targets":[{"type":"uav","confidence":2}]}', '{"other":1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, raw string")
    from pyspark.sql import functions as F

    got = {x.i: x.t for x in df.select("i", inbox.extraction(F.col("raw")).alias("t")).collect()}
    assert all(got[i][0]["count"] == 2 and got[i][0]["relation"] == "towards" for i in range(3)) and all(got[i] is None for i in range(3, 9))


def test_a_report_is_read_in_its_own_row(spark):
    df = spark.createDataFrame([(1, SITREP)], "poll_id long, raw string")
    districts = spark.createDataFrame([("sumska", "сумський")], "region string, district string")
    levels = feeds.sitrep(df)
    shuffled = [levels._jdf.queryExecution().optimizedPlan().toString().count(x) for x in ("Join", "Aggregate")]
    # districts are the one table that is sent, whatever is made of the reports
    states = feeds.district_states(levels, districts)._jdf.queryExecution().optimizedPlan().toString()
    assert shuffled == [0, 0] and states.count("Join") == 1 and states.count("Aggregate") == 1
