"""The fallback's answers by places that are known, and what it recovers."""

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from watchgrid.operators import fallback, inbox, places, reports

T0 = datetime(2024, 1, 15, 10, 0)
LEXICON = "place_id long, name string, region string, place string, population long, lat double, lon double"
PLACES = [(1, "Охтирка", "sumska", "city", 50, 50.3, 34.9), (2, "Суми", "sumska", "city", 90, 50.9, 34.8), (3, "Липова Долина", "sumska", "town", 5, 50.6, 33.8), (4, "Миргород", "poltavska", "city", 40, 49.9, 33.6), (5, "Миргород", "sumska", "village", 1, 51.0, 34.0)]


def answers(spark, rows):
    return spark.createDataFrame(rows, "message_id string, posted_at timestamp_ntz, raw string").withColumn("targets", inbox.extraction(F.col("raw")))


def test_ground(spark):
    lexicon = spark.createDataFrame(PLACES, LEXICON)
    rows = [
        ("a", T0, '{"targets":[{"type":"uav","to":"Охтирку","from":"Суми","oblast":"Сумщина","time":"11:40","confidence":0.5,"count":3}]}'),
        ("b", T0, 'say: {"targets":[{"type":"kab","to":"Небувале"},{"type":"kab","to":"Миргород","oblast":"Сумщина","relation":"over"}]} !'),
        ("c", T0, '{"targets":[{"type":"uav","to":"Миргород","time":"23:00"},{"type":"uav","from":"Суми"}]}'),
        ("d", T0, '{"targets":[{"type":"uav","to":"Суми","relation":"launch"}]}'),
        ("e", T0, None),
        ("f", T0, '{"targets":[{"type":"recon","to":"Сумщина","from":"Ніде"}]}'),
        ("g", T0, '{"targets":[]}'),
    ]
    got = {(x.message_id, x.nth): x for x in fallback.ground(answers(spark, rows), lexicon, places.place_forms(lexicon)).collect()}
    assert set(got) == {("a", 0), ("b", 1), ("c", 0), ("f", 0)}
    a = got["a", 0]
    assert (a.to_name, a.from_name, a.oblast, a.count if isinstance(a.count, int) else a["count"], a.relation, a.to_area) == ("Охтирка", "Суми", "sumska", 3, "towards", False)
    # 11:40 in Kyiv is 9:40; a known name in its region is sure
    assert a.observed_at == datetime(2024, 1, 15, 9, 40) and a.confidence == 0.5 and 170 < a.course_deg < 190
    assert (got["b", 1].to_lat, got["b", 1].relation, got["b", 1].from_name, got["b", 1].course_deg) == (51.0, "over", None, None)
    # without a region the larger place counts, and less; a time 11 hours off doesn't
    assert (got["c", 0].to_lat, got["c", 0].oblast, got["c", 0].observed_at, got["c", 0].confidence) == (49.9, "poltavska", T0, 0.3)
    assert (got["f", 0].to_area, got["f", 0].from_name, got["f", 0].oblast) == (True, None, "sumska")
    assert fallback.ground(answers(spark, rows[:0]), lexicon, places.place_forms(lexicon)).count() == 0


def test_equal_answers_are_grounded_once(spark, monkeypatch):
    sizes, cut = [], fallback.cut
    monkeypatch.setattr(fallback, "cut", lambda d: sizes.append(d.count()) or cut(d))
    lexicon = spark.createDataFrame(PLACES, LEXICON)
    rows = [(str(k), T0.replace(hour=9 + k % 2), '{"targets":[{"type":"uav","to":"Суми","time":"11:40"}]}') for k in range(40)]
    got = fallback.ground(answers(spark, rows), lexicon, places.place_forms(lexicon)).collect()
    assert {x.message_id for x in got} == {str(k) for k in range(40)} and len(got) == 40 and max(sizes) == 1


def test_extract_and_recovery(spark):
    seen = spark.createDataFrame([(str(k), t) for k, t in enumerate(["на Суми", "на Суми", "на Ніде", "?", "crash", None, ""])], "message_id string, text string").withColumn("content_hash", F.sha1("text"))

    def extractor(texts: pd.Series) -> pd.Series:
        told = {"на Суми": '{"targets":[{"type":"uav","to":"Суми"}]}', "на Ніде": '{"targets":[{"type":"uav","to":"Ніде"}]}', "": '{"targets":[]}', "?": "I don't know"}
        return texts.map(lambda t: told.get(t))

    found = fallback.extract(seen, extractor)
    assert found.count() == 5 and found.where("raw is null").count() == 1 and found.where("targets is null").count() == 2
    lexicon = spark.createDataFrame(PLACES, LEXICON)
    rows = seen.join(found, "content_hash").withColumn("posted_at", F.lit(T0).cast("timestamp_ntz"))
    got = fallback.recovery(seen, found, fallback.ground(rows, lexicon, places.place_forms(lexicon))).first()
    assert got.asDict() == {"n": 7, "recovered": 2, "empty": 2, "no_answer": 3}
    none = fallback.extract(seen)
    assert none.where("raw is not null").count() == 0
    assert fallback.recovery(seen.limit(0), none, seen.limit(0)).first().asDict() == {"n": 0, "recovered": 0, "empty": 0, "no_answer": 0}


def test_missed(spark):
    messages = spark.createDataFrame([("1", "БпЛА на Суми"), ("2", "БпЛА десь там"), ("3", "доброго ранку"), ("4", None)], "message_id string, text string")
    found = spark.createDataFrame([("1", "uav", 0.9, None, None)], "message_id string, type string, confidence double, course_deg double, from_lat double")
    whole = reports.coverage(messages, found).where("type is null").first()
    assert (whole.messages, whole.parsed, whole.unparsed, whole.missed) == (4, 1, 3, 1)
