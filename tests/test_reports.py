"""Reports from messages: hand cases, launch sites against brute force, and what must not matter."""

import random
import re

import pytest
from pyspark.sql import functions as F
from watchgrid.operators import places, reports

LEXICON = [
    ("Охтирка", "sumska", "city", 50_000, 50.31, 34.9), ("Лебедин", "sumska", "town", 25_000, 50.58, 34.48), ("Путивль", "sumska", "town", 15_000, 51.33, 33.87),
    ("Красне", "lvivska", "town", 9_000, 49.9, 24.6), ("Красне", "odeska", "village", 900, 46.6, 30.1), ("Дніпро", "dnipropetrovska", "city", 900_000, 48.46, 35.05),
    ("Одеса", "odeska", "city", 1_000_000, 46.48, 30.72), ("Затока", "odeska", "village", 2_000, 46.07, 30.45), ("Суми", "sumska", "city", 260_000, 50.9, 34.8),
    ("Харків", "kharkivska", "city", 1_400_000, 49.99, 36.23), ("Коростень", "zhytomyrska", "town", 60_000, 50.95, 28.65), ("Київ", "kyiv", "city", 2_900_000, 50.45, 30.52),
    ("Вишгород", "kyivska", "town", 30_000, 50.58, 30.49), ("Липова Долина", "sumska", "village", 5_000, 50.57, 33.8), ("Липова", "sumska", "village", 300, 50.1, 33.0),
]

#: text, and what it gives: (type, count, relation, from, to, region, course to 10 degrees or None, confidence)
CASES = [
    ("Сумщина: 8 біля Охтирки, 1 на Лебедин", [("unknown", 8, "over", None, "Охтирка", "sumska", None, 0.7), ("uav", 1, "towards", None, "Лебедин", "sumska", None, 0.85)]),
    ("БпЛА повз Путивль, курсом на Охтирку", [("uav", 1, "towards", "Путивль", "Охтирка", "sumska", 147, 0.95)]),
    ("Одещина реактивний на село Красне", [("jet_uav", 1, "towards", None, "Красне", "odeska", None, 1.0)]),
    ("реактивний на Красне", [("jet_uav", 1, "towards", None, "Красне", "lvivska", None, 0.6)]),
    ("⚠ Дніпро\nРеактивний БпЛА над містом!", [("jet_uav", 1, "over", None, "Дніпро", "dnipropetrovska", None, 0.95)]),
    ("Реактивний БпЛА над містом!", []),
    ("⚠ Дніпро\n⚠ Суми\nБпЛА на місто з Путивля", [("uav", 1, "towards", "Путивль", "Суми", "sumska", 126, 0.95)]),
    ("пуски шахедів з наступних локацій:\n3 з Смоленська\n10 з Курська, 5 з району Навля (Брянська область)", [("uav", 3, "launch", "Шаталово", None, None, None, 0.5), ("uav", 10, "launch", "Курськ", None, None, None, 0.5), ("uav", 5, "launch", "Навля", None, None, None, 0.5)]),
    ("пуски шахедів: Орел, Курськ та Брянська область", [("uav", 1, "launch", x, None, None, None, 0.5) for x in ("Орел", "Курськ", "Брянськ")]),
    ("реактивний над Одесою кружляє, реактивний на Суми", [("jet_uav", 1, "over", None, "Одеса", "odeska", None, 0.95), ("jet_uav", 1, "towards", None, "Суми", "sumska", 31, 0.95)]),
    ("БпЛА на Житомирщині, змінив курс на Коростень", [("uav", 1, "towards", None, "Коростень", "zhytomyrska", 0, 1.0)]),
    ("Пуск КАБ по Харкову", [("kab", 1, "from", "Харків", None, "kharkivska", None, 0.95)]),
    ("КАБи на Дніпропетровщину", [("kab", 1, "towards", None, "Дніпропетровська", "dnipropetrovska", None, 0.5)]),
    ("На Одещині та в напрямку Одеси значні затримки поїздів через ворожу атаку на станції", []),
    ("На Одесу", [("unknown", 1, "towards", None, "Одеса", "odeska", None, 0.665)]),
    ("5 шахедів Затока міст", [("uav", 5, "over", None, "Затока", "odeska", None, 0.76)]),
    ("шахед залітає з Одещини", [("uav", 1, "from", "Одеська", None, "odeska", None, 0.5)]),
    ("пуски Калібрів з акваторії Чорного моря", [("cruise", 1, "launch", "Чорне море", None, None, None, 0.5)]),
    ("БпЛА у напрямку Чорного моря", [("uav", 1, "towards", None, "Чорне море", None, None, 0.5)]),
    ("БпЛА на Одесу з півночі", [("uav", 1, "towards", None, "Одеса", "odeska", 180, 0.95)]),
    ("БпЛА повз Вишгород у напрямку Києва", [("uav", 1, "towards", "Вишгород", "Київ", "kyiv", 172, 1.0)]),
    ("3 БпЛА на Липову Долину", [("uav", 3, "towards", None, "Липова Долина", "sumska", None, 0.95)]),
    ("Сумщина: шахед на Охтирку/Суми", [("uav", 1, "towards", None, "Охтирка", "sumska", None, 1.0)]),
    ("Сумщина: шахед на Охтиркку", [("uav", 1, "towards", None, "Охтирка", "sumska", None, 0.7)]),
    ("шахед на Охтиркку", []),
    ("Сумщина:\nШахед на Суми\n\nХарківщина:\n2 на Харків", [("uav", 1, "towards", None, "Суми", "sumska", None, 1.0), ("uav", 2, "towards", None, "Харків", "kharkivska", None, 1.0)]),
    ("мінус по шахеду на Суми\nТри залишилось в бік Затоки", [("uav", 3, "towards", None, "Затока", "odeska", None, 0.95)]),
    ("відбій тривоги на Сумщині", []), ("Збір на Суми, картка 4441 1111 2222 3333", []), ("уламки впали, БпЛА на Суми", []), ("", []), (None, []), ("  \n ⚠ \n", []),
]


def read(spark, texts, partitions=3):
    lexicon = spark.createDataFrame([(i + 1, *x) for i, x in enumerate(LEXICON)], "place_id long, name string, region string, place string, population long, lat double, lon double")
    messages = spark.createDataFrame([(f"{i:04}", t, 5) for i, t in enumerate(texts)], "message_id string, text string, clause int").repartition(partitions)
    got = {f"{i:04}": [] for i in range(len(texts))}
    for r in sorted(reports.parsed_reports(messages, lexicon, places.place_forms(lexicon)).collect(), key=lambda r: (r.message_id, r.line, r.clause, r.nth)):
        got[r.message_id].append((r.type, r["count"], r.relation, r.from_name, r.to_name, r.oblast, r.course_deg, r.confidence))
    return [got[k] for k in sorted(got)]


def same(got, want):
    close = lambda a, b: a == b or (a is not None and b is not None and abs((a - b + 180) % 360 - 180) <= 10)
    return len(got) == len(want) and all(g[:6] == w[:6] and close(g[6], w[6]) and g[7] == w[7] for g, w in zip(got, want))


def test_hand_cases(spark):
    for (text, want), got in zip(CASES, read(spark, [t for t, _ in CASES])):
        assert same(got, want), (text, got)


def test_long_messages_and_partitions(spark):
    """Many clauses of one message go over several batches, and no message's state reaches another."""
    r = random.Random(1)
    picked = [r.choice([t for t, _ in CASES if t and "\n" not in t and "артка" not in t and "уламки" not in t]) for _ in range(3000)]
    texts = ["\n".join(picked), "над містом", *[t for t, _ in CASES]]
    one = read(spark, texts, 7)
    assert len(one[0]) > 2000 and one[1] == []
    for (text, want), got in zip(CASES, one[2:]):
        assert same(got, want), text


def test_a_text_is_read_once(spark, monkeypatch):
    sizes, rows = [], reports.clause_rows
    monkeypatch.setattr(reports, "clause_rows", lambda m: sizes.append(m.count()) or rows(m))
    text, want = CASES[1]
    got = read(spark, [text] * 50 + ["", None, CASES[12][0]])
    assert sizes == [2] and all(same(x, want) for x in got[:50]) and got[50:52] == [[], []] and same(got[52], CASES[12][1])


def test_states_of_messages(spark):
    rows = [("a", "БпЛА на Суми"), ("b", "БпЛА курсом на Нікуди"), ("c", "тихо"), ("d", None), ("e", "Карта 4441 1111 2222 3333, БпЛА на Суми"), ("f", "БпЛА на Нову")]
    messages = spark.createDataFrame(rows, "message_id string, text string")
    found = spark.createDataFrame([("a", 0.95), ("f", 0.4), ("f", 0.9)], "message_id string, confidence double")
    got = {x.message_id: (x.state, x.n_reports, x.needs_fallback) for x in reports.message_states(messages, found).collect()}
    assert got == {"a": ("parsed", 1, False), "b": ("unparsed", 0, True), "c": ("unparsed", 0, False), "d": ("unparsed", 0, False), "e": ("unparsed", 0, False), "f": ("parsed", 2, True)}


def cover(text, forms):
    """Sites by trying every window, the leftmost longest first."""
    words = [w.strip('«"(»".,;:!?)') for w in text.lower().split()]
    words = [w for w in words if w]
    windows = sorted((i, -n) for i in range(len(words)) for n in (1, 2, 3) if i + n <= len(words) and " ".join(words[i : i + n]) in forms)
    found, free = [], 0
    for i, n in windows:
        if i >= free:
            site = forms[" ".join(words[i : i - n])]
            found += [site] if site not in found else []
            free = i - n
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_launch_sites_against_brute_force(spark, seed):
    r = random.Random(seed)
    forms = {f: name for name, _, _, some in reports.SITES for f in some}
    pool = [*forms, "з", "район", "та", "область", "(", ")", "Орла,", "Курська", "області.", "курсом", "пуски"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(300)]
    texts += ["з району Навля (Брянська область)", "пуски (Брянська область)", "", None]
    got = {x.i: x.s for x in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", reports.launch_sites(F.col("text")).alias("s")).collect()}
    for i, text in enumerate(texts):
        if text is not None:
            assert got[i] == (cover(re.sub(r"\([^)]*\)", " ", text), forms) or cover(text, forms)), text
