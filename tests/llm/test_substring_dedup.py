import random

import numpy as np
import pytest
from watchgrid.llm.substring_dedup import all_windows, representatives, spellings, substring_dedup
from watchgrid.llm.words import Words


def brute(docs, width):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        words = (text or "").encode().split()
        gone = set()
        for a in range(len(words) - width + 1):
            key = tuple(words[a : a + width])
            if key in seen:
                gone |= set(range(a, a + width))
            seen.add(key)
        out[doc] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


def texts(seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(5, 60))) for _ in range(12)]
    docs = [(i, " ".join(r.choice(pool) if r.random() < 0.5 else "".join(r.choice("xyzw") for _ in range(3)) for _ in range(r.randint(0, 12)))) for i in range(60)]
    docs += [(100, "a " * 300), (101, "b a " * 100 + "\n\tq"), (102, "a " * 19), (103, ""), (104, None), (105, "ж ы   " * 50), (106, "a\n" * 40)]
    return docs


@pytest.mark.parametrize("rounds", [0, 1, 2, 3])
def test_equal_windows_have_equal_representatives(rounds):
    w = Words([(t or "").encode() for _, t in texts(5)])
    name, start, n = representatives(w, all_windows(w, 20), 20, rounds)
    of = {}
    for x, a, k in zip(name, start, n):
        for p in range(a, a + k):
            assert of.setdefault(tuple(w.hash[p : p + 20]), x) == x
    assert n.sum() == np.maximum(w.count - 19, 0).sum()


@pytest.mark.parametrize("rounds", [0, 1, 3, 6])
def test_equal_windows_are_spelt_alike(rounds):
    w = Words([(t or "").encode() for _, t in texts(6)])
    starts = all_windows(w, 20)
    h, g = spellings(w, starts, 20, rounds)
    of = {}
    for p, x, y in zip(starts.tolist(), h.tolist(), g.tolist()):
        assert of.setdefault(tuple(w.hash[p : p + 20].tolist()), (x, y)) == (x, y)
    assert len(set(of.values())) == len(of)


def test_one_id_with_different_texts_and_very_long_ones(spark):
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(25))
    long = " ".join(r.choice("abcdef") + str(r.randrange(40)) for _ in range(30000))
    docs = [(1, f"x {passage} y"), (1, passage), (1, passage), (2, f"{passage} {long}"), (3, "short"), (3, f"{long} {passage}"), (3, None)]
    rows = substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(docs)
    of = {(x.doc_id, x.n_words): x for x in rows}
    assert sorted(x.n_removed for x in rows if x.doc_id == 1) in ([0, 0, 25], [0, 25, 25])
    assert of[2, 30025].n_removed == 25 and of[3, 30025].n_removed == 30025 and of[3, 1].text == "short"


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = texts(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "7 as n_words", "'e' as extra")
        got = substring_dedup(df).collect()
        want = brute(docs, 20)
        for r in got:
            assert (r.n_words, r.n_removed, " ".join((r.text or "").encode().split() and [x.decode() for x in (r.text or "").encode().split()])) == want[r.doc_id], r.doc_id
        assert len(got) == len(docs) and {r.doc_id: r.text for r in got}[104] is None and got[0].extra == "e"


def test_empty_and_null_ids(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "k l m n o p q r s t u v w x y z 1 2 3 4 5 6"
    rows = substring_dedup(spark.createDataFrame([(None, long), (3, long), (3, long)], "doc_id long, text string")).collect()
    assert {r.text for r in rows} == {long}
