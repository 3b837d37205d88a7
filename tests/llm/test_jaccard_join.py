import random

from watchgrid.llm.components import components
from watchgrid.llm.jaccard_join import jaccard_components


def brute(docs, width=5):
    sets = {}
    for doc, text in docs:
        w = (text or "").encode().lower().split()
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        if doc not in sets or len(s) > len(sets[doc]):
            sets[doc] = s
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    docs = []
    for _ in range(14):
        base = [word() for _ in range(r.randint(3, 120))]
        docs.append(" ".join(base))
        for _ in range(r.randint(0, 7)):
            # chains: each copy changes the last one, so its ends drift apart
            base = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                base[r.randrange(len(base))] = word()
            docs.append((" " if r.random() < 0.5 else "\n").join(base).upper() if r.random() < 0.3 else " ".join(base))
    passage = " ".join(word() for _ in range(60))
    docs += [passage + " " + " ".join(word() for _ in range(r.randint(1, 30))) for _ in range(25)]
    docs += ["", "one", "ONE", "one two", "a b c d e", "a b c d e f", "x " * 5000, "x " * 9, None]
    return list(enumerate(docs))


def test_against_brute_force(spark):
    for seed in (3, 4, 5):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).selectExpr("*", "1 as n", "2 as rep")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
        assert got == brute(docs)


def test_no_rows_null_and_repeated_ids(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "A b c d e f"), (7, None)]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 2, 2), (5, 2, 2), (7, 0, 7)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
