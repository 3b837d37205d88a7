from watchgrid.llm.line_dedup import line_dedup


def brute(docs):
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        if text is None:
            out[doc] = None
            continue
        lines = text.split("\n")
        real = [i for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        for a in range(len(real) - 2):
            key = tuple(lines[i] for i in real[a : a + 3])
            if key in seen:
                gone |= set(range(real[a], real[a + 2] + 1))
            seen.add(key)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_cases(spark):
    docs = [
        (1, "a\nb\nc\nd"),
        (2, "x\na\nb\nc\ny"),
        (3, "a\nb\nc\nd\na\nb\nc\nd\ne"),
        (4, "a\nb"),
        (5, ""),
        (6, None),
        (7, "a\n\nb\n \nc"),
        (8, "s\ns\ns\ns\ns"),
        (9, "\n\n\n\n"),
        (10, "w " * 40000 + "\na\nb\nc"),
        (11, "Б\nґ\nю"),
        (12, "Б\nґ\nю"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'k' as n_removed", "1 as extra")
    got = {r.doc_id: r for r in line_dedup(df).collect()}
    want = brute(docs)
    assert {k: r.text for k, r in got.items()} == want
    assert got[8].n_removed == 5 - want[8].count("s") and got[6].n_lines == 0 and got[5].n_lines == 1
    assert got[2].extra == 1


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup(df).count() == 0
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in line_dedup(df).collect()) == [("1", "a\nb\nc"), ("1", "a\nb\nc"), ("2", ""), ("None", "a\nb\nc")]


def test_one_id_with_different_texts(spark):
    docs = [(1, "a\nb\nc\nd\ne"), (2, "a\nb\nc\nd\ne"), (2, "x"), (2, "y\nz\nq"), (3, "y\nz\nq"), (3, "y\nz\nq"), (3, None)]
    rows = line_dedup(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as covered", "2 as _version").repartition(3)).collect()
    got = sorted((x.doc_id, str(x.text), x.n_lines, x.n_removed) for x in rows)
    assert rows[0].covered == 1
    assert got == [(1, "a\nb\nc\nd\ne", 5, 0), (2, "", 5, 5), (2, "x", 1, 0), (2, "y\nz\nq", 3, 0), (3, "", 3, 3), (3, "", 3, 3), (3, "None", 0, 0)]


def test_a_window_of_a_third_of_all_rows_is_split(spark):
    """Spark may deal the rows of one window to several tasks: no aggregate stands between the exchange of the windows' names and their join."""
    docs = [(i, f"own line {i}\nfoot one\nfoot two\nfoot three") for i in range(300)]
    out = line_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan
    rows = {x.doc_id: x for x in out.collect()}
    assert rows[0].n_removed == 0 and all(rows[i].text == f"own line {i}" for i in range(1, 300))
