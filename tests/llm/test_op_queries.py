"""Each registered query over a whole table: against its SQL where it has one, else by its contract."""

import hashlib
import re
import zlib

import duckdb
import pandas as pd
import pytest
from watchgrid.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").df()


def rows(frame):
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(con.sql(catalog.oracle_sql()[name]).df())


def run(spark, name, table):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert sorted(got.doc_id.unique()) == sorted(table.doc_id)
    return got.set_index("doc_id") if not name.startswith("op7") else got


@pytest.mark.parametrize("name, column, modulus, bad, cut", [("op2_quality_classifier", "quality", 3, 1, 0.5), ("op4_toxicity", "toxic", 4, 2, 0.3)])
def test_classifiers(spark, table, name, column, modulus, bad, cut):
    got = run(spark, name, table)
    for d, x in got.iterrows():
        assert x.held_out == (zlib.crc32(str(d).encode()) % modulus == bad) and x.predicted == int(x.score >= cut) and 0 <= x.score <= 1
    labels = duckdb.sql(f"SELECT * FROM '{SF}/labels.parquet'").df().set_index("doc_id")[column].dropna()
    both = got.join(labels, how="inner")
    assert (both.predicted == both[column]).mean() > 0.8
    # equal texts, equal scores
    assert (got.join(table.set_index("doc_id")).groupby("text").score.nunique() <= 1).all()


def test_op3(spark, table):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = run(spark, "op3_sentencepiece", table)
    for d, text in zip(table.doc_id, table.text):
        ids = library.encode(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert tuple(got.loc[d, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == want


def test_op6(spark, table):
    got = run(spark, "op6_quality_rules", table)
    for d, text in zip(table.doc_id, table.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = {}
        for x in windows:
            count[x] = count.get(x, 0) + 1
        repeat = len({i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)})
        x = got.loc[d]
        assert (x.n_words, x.n_repeat_words, x.base_failed) == (len(w), repeat, len(w) < 50 or 100 * repeat > 50 * len(w))
        assert x.kept == (not x.base_failed and 100 * x.n_covered <= 30 * len(w) and x.longest_repeat <= 60)


def test_op7(spark, table):
    got = run(spark, "op7_best_fit_packing", table)
    assert (got.length <= 2048).all() and (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 2048 + 1
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert (group.offset.to_numpy() == group.length.cumsum().shift(fill_value=0).to_numpy()).all()


def test_op9(spark, table):
    got = run(spark, "op9_media_columns", table)
    for d, text in zip(table.doc_id, table.text):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = got.loc[d]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op10(spark, table):
    got = run(spark, "op10_license_scan", table)
    base = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
    for d, text in zip(table.doc_id, table.text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        at = [(i, label) for phrase, label in base for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        x = got.loc[d]
        assert (x.n_words, x.n_base, x.base_labels) == (len(w), len(at), ",".join(sorted({b for _, b in at})))
        first, last = (f((i for i, _ in at), default=None) for f in (min, max))
        assert (None if pd.isna(x.first_word) else x.first_word, None if pd.isna(x.last_word) else x.last_word) == (first, last)
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
