"""Stages of the pipeline, alone and together, against plain Python."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_jaccard_join import brute as components
from test_line_dedup import brute as without_lines
from test_substring_dedup import brute as without_runs
from watchgrid.llm import toxicity as tox

SF = "/root/testdata/sf0.001"
SPACE = "[ \\t\\n\\r\\x0b\\x0c]+"


def test_all_stages_against_plain_python(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "substring_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = tox.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [(r.doc_id, r.text) for r in tox.toxicity(docs, model).where("score < 0.3").collect()]
    kept = list(without_lines(kept).items())
    group = components(kept)
    kept = [x for x in kept if group[x[0]][1] == x[0]]
    words = {d: k for d, (_, _, k) in without_runs(kept, 20).items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(words)
    # the packed ids are those of texts with these words
    texts = {r.doc_id: r.text for r in corpus_pipeline.substrings(spark, spark.createDataFrame(kept, "doc_id long, text string"), SF).collect()}
    assert {d: " ".join(x for x in re.split(SPACE, t or "") if x) for d, t in texts.items()} == words
    from watchgrid.llm.packing import pack_documents

    alone = pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, alone))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_tables(spark, name, stage):
    long = "a b c d e f g h i j k l m n o p q r s t u v"
    odd = [(1, long, "x", 1.0), (1, long, "x", 1.0), (1, "other text", "y", 2.0), (2, None, None, None), (3, "", "z", 0.5), (None, long, "n", 3.0), (4, "w " * 30000, "v", 1.0), (5, long + " w", "q", 1.0)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, score string, n_lines double").repartition(3)
    out = stage(spark, docs, SF)
    if name != "best_fit_packing":
        assert out.columns == docs.columns
        gone = {5} if name == "jaccard_join" else set()
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(x[0]) for x in odd if x[0] not in gone)
        assert {(r.score, r.n_lines) for r in out.collect()} == {x[2:] for x in odd if x[0] not in gone}
    else:
        assert {r.doc_id for r in out.collect()} == {x[0] for x in odd}
    assert stage(spark, docs.limit(0), SF).count() == 0
    assert stage(spark, docs.where(F.lit(False)), SF).count() == 0
