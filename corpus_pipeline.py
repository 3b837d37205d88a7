"""Corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchgrid.llm import toxicity as tox
from watchgrid.llm.jaccard_join import jaccard_components
from watchgrid.llm.line_dedup import line_dedup
from watchgrid.llm.packing import pack_documents
from watchgrid.llm.substring_dedup import substring_dedup
from watchgrid.session import cut, table

#: Documents of this score or more go.
TOXIC = 0.3


def _aside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work``'s rows with the columns of ``docs``, whose own ones other than doc_id and text go by names that no operator uses."""
    own = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return work(docs.withColumnsRenamed(own)).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored ``TOXIC`` or more go; all others stay as they are, null and empty texts too (no evidence, a low score).

    The model learns from the rows of ``docs`` that ``labels`` covers, in its usable folds. Equal texts fare alike, repeated rows and
    null ids stay, an empty table gives an empty one, and columns of other names, ``score`` too, come through.
    """
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    return _aside(docs, lambda d: tox.toxicity(d, model).where(f"score < {TOXIC}").drop("score", "n_passages", "passages"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go, but for their first occurrence; no document goes.

    Nulls, ties, repeated rows and ids as ``line_dedup`` says; an empty table gives an empty one.
    """
    return _aside(docs, lambda d: line_dedup(d).drop("n_lines", "n_removed"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id, with all its rows. Rows with a null id stay, and so
    do null and empty texts, which link with nothing. An empty table gives an empty one."""
    groups = jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of 20 words go, but for their first occurrence; no document goes.

    Nulls, ties, repeated rows and ids as ``substring_dedup`` says; an empty table gives an empty one.
    """
    return _aside(docs, lambda d: substring_dedup(d).drop("n_words", "n_removed", "kept_sha256"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; nulls, ties and repeated rows as ``pack`` says."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("jaccard_join", near), ("substring_dedup", substrings), ("best_fit_packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a checkpoint, the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
