"""Line dedup by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid.session import cut

_BLANK = r"[\x09-\x0D\x20]*"


def _line_hashes(text: Column) -> Column:
    """One 64-bit hash a line; null for a line without a word."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(~x.rlike(f"^{_BLANK}$"), F.xxhash64(x)))


def line_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """Remove lines covered by a window of ``width`` lines that also starts earlier.

    Lines are what ``\\n`` separates. Lines without a word are kept and are not part of windows, so a window
    is ``width`` consecutive lines with words, whatever blank lines lie between. A window is earlier in a
    document of smaller ``doc_id`` or at an earlier line of the same one; windows are judged on the input.
    Each window is named by 128 hash bits over its lines' 64-bit hashes. Overlapping removals are merged.

    Returns the rows and columns of ``docs`` with ``text`` changed, and two more: ``n_lines`` and
    ``n_removed`` (long). Null text stays null with 0 lines; an empty text has one line; fewer than ``width``
    lines with words are left alone. Rows of equal ``doc_id`` and text are one document; different texts of one ``doc_id``
    are documents of their own, ordered by a hash of the text. Rows with a null ``doc_id`` come back unchanged. Columns named like the
    two new ones are replaced; ``_lines``, ``_version`` and ``_covered`` are taken for the work and left out.
    """
    docs = docs.drop("n_lines", "n_removed", "_lines", "_version", "_covered")
    version = F.xxhash64("text").alias("_version")
    hashes = docs.where("doc_id is not null and text is not null").select("doc_id", version, _line_hashes(F.col("text")).alias("h"))
    lines = hashes.select("doc_id", "_version", F.filter(F.transform("h", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s.x.isNotNull()).alias("l"))
    # column references of a lambda's outer array are evaluated once, so each window is built from shifted copies
    window = F.transform("l", lambda s: F.struct(s.i.alias("i0"), s.x.alias("x0"), s.i.alias("i1"), F.lit(0).cast("long").alias("b")))
    for k in range(1, width):
        shifted = F.slice("l", k + 1, F.greatest(F.size("l") - k, F.lit(0)))
        window = F.zip_with(
            F.slice(window, 1, F.greatest(F.size("l") - k, F.lit(0))),
            shifted,
            lambda w, s: F.struct(w.i0.alias("i0"), F.xxhash64(w.x0, s.x).alias("x0"), s.i.alias("i1"), F.xxhash64(s.x, w.b, w.x0).alias("b")),
        )
    windows = lines.select("doc_id", "_version", F.explode(window).alias("w")).select("doc_id", "_version", "w.*")
    # written first: an aggregate right below the join would keep Spark from splitting a window that many files share
    keys = cut(windows.groupBy("x0", "b").agg(F.min(F.struct("doc_id", "_version", "i0")).alias("first"), F.count("*").alias("n")).where("n > 1").select("x0", "b", "first"))
    later = (
        windows.join(keys, ["x0", "b"])
        .where("struct(doc_id, _version, i0) <> first")
        .groupBy("doc_id", "_version")
        .agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("i0", "i1")))).alias("_covered"))
    )
    # only the lines travel to the join; the text is put together again after it
    whole = docs.withColumns({"_lines": F.split("text", "\n"), "_version": F.xxhash64("text")}).drop("text").join(later, ["doc_id", "_version"], "left")
    n = F.coalesce(F.greatest(F.size("_lines"), F.lit(0)), F.lit(0))
    # blank lines inside a removed window go with it; array_except keeps the order of the kept places
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_covered"))
    stays = F.when(F.col("_covered").isNull(), F.col("_lines")).otherwise(F.transform(kept, lambda i: F.element_at(F.col("_lines"), i + 1)))
    removed = F.when(F.col("_covered").isNull(), F.lit(0)).otherwise(F.size("_covered"))
    out = whole.withColumns({"text": F.array_join(stays, "\n"), "n_lines": n.cast("long"), "n_removed": removed.cast("long")})
    return out.select(*docs.columns, "n_lines", "n_removed")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines and a digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT *, row_number() OVER d AS r,
    line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS three, lead(i, 2) OVER d AS last_i
  FROM l WHERE regexp_matches(line, '[^\x09-\x0D\x20]') WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, row_number() OVER (PARTITION BY three ORDER BY doc_id, i) AS nth FROM w WHERE three IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest(range(i, last_i + 1)) AS i FROM k WHERE nth > 1),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL) AS text,
    count(*) AS n_lines, count(c.i) AS n_removed
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
