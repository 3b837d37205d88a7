"""Quality rules with repetition by a suffix array.

The words of a slice of texts share one suffix array, built by prefix doubling; suffixes of different texts never
compare equal. The longest common prefixes of neighbours give, for each word, the longest run from it that occurs
elsewhere in its text. The maximal repeated substrings are the intervals of the longest-common-prefix table, and the
union of all their occurrences is the union of these runs, so no interval has to be listed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from watchgrid.llm.words import Words, parts
from watchgrid.session import ship

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by keys, the first key first; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def longest_repeats(word: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from it that starts elsewhere in the same text too."""
    n = len(word)
    if not n:
        return np.empty(0, np.int64)
    end = np.searchsorted(owner, owner, "right")  # the text's end, for each word
    place = np.arange(n)
    # a rank is the place of the first of its class in sorted order
    dense = _dense(owner, word)
    size = np.bincount(dense)
    levels, width = [(np.cumsum(size) - size)[dense]], 1
    while True:
        rank = levels[-1]
        at = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(at):
            break
        # only suffixes that still share a rank need a longer look
        beyond = place[at] + width
        key = rank[at] * (n + 1) + np.where(beyond < end[at], rank[np.minimum(beyond, n - 1)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        order, key = at[by_key], key[by_key]
        i = np.arange(len(order))
        group = np.maximum.accumulate(np.where(np.append(True, rank[order][1:] != rank[order][:-1]), i, 0))
        head = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), i, 0))
        new = rank.copy()
        new[order] += head - group
        levels.append(new)
        width *= 2
    suffix = np.argsort(levels[-1], kind="stable")
    a, b = suffix[:-1], suffix[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        inside = (i + (1 << k) <= end[a]) & (j + (1 << k) <= end[b])
        common = common + np.where(inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]), 1 << k, 0)
    best = np.zeros(n, np.int64)
    best[a] = common
    best[b] = np.maximum(best[b], common)
    return best


def covered(best: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Words under a run of at least ``least`` words (cut to ``most`` words, where given)."""
    n = len(best)
    at = np.flatnonzero(best >= least)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + (best[at] if most is None else np.minimum(best[at], most)), -1)
    return np.cumsum(step[:-1]) > 0


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


NEW = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_covered long, longest_repeat long, kept boolean, symbols_failed boolean"


def quality_rules(docs: DataFrame, least: int = 6, most_covered: int = 30, most_long: int = 60, most_symbols: int = 5) -> DataFrame:
    """The rows and columns of ``docs`` with the figures and verdict of ``NEW``, which replace columns of those names.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. ``n_covered`` counts words under maximal repeated runs of at
    least ``least`` words of the same text, ``longest_repeat`` is the longest repeated run (of any length). A text fails
    the base with fewer than 50 words or more than half of them in repeated 3-word windows. Otherwise it is kept unless
    more than ``most_covered`` percent of its words are covered or its longest repeat is over ``most_long`` words.
    ``symbols_failed`` is a rule of its own, with no part in ``kept``: over ``most_symbols`` symbols of ``#*$%&|<>`` per
    100 words. Null and empty texts have no words and fail the base.
    """
    ship(docs.sparkSession)
    more = T._parse_datatype_string(NEW).fields
    new = [f.name for f in more]
    docs = docs.drop(*new)
    names = docs.columns

    def run(batches):
        for texts, *columns in parts(batches, names):
            w = Words(texts)
            k, owner = len(texts), w.owner()
            best = longest_repeats(w.hash.view(np.int64), owner)
            total = lambda x: np.bincount(owner, x, k).astype(np.int64) if len(owner) else np.zeros(k, np.int64)
            raw = np.frombuffer(w.blob, np.uint8)
            # code points start at bytes that don't continue one
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            marks = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
            n = w.count.astype(np.int64)
            symbols = (marks[w.text_at[1:] - 1] - marks[w.text_at[:-1]]) if k else np.zeros(0, np.int64)
            repeat, under = total(covered(best, 3, 3)), total(covered(best, least))
            longest = np.zeros(k, np.int64)
            np.maximum.at(longest, owner, best)
            failed = (n < 50) | (100 * repeat > 50 * n)
            kept = ~failed & (100 * under <= most_covered * n) & (longest <= most_long)
            figures = [n, total(points[w.end] - points[w.start]), symbols, [_duplicate_lines(t) for t in texts], repeat]
            out = [pa.array(x, pa.int64()) for x in figures] + [pa.array(failed), pa.array(under), pa.array(longest), pa.array(kept), pa.array(100 * symbols > most_symbols * n)]
            yield pa.RecordBatch.from_arrays([*columns, *out], names=[*names, *new])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Per document: base figures and verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).drop("text")
