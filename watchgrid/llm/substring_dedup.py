"""Substring dedup by recompression.

A round of recompression names each maximal run of one symbol, then each neighbouring pair whose first symbol falls in the
left half and whose second falls in the right half of the alphabet. A name is a hash of the parts, and so is the half, so
all tasks name alike over the whole corpus, and equal substrings get equal symbols but for a few at their ends. Each symbol
keeps the words on which its making depended: its span and the neighbours looked at. A symbol is interior to a
window of ``width`` words when it depends on nothing outside.

Each Spark round names the symbols of higher levels and lets only repeats go on. A window is represented by its longest interior symbol
of these levels; a window whose symbol occurs nowhere else can't be repeated and is dropped.
What the last round leaves is verified through the symbols: a window's interior symbols of the highest level, with those of
each lower level to their left and right that no higher one covers, down to words, spell it, and two windows are equal
just when they are spelt alike. The first occurrence of each spelling stays.

Shuffled rows are packed arrays, combined in the map tasks: of what a task holds twice, one row leaves it for the
key's part, so no frequent passage gathers in one place.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.llm.packs import by_part, packed, shared_packs, shared_rows, unpacked
from watchgrid.llm.words import U, Words, mix, parts, ranges_hash
from watchgrid.session import ship

_RUN, _PAIR, _SIDE, _ORDER, _SECOND, _LEFT, _RIGHT = (U(int(hashlib.sha256(x).hexdigest()[:16], 16) | 1) for x in (b"run", b"pair", b"side", b"order", b"second", b"left", b"right"))
#: The levels up to which the Spark rounds name.
ROUNDS = (2, 4)


_FAR = np.iinfo(np.int32).max


def _name_runs(s, at, lo, hi, edge):
    """Name maximal runs. edge[i]: symbol i is the first of its text."""
    same = np.zeros(len(s), bool)
    same[1:] = (s[1:] == s[:-1]) & ~edge[1:]
    if same.any():
        head = np.flatnonzero(~same)
        k = np.diff(np.append(head, len(s)))
        name = s[head]
        long = k > 1
        name[long] = mix(name[long] * _RUN + k[long].astype(np.uint64))
        edge, at = edge[head], at[head]
        previous, following = lo[head[1:] - 1], hi[head[1:]]
    else:
        name, previous, following = s, lo[:-1], hi[1:]
    # that a run ends depends on the symbols beside it; a text's edge is beyond every window
    before, after = np.append(np.int32(-1), previous), np.append(following, _FAR)
    if len(s):
        before[edge] = -1
        after[:-1][edge[1:]] = _FAR
    return name, at, before, after, edge


def _name_pairs(s, at, lo, hi, edge, round_: int):
    """Name pairs of a left-half symbol and the right-half symbol after it."""
    right = (mix(s * _SIDE + U(round_)) & U(1)).astype(bool)
    pair = np.zeros(len(s), bool)
    pair[:-1] = ~right[:-1] & right[1:] & ~edge[1:]
    second = np.append(False, pair[:-1])[: len(s)]
    # a left-half symbol looks to the right, a right-half one to the left
    looks_left, looks_right = right.copy(), ~right
    new_lo, new_hi = lo.copy(), hi.copy()
    new_lo[1:][looks_left[1:]] = lo[:-1][looks_left[1:]]
    new_hi[:-1][looks_right[:-1]] = hi[1:][looks_right[:-1]]
    if len(s):
        new_lo[edge & looks_left] = -1
        ends = np.append(edge[1:], True)
        new_hi[ends & looks_right] = _FAR
    name = s.copy()
    two = np.flatnonzero(pair)
    name[two] = mix(mix(s[two] * _PAIR) + s[two + 1])
    keep = ~second
    return name[keep], at[keep], new_lo[keep], new_hi[keep], edge[keep]


class Level:
    """Symbols of a level: names, first words, and of those that can be interior to a window, number and span."""

    def __init__(self, name, at, lo, hi, n_words: int, width: int):
        self.name, self.at = name, at
        self.which = np.flatnonzero((lo >= 0) & (hi <= n_words) & (hi - lo <= width))
        # the next symbol of an interior one is of its text
        self.span = np.append(at, n_words)[self.which + 1] - at[self.which]
        # how many of these begin before a word, and how many end up to it: both rise from symbol to symbol
        self.begun = _below(lo[self.which], n_words)
        self.ended = np.append(_below(hi[self.which], n_words)[1:], len(self.which))
        self.place = _below(at, n_words)

    def interior(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places [a, b) in ``which`` of the interior symbols of each window; they are neighbours."""
        return self.begun[starts], self.ended[starts + width]


def _below(values: np.ndarray, n: int) -> np.ndarray:
    """For each k from 0 to n, how many of the values (0 to n) are smaller."""
    return np.cumsum(np.bincount(values + 1, minlength=n + 2)[: n + 1], dtype=np.int32)


def levels(words: Words, width: int, top: int) -> list[Level]:
    """Words, and the symbols after each of ``top`` rounds of naming."""
    at = np.arange(len(words), dtype=np.int32)
    edge = np.zeros(len(words), bool)
    edge[words.first[:-1][words.count > 0]] = True
    now = words.hash.copy(), at, at.copy(), at + 1, edge
    out = [Level(*now[:4], len(words), width)]
    for k in range(top):
        now = _name_pairs(*_name_runs(*now), k)
        out.append(Level(*now[:4], len(words), width))
    return out


def _leftmost_least(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of the leftmost minimum of order[a:b], from minima over 2**k places."""
    best, table, size, k = np.empty(len(a), np.int64), np.arange(len(order)), b - a, 0
    while True:
        mine = (size >> k) == 1
        if mine.any():
            x, y = table[a[mine]], table[b[mine] - (1 << k)]
            best[mine] = np.where(order[y] < order[x], y, x)
        if not (size >> (k + 1)).any():
            return best
        far = np.minimum(np.arange(len(table)) + (1 << k), len(table) - 1)
        table = np.where(order[table[far]] < order[table], table[far], table)
        k += 1


def all_windows(words: Words, width: int) -> np.ndarray:
    """First words of all windows of the batch."""
    n = np.maximum(words.count - width + 1, 0)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.first[:-1], n)


def representatives(words: Words, starts: np.ndarray, width: int, top: int):
    """Runs of windows with one representative: (name, first window, number of windows)."""
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts
    symbol, rank, name = np.full(len(starts), -1), np.full(len(starts), U(2**64 - 1)), np.zeros(len(starts), np.uint64)
    for k, x in reversed(list(enumerate(levels(words, width, top)))):
        a, b = x.interior(starts, width)
        # a word is shorter than what a higher level names
        at = np.flatnonzero((b > a) & (symbol < 0) if k == 0 else b > a)
        if not len(at):
            continue
        # the longest symbol first; equal ones by a hash of the name
        order = (U(width) - x.span.astype(np.uint64) << U(48)) | (mix(x.name[x.which] + _ORDER) >> U(16))
        place = _leftmost_least(order, a[at], b[at])
        better = order[place] < rank[at]
        at, place = at[better], place[better]
        symbol[at], rank[at], name[at] = x.at[x.which[place]], order[place], x.name[x.which[place]]
    # neighbours of one text with the same symbol are one run; every word is a symbol, so each window has one
    joined = np.append(False, (symbol[1:] == symbol[:-1]) & (name[1:] == name[:-1]) & (starts[1:] == starts[:-1] + 1))
    head = np.flatnonzero(~joined)
    return name[head], starts[head], np.diff(np.append(head, len(starts)))


def spellings(words: Words, starts: np.ndarray, width: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each window's symbols, level by level: those that no symbol of a higher level inside the window covers."""
    out = [np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)]
    if not len(starts):
        return out[0], out[1].astype(np.uint32)
    first, last = starts, starts + width  # symbols of the level below, inside the window
    below, *rest = levels(words, width, top)
    open_ = np.arange(len(starts))
    for k, x in enumerate([*rest, None]):
        if x is None:
            some = np.zeros(len(open_), bool)
        else:
            a, b = x.interior(starts[open_], width)
            some = b > a
        done, on = open_[~some], open_[some]
        for j, salt in enumerate((U(0), _SECOND)):
            names = mix(below.name + salt) if j else below.name
            out[j][done] = mix(out[j][done] * _RUN + ranges_hash(names, first[~some], last[~some]) + U(k))
            if len(on):
                i, e = x.which[a[some]], x.which[b[some] - 1] + 1
                begin = below.place[x.at[i]]
                end = np.where(e < len(x.at), below.place[x.at[np.minimum(e, len(x.at) - 1)]], len(below.at))
                out[j][on] = mix(out[j][on] * _RUN + ranges_hash(names, first[some], begin) * _LEFT + ranges_hash(names, end, last[some]) * _RIGHT + U(k))
        if not len(on):
            break
        first, last, below, open_ = i, e, x, on
    return out[0], out[1].astype(np.uint32)


_FIRST = [np.int64, np.uint32, np.int32, np.int16]
_SPELT = [np.uint64, np.uint32, np.int64, np.uint32, np.int32]
_RUNS = "doc_id long, runs array<struct<version:long,pack:binary>>"


def _versions(texts: list[bytes], twice) -> list[int]:
    """0, but where rows of different texts share a doc_id: 32 bits of the text."""
    return [zlib.crc32(t) if d else 0 for t, d in zip(texts, twice.to_pylist())]


def _own(runs, version: int) -> list[bytes]:
    return [r["pack"] for r in runs or [] if r["version"] == version]


def _rows(batches, width: int):
    """(words, texts' ids and versions, windows still looked at) of slices of a batch."""
    for batch in batches:
        live = "_runs" in batch.schema.names
        for texts, ids, twice, *runs in parts([batch], ["doc_id", "_twice", *["_runs"] * live], most=1 << 20):
            w = Words(texts)
            version = _versions(texts, twice)
            if live:
                each = [_windows_of(_own(r, v)) for r, v in zip(runs[0].to_pylist(), version)]
                starts = np.concatenate(each) + np.repeat(w.first[:-1], np.fromiter(map(len, each), np.int64, len(each)))
            else:
                starts = all_windows(w, width)
            yield w, ids.to_numpy(zero_copy_only=False), np.array(version, np.uint32), starts


def _emit_representatives(width: int, top: int, n_parts: int, most: int):
    """Packs of (name, doc, version, window, windows)."""

    def flush(rows):
        name, doc, version, at, n = (np.concatenate(x) for x in zip(*rows))
        return shared_packs(name, [doc, version, at.astype(np.int32), n.astype(np.int16)], n_parts)

    def run(batches):
        rows, held = [], 0
        for w, ids, version, starts in _rows(batches, width):
            name, start, n = representatives(w, starts, width, top)
            if not len(name):
                continue
            own = np.searchsorted(w.first, start, "right") - 1
            rows.append((name, ids[own], version[own], start - w.first[own], n))
            held += len(name)
            if held >= most:
                yield flush(rows)
                rows, held = [], 0
        if rows:
            yield flush(rows)

    return run


def _to_documents(doc, columns, n_parts: int):
    """Packs by document."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    return packed([doc, *[c[order] for c in columns]], (mix(doc.view(np.uint64)) % U(n_parts)).astype(np.int32))


def _by_document(kinds: list):
    """One row a document: its id and, for each version, the columns of ``kinds`` in the order of the first, packed."""

    def run(batches):
        for doc, version, *columns in by_part(batches, [np.int64, np.uint32, *kinds]):
            order = np.lexsort((columns[0], version, doc))
            doc, version, columns = doc[order], version[order], [c[order] for c in columns]
            other = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
            heads = np.flatnonzero(other | np.append(True, version[1:] != version[:-1])[: len(doc)])
            ends = np.append(heads[1:], len(doc))
            packs = [b"".join(c[x:y].tobytes() for c in columns) for x, y in zip(heads.tolist(), ends.tolist())]
            runs = pa.StructArray.from_arrays([pa.array(version[heads].astype(np.int64)), pa.array(packs, pa.binary())], names=["version", "pack"])
            first = np.flatnonzero(other[heads])
            yield pa.record_batch([pa.array(doc[heads[first]], pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(first, len(heads)), pa.int32()), runs)], names=["doc_id", "runs"])

    return run


def _shared(n_parts: int):
    """Runs of windows whose representative occurs more than once."""

    def run(batches):
        for doc, *columns in shared_rows(batches, _FIRST):
            yield _to_documents(doc, columns, n_parts)

    return run


def _windows_of(runs: list[bytes]) -> np.ndarray:
    """All windows of a document's runs, in order."""
    at, n = unpacked(runs, [np.int32, np.int16])
    if not len(at):
        return np.empty(0, np.int64)
    order = np.argsort(at, kind="stable")
    at, n = at[order].astype(np.int64), n[order].astype(np.int64)
    out = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
    # rows of equal text and id are one document, and say the same twice
    return out if (out[1:] > out[:-1]).all() else np.unique(out)


def _emit_spellings(width: int, top: int, n_parts: int, most: int):
    """(spelling, more of it, doc, version, window): of windows that a task holds twice, only the first leaves it."""

    def flush(rows):
        h, g, doc, version, at = _first_of(*(np.concatenate(x) for x in zip(*rows)))
        order = np.lexsort((at, version, doc))  # ids in order compress well
        return packed([c[order] for c in (h, g, doc, version, at.astype(np.int32))], (h[order] % U(n_parts)).astype(np.int32))

    def run(batches):
        rows, held = [], 0
        for w, ids, version, starts in _rows(batches, width):
            h, g = spellings(w, starts, width, top)
            own = np.searchsorted(w.first, starts, "right") - 1
            rows.append((h, g, ids[own], version[own], starts - w.first[own]))
            held += len(h)
            if held >= most:
                yield flush(rows)
                rows, held = [], 0
        if rows:
            yield flush(rows)

    return run


def _first_of(h, g, doc, version, at):
    order = np.lexsort((at, version, doc, g, h))
    columns = [c[order] for c in (h, g, doc, version, at)]
    h, g = columns[:2]
    new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))[: len(h)]
    return [c[new] for c in columns]


def _firsts(n_parts: int):
    """The first occurrence of each window."""

    def run(batches):
        for rows in by_part(batches, _SPELT):
            _, _, doc, version, at = _first_of(*rows)
            yield _to_documents(doc, [version, at], n_parts)

    return run


def _dealt(packs: DataFrame) -> DataFrame:
    """Each part's packs together."""
    return packs.repartition("part").sortWithinPartitions("part")


def _cover(n: int, runs: list[bytes], firsts: list[bytes], width: int) -> np.ndarray:
    """The words covered by windows that aren't first occurrences."""
    later = np.setdiff1d(_windows_of(runs), unpacked(firsts, [np.int32])[0].astype(np.int64), assume_unique=True)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, later, 1)
    np.add.at(step, later + width, -1)
    return np.cumsum(step[:-1]) > 0


def repeated_windows(docs: DataFrame, width: int = 20, rounds: tuple[int, ...] = ROUNDS, pack_rows: int = 1 << 19) -> DataFrame:
    """doc_id, _runs and _firsts: windows that may be repeated and, of these, the first occurrences, packed.

    ``docs`` has doc_id, text and _twice (its doc_id is that of several rows), none of the first two null.
    """
    spark = docs.sparkSession
    ship(spark)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    pack = "part int, pack binary"
    # no checkpoint between: all joins below read the one shuffle of the documents by doc_id
    runs, live = None, docs
    for top in rounds:
        packs = _dealt(live.mapInArrow(_emit_representatives(width, top, n_parts, pack_rows), pack)).mapInArrow(_shared(n_parts), pack)
        runs = _dealt(packs).mapInArrow(_by_document(_FIRST[2:]), _RUNS).withColumnRenamed("runs", "_runs")
        live = docs.join(runs, "doc_id")
    packs = _dealt(live.mapInArrow(_emit_spellings(width, rounds[-1], n_parts, pack_rows), pack)).mapInArrow(_firsts(n_parts), pack)
    return runs.join(_dealt(packs).mapInArrow(_by_document([np.int32]), _RUNS).withColumnRenamed("runs", "_firsts"), "doc_id", "left")


def substring_dedup(docs: DataFrame, width: int = 20, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """Remove the words of ``text`` covered by a run of ``width`` words that also starts earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``. Earlier is a smaller ``doc_id`` or an earlier start in the same
    document; runs are judged on the input. What stays keeps its own white space.

    Returns the rows and columns of ``docs`` with ``text`` changed, and ``n_words``, ``n_removed`` (long) and
    ``kept_sha256`` (of the kept words joined by one space), which replace columns of those names. Null text
    stays null with 0 words. Rows with a null ``doc_id`` come back unchanged. Rows of equal ``doc_id`` and text
    are one document; different texts of one ``doc_id`` are documents of their own, ordered by their crc32. A text of fewer than
    ``width`` words is left alone. ``rounds`` are the levels up to which each Spark round names symbols, and change the work,
    not the result. Windows are compared by 96 bits of hash.
    """
    ship(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "_runs", "_firsts", "_twice")
    names = docs.columns
    whole = docs.where("doc_id is not null and text is not null")
    often = whole.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id", F.lit(True).alias("_twice"))
    whole = whole.join(often, "doc_id", "left")
    found = repeated_windows(whole, width, rounds)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string").fields])

    def clean(batches):
        for batch in batches:
            column = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("text", "_twice", "_runs", "_firsts")]
            text, n_words, n_removed, digest = [], [], [], []
            for x, twice, runs, firsts in zip(*column):
                raw = (x or "").encode()
                words = raw.split()
                gone = 0
                version = zlib.crc32(raw) if twice else 0
                if mine := _own(runs, version):
                    covered = _cover(len(words), mine, _own(firsts, version), width)
                    gone = int(covered.sum())
                if gone:
                    w = Words([raw])
                    words = [words[i] for i in np.flatnonzero(~covered)]
                    edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
                    pieces, at = [], 0
                    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                        pieces.append(raw[at : w.start[a]])
                        at = w.start[b] if b < len(covered) else w.end[b - 1]
                    x = b"".join([*pieces, raw[at:]]).decode()
                text.append(x)
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            out = [pa.array(text, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names]
            out += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "n_words", "n_removed", "kept_sha256"])

    bare = docs.where("doc_id is null or text is null").withColumns({k: F.lit(None).cast("array<struct<version:bigint,pack:binary>>") for k in ("_runs", "_firsts")})
    return whole.join(found, "doc_id", "left").unionByName(bare, allowMissingColumns=True).mapInArrow(clean, schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: words, removed words and a digest of the kept ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(w[p:p + 19], ' ') ORDER BY doc_id, p) AS nth FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM k WHERE nth > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (
  SELECT x.doc_id, count(*) AS n_words, count(c.i) AS n_removed,
    string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
