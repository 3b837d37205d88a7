"""Alignment of two tokenizers' tokens over the bytes of each document.

A slice of documents is tokenized by both sides, and ``pandas.merge_asof``, keyed by document, finds for each token's start the covering
token of the other side, in both directions. A token that starts where its covering token starts begins a group: there both sides'
earlier tokens end together. All pairs of a group are linked.

What a link's count needs from other documents travels by distinct id pairs of a slice: pairs are counted by documents in their slice,
added up over all slices, and the sums go back, a packed row a slice, to be added up over each document's links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.llm import byte_bpe
from watchgrid.llm.words import parts
from watchgrid.session import cut, ship

_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_SLICE = "slice long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, groups array<string>, pair array<long>, n_docs array<long>, links binary"
_LOADED: dict = {}


class Sides:
    """Both vocabularies: ids of texts, the bytes of ids, and what ids look like in a text of groups."""

    def __init__(self, pieces: str):
        import sentencepiece

        self.a = byte_bpe.loaded(False)
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_token = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a.token, self.b_token))
        ends = {b"a": (b",", b"|"), b"b": (b",", b";")}
        self.shown = [b"%d%s" % (i, e) for n, side in ((len(self.a.token), b"a"), (len(self.b_token), b"b")) for i in range(n) for e in ends[side]]

    def encode(self, texts: list[bytes]) -> tuple[list, list]:
        """Ids of both sides; none where a side's bytes are not a space and the text."""
        whole = [t.decode() for t in texts]
        left = [self.a.encode(" " + t) if t else () for t in whole]
        right = self.b.encode(whole, num_threads=1)
        for k, (raw, x, y) in enumerate(zip(texts, left, right)):
            own = b" " + raw
            if not raw or b"".join(map(self.b_token.__getitem__, y)) != own or b"".join(map(self.a.token.__getitem__, x.tolist())) != own:
                left[k], right[k] = (), ()
        return left, right


def _loaded(pieces: str) -> Sides:
    """The vocabularies, kept by a worker from task to task."""
    if pieces not in _LOADED:
        _LOADED[pieces] = Sides(pieces)
    return _LOADED[pieces]


def covering(start: np.ndarray, doc: np.ndarray, other: np.ndarray, other_doc: np.ndarray) -> np.ndarray:
    """For each token start the place of the other side's token that covers it; both sides ascend by document and start."""
    left = pd.DataFrame({"at": start, "doc": doc})
    right = pd.DataFrame({"at": other, "doc": other_doc, "place": np.arange(len(other))})
    return pd.merge_asof(left, right, on="at", by="doc")["place"].to_numpy().astype(np.int64)


def overlaps(a_start, a_doc, b_start, b_doc) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of A, places of B) of all pairs of tokens that share a byte, and which tokens of A and of B begin a group."""
    to_b, to_a = covering(a_start, a_doc, b_start, b_doc), covering(b_start, b_doc, a_start, a_doc)
    begins_a, begins_b = b_start[to_b] == a_start, a_start[to_a] == b_start
    # two tokens share a byte if one starts in the other; those that start together are found in both directions
    rest = np.flatnonzero(~begins_b)
    return np.append(np.arange(len(to_b)), to_a[rest]), np.append(to_b, rest), begins_a, begins_b


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and how many each text has."""
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.concatenate([np.asarray(x, np.int64) for x in ids]) if len(ids) else np.empty(0, np.int64), count


def align_slice(sides: Sides, texts: list[bytes], keep: bool = False) -> dict:
    """The columns of a slice (see ``aligned``) for its texts."""
    left, right = sides.encode(texts)
    (a, n_a), (b, n_b) = _flat(left), _flat(right)
    docs = np.arange(len(texts))
    a_doc, b_doc = np.repeat(docs, n_a), np.repeat(docs, n_b)
    a_size, b_size = sides.a_size[a], sides.b_size[b]
    # both sides have the same bytes in each document, so offsets over the whole slice agree
    _, _, begins_a, begins_b = overlaps(np.cumsum(a_size) - a_size, a_doc, np.cumsum(b_size) - b_size, b_doc)
    a_group, b_group = np.cumsum(begins_a) - 1, np.cumsum(begins_b) - 1
    groups = int(begins_a.sum())
    a_count, b_count = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    group_doc = a_doc[begins_a]
    n_links = np.bincount(group_doc, a_count * b_count, len(texts)).astype(np.int64)
    # links: each A token with every B token of its group
    wide = b_count[a_group]
    of_a = np.repeat(np.arange(len(a)), wide)
    first = np.cumsum(b_count) - b_count
    of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(wide) - wide - first[a_group], wide)
    code, pair = pd.factorize(a[of_a] << 32 | b[of_b])
    held, times = np.unique(a_doc[of_a] * len(pair) + code, return_counts=True)
    held_doc, held_code = np.divmod(held, max(len(pair), 1))
    packed = np.concatenate([np.bincount(held_doc, minlength=len(texts)), held_code, times]).astype("<u4").tobytes()
    # the groups as text: the A tokens of a group, then its B tokens
    last_a, last_b = np.append(begins_a[1:], True)[: len(a)], np.append(begins_b[1:], True)[: len(b)]
    shown = np.empty(len(a) + len(b), np.int64)
    shown[np.arange(len(a)) + first[a_group]] = 2 * a + last_a
    shown[np.arange(len(b)) + np.cumsum(a_count)[b_group]] = 2 * (len(sides.a_size) + b) + last_b
    edges = np.append(0, np.cumsum(n_a + n_b)).tolist()
    digests, kept = [], []
    for x, y in zip(edges, edges[1:]):
        text = b"".join(map(sides.shown.__getitem__, shown[x:y].tolist()))[:-1]
        digests.append(hashlib.sha256(text).hexdigest() if text else "")
        if keep:
            kept.append(text.decode())
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(group_doc, minlength=len(texts)), "n_links": n_links, "groups_sha256": digests,
        "groups": kept, "pair": pair, "n_docs": np.bincount(held_code, minlength=len(pair)), "links": zstandard.compress(packed, 1),
    }


def aligned(docs: DataFrame, pieces: str, keep: bool = False, most: int = 2 << 20) -> DataFrame:
    """One row a slice of about ``most`` bytes of text: its documents, their numbers and digests, with ``keep`` their groups as text,
    the distinct linked id pairs (A id << 32 | B id) with the slice's documents that hold them, and which pairs each document holds how often."""
    ship(docs.sparkSession)
    numbers = ["pair", "n_docs", *_NUMBERS]

    def run(batches):
        sides, task, k = _loaded(pieces), TaskContext.get().partitionId(), 0
        for texts, doc in parts(batches, ["doc_id"], most=most):
            found = align_slice(sides, texts, keep)
            one = {c: pa.array([np.asarray(found[c], np.int64)], pa.list_(pa.int64())) for c in numbers}
            one |= {c: pa.array([found[c]], pa.list_(pa.string())) for c in ("groups_sha256", "groups")}
            one |= {"slice": pa.array([(task << 32) + k], pa.int64()), "doc_id": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), doc.cast(pa.int64())), "links": pa.array([found["links"]])}
            order = [x.split()[0] for x in _SLICE.split(", ")]
            yield pa.RecordBatch.from_arrays([one[c] for c in order], names=order)
            k += 1

    return docs.select("doc_id", "text").mapInArrow(run, _SLICE)


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair, n, best: in how many documents of all slices a pair is linked, and whether no pair of its A id is in more."""
    pairs = slices.select(F.explode(F.arrays_zip("pair", "n_docs")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.n_docs").alias("n"))
    pairs = pairs.withColumn("a", F.shiftright("pair", 32))
    # of an A id there are as many pairs as the other vocabulary has ids, at most
    top = pairs.groupBy("a").agg(F.max("n").alias("top"))
    return pairs.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, pieces: str, keep: bool = False) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with ``keep``, ``groups``.

    A side: space and text by the byte-level vocabulary. B side: text by the piece vocabulary in ``pieces``, which adds the space. Byte
    offsets where tokens of both sides end cut them into groups; the pairs of a group are its links. A pair's count is the number of
    documents that hold it linked; ``n_best`` counts links whose pair has the highest count of its A id, ties included; ``count_sum`` adds up
    counts over links. Null and empty texts, and those whose tokens' bytes aren't space and text, have no tokens: zeros and
    an empty digest. Rows that repeat a doc_id or a text are documents of their own and count as such. An empty table gives no rows.
    Other columns are left out.
    """
    slices = cut(aligned(docs, pieces, keep))
    counts = cut(pair_counts(slices))
    asked = slices.select("slice", F.posexplode("pair").alias("code", "pair"))
    told = asked.join(counts, "pair").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("code", "n", "best"))).alias("told"))
    told = told.select("slice", F.col("told.n").alias("count"), F.col("told.best").alias("best"))
    columns = ["doc_id", *_NUMBERS, "groups_sha256", *(["groups"] if keep else [])]
    whole = slices.select("slice", *columns, "links").join(told, "slice", "left").drop("slice")
    schema = ", ".join(f"{c} {'string' if c.startswith('groups') else 'long'}" for c in [*columns, "n_best", "count_sum"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)}
                n = len(row["doc_id"].values)
                got = np.frombuffer(zstandard.decompress(row["links"].as_py()), "<u4").astype(np.int64)
                held = got[:n]
                code, times = np.split(got[n:], 2)
                owner = np.repeat(np.arange(n), held)
                count, best = (row[c].values.to_numpy(zero_copy_only=False).astype(np.int64) if row[c].is_valid else np.empty(0, np.int64) for c in ("count", "best"))
                sums = [np.zeros(n, np.int64) for _ in range(2)]
                np.add.at(sums[0], owner, times * best[code])
                np.add.at(sums[1], owner, times * count[code])
                yield pa.RecordBatch.from_arrays([*[row[c].values for c in columns], *map(pa.array, sums)], names=[*columns, "n_best", "count_sum"])

    return whole.mapInArrow(run, schema)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Per document: tokens of both sides, groups, links and what their pairs count in the whole table."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return alignment(docs, public_tokenizers.path("piece_bpe_32k.model"))
