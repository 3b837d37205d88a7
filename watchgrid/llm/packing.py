"""Packing of documents by the sum-of-squares rule.

Pieces of documents go to shards of about ``shard`` pieces by a hash, so tasks stay bounded at every size. A shard takes its
pieces from the longest to the shortest, keeps the number of open sequences of every residual gap, and puts each piece
where the sum of the squares of these numbers becomes smallest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.llm import byte_bpe
from watchgrid.llm.words import parts
from watchgrid.session import cut, ship

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

def pieces(docs: DataFrame, path: str | None = None, pattern: str | None = None, size: int = 2048) -> DataFrame:
    """Pieces of at most ``size`` ids: a document's ids, then id 0; of a longer one the first piece may be shorter.

    ``path`` and ``pattern`` are the vocabulary's ranks and pattern (by default the public ones). Null texts are empty (one piece: id 0). Each row of ``docs`` is a document, so a repeated ``doc_id`` gives repeated pieces.
    """
    ship(docs.sparkSession)

    def run(batches):
        bpe = byte_bpe.loaded(True, path, pattern=pattern)
        for texts, doc in parts(batches, ["doc_id"]):
            rows = []
            for d, text in zip(doc.to_pylist(), texts):
                ids = np.append(bpe.encode(text.decode()), 0).astype("<u4")
                first = len(ids) % size or size
                edges = [0, *range(min(first, len(ids)), len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def sum_of_squares(length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, gap left at the end of each sequence) by the sum-of-squares rule, in the given order."""
    count = np.zeros(size + 1, np.int64)  # open sequences by gap; full ones don't count
    of_gap: list[list[int]] = [[] for _ in range(size + 1)]
    gap: list[int] = []
    out = np.empty(len(length), np.int64)
    for i, s in enumerate(length.tolist()):
        # a change of gap from g to g - s adds 2 (count[g - s] - count[g]) + 2; to a full one, 1 - 2 count[g]
        change = 2 * (count[: size - s] - count[s:size]) + 2
        if len(change):
            change[0] = 1 - 2 * count[s]
            change[count[s:size] == 0] = np.iinfo(np.int64).max
            g = int(change.argmin())
            best = int(change[g])
        else:
            g, best = 0, np.iinfo(np.int64).max
        new = 2 * int(count[size - s]) + 1 if s < size else 0
        if best <= new and len(change) and count[g + s] > 0:
            b = of_gap[g + s].pop()
            count[g + s] -= 1
            left = g
        else:
            b, left = len(gap), size - s
            gap.append(left)
        gap[b] = left
        out[i] = b
        if left:
            count[left] += 1
            of_gap[left].append(b)
    return out, np.array(gap, np.int64)


def _shard(size: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "order", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        length = rows.length.to_numpy()
        to, _ = sum_of_squares(length, size)
        order = np.argsort(to, kind="stable")
        rows, to, length = rows.iloc[order], to[order], length[order]
        head = np.append(True, to[1:] != to[:-1])
        before = np.cumsum(length) - length
        rows = rows.assign(sequence_id=(rows["shard"].to_numpy().astype(np.int64) << 32) + to, offset=before - np.maximum.accumulate(np.where(head, before, 0)))
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, path: str | None = None, pattern: str | None = None, size: int = 2048, shard: int = 20_000) -> DataFrame:
    """Each piece (see ``pieces``) with ``sequence_id`` and ``offset``: gapless sequences of at most ``size`` ids.

    A piece of ``size`` ids is a sequence of its own. Null and empty texts are one piece (id 0). Each row is a document, so a
    repeated or null ``doc_id`` has the pieces of each of its rows. Pieces of one length go by a hash of the row, so ties
    are settled alike in each run over the same checkpoint. Empty ``docs`` give no rows; other columns are left out.
    """
    found = cut(pieces(docs, path, pattern, size))
    loose = found.where(F.col("length") < size)
    n = max(1, -(-loose.count() // shard))
    key = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    # copies share the key, so a random but repeatable part spreads them: their place in the checkpoint
    key = F.xxhash64(key, F.monotonically_increasing_id())
    loose = loose.withColumn("order", key).withColumn("shard", F.pmod("order", F.lit(n)).cast("int"))
    packed = loose.groupBy("shard").applyInPandas(_shard(size), _PIECE + ", sequence_id long, offset long")
    whole = found.where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Sequences of 2048 ids of the public byte-level vocabulary; nulls, ties and repeated rows as in ``pack``.

    The ids are those of ``byte_bpe_50k.json`` by tokenizers, which takes four times as long as the same vocabulary as ranks.
    """
    return pack(docs)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Per piece: its place in the sequences."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
