"""Token ids in ORC files: stripes of run-length encoded integers, row indexes, and Bloom filters on document ids.

Documents go to shards by ranges of their ids, so files and the rows in them ascend by ``doc_id``. A row holds its shard and the
number of ids before it in the shard, which the task that writes the shard counts as it goes; the number of ids before a shard is
the sum over the earlier shards, read from a narrow column alone. Readers take stripes side by side, and a filter on ``doc_id``
skips files, stripes and row groups by their metadata.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm.words import parts
from watchgrid.session import shared_folder, ship

SCHEMA = "doc_id long, shard int, start long, n_tokens long, ids array<int>"
#: Letters and one of these marks after them are two words of the vocabulary.
_MARKS = ".,;:!?"
#: Bytes of chunks and ids that a worker remembers before it starts anew, at a slice's start; longer chunks are not remembered.
_REMEMBERED, _LONG = 160 << 20, 64
#: Letters in lower case that are composed, and that no step before the merges changes.
_LATIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


class WordIds:
    """Ids of texts by the library, chunk by chunk; a chunk is what ASCII white space separates.

    The vocabulary drops white space and none of its words, special ones included, holds any, so chunks are encoded on their own, once while
    a worker remembers them. A mark after letters is a word of its own, and Latin letters count as lower case. Letters go to the library together: each
    word of letters ends with one id of a word's end; if there are more or fewer of these than words, each goes alone.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # the same words without the steps that leave Latin letters in lower case as they are
        steps = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        plain = json.loads(self.library.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.marks = dict(zip([m.encode() for m in _MARKS], self._alone(list(_MARKS))))
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _alone(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _together(self, library, words: list[str]) -> list[bytes]:
        ids = np.array(library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._alone(words)
        raw, edges = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(edges, edges[1:])]

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks, of which the short ones are remembered."""
        known, marks, latin = self.known, self.marks, _LATIN
        made, words, ends, other = [], [], [], []  # flat lists: nothing here for the collector of cycles to walk through
        for c in chunks:
            end = marks.get(c[-1:], b"")
            word = c[:-1] if end else c
            if word.isalpha():
                word = word.lower()
            else:
                letters = word.decode()
                low = letters.lower()
                if latin(low):
                    word = low.encode()
                # composing and lower case may turn a letter into one and a mark, which a mark after it would join
                elif not (letters.isalpha() and unicodedata.normalize("NFC", letters).lower().isalpha()):
                    other.append(c)
                    continue
            made.append(c)
            words.append(word)
            ends.append(end)
        ids: dict[bytes, bytes] = {}
        unknown = [w.decode() for w in set(words).difference(known)]
        for wanted, library in ((True, self.plain), (False, self.library)):
            some = [w for w in unknown if bool(latin(w)) == wanted]
            ids.update(zip([w.encode() for w in some], self._together(library, some)))
        new = {c: (ids[w] if w in ids else known[w]) + end for c, w, end in zip(made, words, ends)}
        new.update(zip(other, self._alone([c.decode() for c in other])))
        short = {k: v for k, v in new.items() if len(k) <= _LONG}
        known.update(short)
        self.held += sum(map(len, short)) + sum(map(len, short.values())) + 150 * len(short)
        return new

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if self.held > _REMEMBERED:
            self.known, self.held = {}, 0
        split = [t.split() for t in texts]
        new = self.learn(set().union(*split).difference(self.known))
        known = self.known | new if max(map(len, new), default=0) > _LONG else self.known
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


_LOADED: dict[str, WordIds] = {}


def _loaded(path: str) -> WordIds:
    """The vocabulary and its remembered chunks, kept by a worker from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def write_ids(docs: DataFrame, target: str, vocabulary: str, end: int = 1, shards: int | None = None, stripe: int = 64 << 20, stride: int = 1000) -> None:
    """Write the ids of each document and ``end`` to ORC files in the folder ``target``, in ascending ``doc_id`` order.

    A null or empty text has ``end`` alone. Null ids come first. Rows that repeat a ``doc_id`` are documents of their own, ordered by a
    hash of the text; they may lie in several files. An empty table gives files without rows. Other columns are left out. ``shards`` is
    the number of ranges (by default that of shuffle partitions): a task holds one slice of a shard at a time. ``stripe`` is the size
    of a stripe, ``stride`` the rows of an index entry, each with a Bloom filter of its own.
    """
    spark = docs.sparkSession
    ship(spark)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # copies of one row, however many, are dealt to several ranges by their place in the input
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("version"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "version", "place"]
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        shard, before, words = TaskContext.get().partitionId(), 0, _loaded(vocabulary)
        for texts, doc in parts(batches, ["doc_id"]):
            ids = [x + last for x in words.encode(texts)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            edges = np.append(0, np.cumsum(sizes))
            values = np.frombuffer(b"".join(ids), "<i4")
            columns = [doc.cast(pa.int64()), pa.array(np.full(len(ids), shard, np.int32)), pa.array(before + edges[:-1]), pa.array(sizes), pa.ListArray.from_arrays(edges.astype(np.int32), values)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "start", "n_tokens", "ids"])
            before += int(edges[-1])

    rows = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, SCHEMA)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(stripe), "orc.row.index.stride": str(stride), "compression": "zstd"}
    rows.write.options(**options).orc(target)


def read_ids(spark: SparkSession, source: str) -> DataFrame:
    """The rows of ``write_ids``, with ``start`` as the number of ids of all documents before.

    One row a shard goes through the driver. A filter on ``doc_id`` reaches the files' metadata.
    """
    rows = spark.read.schema(SCHEMA).orc(source)
    base, before = [], 0
    for r in sorted(rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()):
        base.append((r.shard, before))
        before += r.n
    starts = spark.createDataFrame(base, "shard int, base long")
    return rows.join(F.broadcast(starts), "shard").select("doc_id", "shard", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers, from rows of ``read_ids``."""
    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column(2)
            edges = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(edges).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op12_orc_ids(spark, sf_dir: str) -> DataFrame:
    """Per document, from the files: ids before it, its ids and their checksum."""
    import public_tokenizers

    target = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_ids(docs, target, public_tokenizers.path("word_bpe_49k.json"))
    return checksums(read_ids(spark, target))
