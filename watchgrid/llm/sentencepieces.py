"""Encoding and decoding with a merge-type piece vocabulary, by a score-ordered agenda of adjacent pairs.

No piece of such a vocabulary has a space mark after another character (this is checked when a model is read), so no
merge crosses from a word to the next space: each space-led word is encoded on its own, once while a task
remembers it, and compared with the library's ids for it.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from watchgrid.llm.words import parts
from watchgrid.session import ship

_MARK = "▁"
#: Bytes of words and ids that a worker remembers before it starts anew, at a slice's start; longer words are not remembered.
_REMEMBERED, _LONG = 256 << 20, 128


class Pieces:
    """A vocabulary read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        self.byte = [0] * 256
        self.id: dict[str, int] = {}
        for i, piece in enumerate(self.piece):
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece] = i
        # equal scores share a rank
        place = {x: k for k, x in enumerate(sorted({-sp.get_score(i) for i in self.id.values()}))}
        self.rank = {piece: place[-sp.get_score(i)] for piece, i in self.id.items()}
        inside = [p for p in self.id if _MARK in p.lstrip(_MARK)]
        if inside:
            raise ValueError(f"pieces with a space after another character: {inside[:3]}")
        self.words: dict[str, str] = {}
        self.held = 0
        self.split = re.compile(f"{_MARK}+[^{_MARK}]*|[^{_MARK}]+").findall

    def merge(self, word: str) -> list[int]:
        """Ids of a word: the adjacent pair of the best score is merged first, of ties the leftmost."""
        rank = self.rank.get
        symbol = list(word)
        n = len(symbol)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank and place in one number
        agenda = [(r << 32) + i for i, r in enumerate([rank(a + b) for a, b in zip(symbol, symbol[1:])]) if r is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & 0xFFFFFFFF
            j = right[i]
            # an entry is out of date if its place is gone or holds a pair of another rank by now
            if j >= n or symbol[i] is None:
                continue
            both = symbol[i] + symbol[j]
            if rank(both) != entry >> 32:
                continue
            symbol[i], symbol[j] = both, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                r = rank(both + symbol[k])
                if r is not None:
                    heappush(agenda, (r << 32) + i)
            h = left[i]
            if h >= 0:
                r = rank(symbol[h] + both)
                if r is not None:
                    heappush(agenda, (r << 32) + h)
        out = []
        for s in symbol:
            if s is not None:
                x = self.id.get(s)
                if x is None:
                    out.extend([self.byte[b] for b in s.encode()])
                else:
                    out.append(x)
        return out

    def learn(self, words: list[str]) -> dict[str, str]:
        """The ids of words, compared with the library in one call; those of short words are remembered."""
        ids = [self.merge(w) for w in words]
        # the library adds the first space itself
        led = [(w, x) for w, x in zip(words, ids) if w[0] == _MARK and len(w) > 1]
        for (w, own), its in zip(led, self.library.encode([w[1:] for w, _ in led], num_threads=1)):
            if own != its:
                raise ValueError(f"other ids than the library's for {w[:40]!r}")
        new = {w: ",".join(map(str, x)) for w, x in zip(words, ids)}
        short = {w: x for w, x in new.items() if len(w) <= _LONG}
        self.words.update(short)
        # a word's characters take up to four bytes each
        self.held += 4 * sum(map(len, short)) + sum(map(len, short.values())) + 150 * len(short)
        return new

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, joined by commas. An empty text has none."""
        if self.held >= _REMEMBERED:
            self.words, self.held = {}, 0
        split = [self.split(_MARK + t.replace(" ", _MARK)) if t else [] for t in texts]
        known = self.words
        new = self.learn(list({w for words in split for w in words if w not in known}))
        if max(map(len, new), default=0) > _LONG:
            known = known | new
        return [",".join([known[w] for w in words]) for words in split]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_LOADED: dict[str, Pieces] = {}


def _loaded(path: str) -> Pieces:
    """The vocabulary and its remembered words, kept by a worker from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """The rows and columns of ``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with
    ``keep_ids``, ``ids`` and ``decoded``; these replace columns of those names.

    ``path`` is the place of the vocabulary on every executor. A null text is encoded as an empty one: no ids,
    decoded to an empty text. Whole texts of any length are encoded; no begin or end ids are added.
    """
    ship(docs.sparkSession)
    new = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    docs = docs.drop(*new)
    names = docs.columns
    new = new if keep_ids else new[:3]
    more = T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string").fields[: len(new)]

    def run(batches):
        pieces = _loaded(path)
        for texts, *columns in parts(batches, names):
            n, digest, back_digest, all_ids, all_back = [], [], [], [], []
            for joined in pieces.encode([t.decode() for t in texts]):
                ids = list(map(int, joined.split(","))) if joined else []
                n.append(len(ids))
                digest.append(hashlib.sha256(joined.encode()).hexdigest())
                back = pieces.decode(ids)
                back_digest.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
                    all_back.append(back)
            out = [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back_digest, pa.string())]
            if keep_ids:
                out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_back, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *out], names=[*names, *new])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: number of ids, digests of the ids and of the decoded text."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
