"""Phrase collocations by SON partitioning.

Documents are dealt to a fixed number of shards by a hash. A phrase that occurs ``support`` times in all occurs at least
ceil(support / shards) times in some shard, so each shard is mined completely, from one word up to four, at that local support. The
union of the locally frequent phrases, less those whose local counts cannot add up to ``support``, are the candidates; these are then
counted over all documents, by their own words. Shards are groups of rows in Spark's shuffles, of any size.

Mining works on 64-bit names of phrases: tasks count names in slices of text, a name's counts meet by shard. A phrase is only looked at if both
its longest parts are candidates by then, as a Bloom filter of a fixed size says; a wrong yes, or two phrases of one name, only add candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.llm.words import Words, mix, parts, ranges_hash
from watchgrid.session import cut, ship

U = np.uint64
# Bytes that end a piece, and bytes between words.
_ENDS = [*b".,;:!?", *range(0x0A, 0x0E)]
_GAPS = [0x20, 0x09]
_BREAK = np.zeros(256, bool)
_BREAK[_ENDS] = True
_SEPARATES = _BREAK.copy()
_SEPARATES[_GAPS] = True

#: Bits of a filter: it is broadcast, and its words go through the driver, so this bounds both (8 MB).
BITS = 1 << 26
_PROBES = 3
#: Names that a task holds before it counts them.
_HELD = 1 << 22
#: Bytes of text that a task holds of a language before it counts and spells its phrases; of all languages four times as many.
_TEXT = 1 << 21
#: Bytes of phrases that are spelt at once.
_SPELT = 1 << 21


def _language(lang: str) -> np.uint64:
    """A number for each language, mixed into the names of its phrases."""
    return U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _position(names: np.ndarray, k: int) -> np.ndarray:
    return mix(names + U(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) >> U(64 - (BITS.bit_length() - 1))


def _holds(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names the filter may hold; what one probe rules out isn't probed again."""
    left = np.arange(len(names))
    for k in range(_PROBES):
        at = _position(names[left], k)
        left = left[(bits[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)]
    found = np.zeros(len(names), bool)
    found[left] = True
    return found


def name_filter(names: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``name``: its set words, at most ``BITS`` / 64, meet on the driver."""

    def run(batches):
        for b in batches:
            at = np.unique(np.concatenate([_position(b.column(0).to_numpy().view(np.uint64), k) for k in range(_PROBES)]))
            word = (at >> U(6)).astype(np.int64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            bit = np.bitwise_or.reduceat(U(1) << (at & U(63)), first) if len(first) else at
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(bit.view(np.int64))], names=["word", "bit"])

    found = names.select("name").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return bits


class _Slice:
    """The words of some texts of one language; ``at(k)`` are the places where k words of one piece stand together."""

    def __init__(self, texts: list[bytes], lang: str):
        self.words = Words([t.lower() for t in texts], _SEPARATES)
        raw = np.frombuffer(self.words.blob, np.uint8)
        self.piece = np.searchsorted(np.flatnonzero(_BREAK[raw]), self.words.start)
        self.lang = _language(lang)

    def at(self, k: int) -> np.ndarray:
        n = max(0, len(self.words) - k + 1)
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 : k - 1 + n])

    def names(self, at: np.ndarray, k: int) -> np.ndarray:
        return mix(ranges_hash(self.words.hash, at, at + k) ^ self.lang)

    def candidates(self, k: int, bits: np.ndarray | None) -> np.ndarray:
        """Places of k words both of whose parts of k - 1 words may be candidates."""
        at = self.at(k)
        if bits is None or not len(at):
            return at
        known = np.zeros(len(self.words), bool)
        known[at] = known[at + 1] = True
        places = np.flatnonzero(known)
        known[places] = _holds(bits, self.names(places, k - 1))
        return at[known[at] & known[at + 1]]

    def spelt(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words at some places, their words joined by one space."""
        word = (at[:, None] + np.arange(k)).ravel()
        # a word and, but for a phrase's last, the byte after it
        size = self.words.end[word] - self.words.start[word] + 1
        size[k - 1 :: k] -= 1
        end = np.cumsum(size)
        raw = np.frombuffer(self.words.blob, np.uint8)[np.repeat(self.words.start[word] - end + size, size) + np.arange(size.sum())]
        gap = end - 1
        raw[np.delete(gap, np.s_[k - 1 :: k])] = 0x20
        offsets = np.append(0, end[k - 1 :: k]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.string())


def _told(lang: str, k: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.repeat(pa.scalar(lang), len(n)), pa.repeat(pa.scalar(k, pa.int32()), len(n)), phrases, pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "k", "phrase", "n"])


def _by_language(batches):
    """Texts of one language, about ``_TEXT`` bytes of them where there are as many: (language, texts)."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for texts, lang in parts(batches, ["lang"]):
        for text, x in zip(texts, lang.to_pylist()):
            held.setdefault(x, []).append(text)
            size[x] = size.get(x, 0) + len(text) + 1
            if size[x] >= _TEXT:
                yield x, held.pop(x)
                del size[x]
        if sum(size.values()) >= 4 * _TEXT:
            yield from held.items()
            held, size = {}, {}
    yield from held.items()


def _slices(batches):
    """Texts of one shard and language: (shard, language, texts)."""
    for texts, lang, shard in parts(batches, ["lang", "shard"]):
        of: dict[tuple, list[bytes]] = {}
        for text, *key in zip(texts, shard.to_pylist(), lang.to_pylist()):
            of.setdefault(tuple(key), []).append(text)
        for (s, x), some in of.items():
            yield s, x, some


def _mine(rows: DataFrame, k: int, bits, shards: int, support: int) -> DataFrame:
    """Names of phrases of ``k`` words that the shards' counts leave as candidates."""
    local = -(-support // shards)
    share = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def counted():
            for shard in sorted({s for s, _ in held}):
                names, n = np.unique(np.concatenate([x for s, x in held if s == shard]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.full(len(names), shard, np.int32)), pa.array(n.astype(np.int64))], names=["name", "shard", "n"])

        for shard, lang, texts in _slices(batches):
            part = _Slice(texts, lang)
            names = part.names(part.candidates(k, share.value), k)
            held.append((shard, names))
            size += len(names)
            if size >= _HELD:
                yield from counted()
                held, size = [], 0
        yield from counted()

    counts = rows.mapInArrow(run, "name long, shard int, n long")
    # tasks have counted already: rows go by name at once, and both groupings use that placing
    placed = counts.repartition("name")
    frequent = placed.groupBy("name", "shard").agg(F.sum("n").alias("n")).where(F.col("n") >= local)
    # a shard in which a phrase isn't frequent adds local - 1 at most
    most = F.sum("n") + (shards - F.count("*")) * (local - 1)
    return frequent.groupBy("name").agg(most.alias("most")).where(F.col("most") >= support).select("name")


def _count(rows: DataFrame, bits: list[np.ndarray], longest: int) -> DataFrame:
    """lang, k, phrase, n: the counts of phrases that the filters hold, and of all words as k = 0."""
    share = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for lang, texts in _by_language(batches):
            part = _Slice(texts, lang)
            yield _told(lang, 0, pa.array([""]), np.array([len(part.words)]))
            # a second name, of other mixing, tells phrases of one name apart
            other = mix(part.words.hash)
            for k in range(1, longest + 1):
                at = part.at(k)
                names = part.names(at, k)
                keep = _holds(share.value[k - 1], names)
                order = np.argsort(names[keep])
                at, names = at[keep][order], names[keep][order]
                second = ranges_hash(other, at, at + k)
                # two phrases of one name may take turns here: equal ones meet by their words
                edge = np.flatnonzero((np.diff(names, prepend=U(0)) != 0) | (np.diff(second, prepend=U(0)) != 0) | (np.arange(len(at)) == 0))
                n, first = np.diff(np.append(edge, len(at))), at[edge]
                size = np.cumsum(part.words.end[first + k - 1] - part.words.start[first])
                cuts = np.flatnonzero(np.diff(size // _SPELT)) + 1
                for some, of in zip(np.split(first, cuts), np.split(n, cuts)):
                    if len(some):
                        yield _told(lang, k, part.spelt(some, k), of)

    counts = rows.mapInArrow(run, "lang string, k int, phrase string, n long")
    return counts.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, support: int = 30, shards: int = 8, longest: int = 4) -> DataFrame:
    """lang, k, phrase, n: all phrases of 1 to ``longest`` words with ``n`` >= ``support`` occurrences in their language, and a row of
    k = 0 and an empty phrase with the number of all words of each language.

    A-Z are lower-cased; texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``; a phrase stands within one
    piece and is named by its words with single spaces. Null texts are empty, a null ``lang`` is ``und``. Each row counts, repeated or not.
    An empty table gives no rows. Columns other than ``text``, ``lang`` and ``doc_id`` are left out.
    """
    ship(docs.sparkSession)
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"), shard.alias("shard"))
    bits: list[np.ndarray] = []
    for k in range(1, longest + 1):
        bits.append(name_filter(_mine(rows, k, bits[-1] if bits else None, shards, support)))
    return _count(rows, bits, longest).where((F.col("n") >= support) | (F.col("k") == 0))


def _part(first, n) -> F.Column:
    """``n`` words from word ``first`` (from 1) of the phrase."""
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def collocations(docs: DataFrame, support: int = 30, most: int = 2000, within: int = 80, shards: int = 8, longest: int = 4) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases of 2 to ``longest`` words.

    ``a`` is a phrase's count, ``n`` the language's words. A cut after its first words gives ``l`` and ``r``, the counts of both parts, and
    the score floor(2000000 a / (l + r)); the cut of the lowest score counts, the earliest of equal ones. A phrase goes
    if it stands in a longer candidate whose count is ``within`` per cent of its own or more. Order: score and ``a`` from the largest, then the
    phrase by its bytes. Texts, nulls and repeated rows as in ``phrase_counts``; an empty table gives no rows.
    """
    counts = cut(phrase_counts(docs, support, shards, longest))
    phrases = counts.where("k >= 2").withColumnRenamed("n", "a")
    parts_ = counts.where("k >= 1").select("lang", "phrase", "n")
    cuts = phrases.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "c", _part(F.lit(1), F.col("c")).alias("left"), _part(F.col("c") + 1, F.col("k") - F.col("c")).alias("right")
    )
    left, right = parts_.toDF("lang", "left", "l"), parts_.toDF("lang", "right", "r")
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    wide = F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)")
    both = both.select("lang", "phrase", "a", "c", "l", "r", wide.alias("top"), (F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")).alias("sum"))
    scored = both.withColumn("score", F.expr("top div sum")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "c", "l", "r", "a")).alias("x"))
    scored = scored.select("lang", "phrase", "x.score", "x.l", "x.r", "x.a")
    # the largest count of a longer candidate around each phrase
    inner = phrases.where("k >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    around = inner.select("lang", _part(F.col("i"), F.col("m")).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {within} * a")
    # first in parts of a language, so that no task gets all of its phrases
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    deal = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    few = deal.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= most)
    words = counts.where("k = 0").select("lang", "n")
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k >= 2),
cuts AS (
  SELECT lang, phrase, a, ws, k, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(ws[1:cut], ' ')
    JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
m AS (SELECT lang, ws, a, k, unnest(range(2, k)) AS m FROM c WHERE k >= 3),
i AS (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM m),
around AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM i GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  score::BIGINT AS score
FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
