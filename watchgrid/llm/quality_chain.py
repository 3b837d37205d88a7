"""Document quality by a linear-chain conditional random field over lines.

Each line has a hidden state, good or bad. Its features and its neighbours' give the state's weight, a table the weight
of two states in a row. Training lines take their document's label; a gradient climbs the conditional likelihood of a
bounded sample of whole documents. Forward-backward marginals, weighted by the lines' lengths, are averaged into a document's quality,
and a logistic fit makes that a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.llm.fitting import chance, fold, logistic, training_sample
from watchgrid.llm.words import SPACE, Words, parts, ranges_hash
from watchgrid.session import ship


def _table(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_CLASSES = [_table(b"#*$%&|<>"), _table(range(65, 91)), _table(b"!?"), _table(range(48, 58)), _table(b".,;:"), _table(range(128, 256)), SPACE]
_END = _table(b".!?\"'")
#: Features of a line; a line also takes those of the lines before and after it.
OWN = len(_CLASSES) + 9
WIDTH = 3 * OWN


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length, number of lines of each text). Lines without a word are left out; a text
    without a word has one line of no length."""
    texts = [t if t.strip() else b"" for t in texts]
    w = Words(texts)
    raw = np.frombuffer(w.blob, np.uint8)
    breaks = np.flatnonzero(raw == 10)
    start, end = np.append(0, breaks[:-1] + 1), breaks
    first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    owner = np.searchsorted(w.text_at, start, "right") - 1
    keep = (last > first) | ((w.count == 0)[owner] & (start == w.text_at[owner]))
    start, end, first, last, owner = (x[keep] for x in (start, end, first, last, owner))
    n, words = np.maximum(end - start, 1), last - first
    inside = np.zeros((len(start), OWN))
    for k, c in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(c[raw])])
        inside[:, k] = (total[end] - total[start]) / n
    k = len(_CLASSES)
    some = np.maximum(words, 1)
    inside[:, k] = np.log1p(words)
    inside[:, k + 1] = n / some / 10
    line_of = np.repeat(np.arange(len(start)), words)
    distinct = lambda group: np.bincount(np.unique(np.stack([group, w.hash.view(np.int64)]), axis=1)[0], minlength=1) if len(w) else np.zeros(1, int)
    own = np.zeros(len(start))
    found = distinct(line_of)
    own[: len(found)] = found[: len(own)]
    inside[:, k + 2] = own / some
    adjacent = np.concatenate([[0], np.cumsum(np.append(False, w.hash[1:] == w.hash[:-1]))]) if len(w) else np.zeros(1)
    inside[:, k + 3] = (adjacent[last] - adjacent[first]) / some
    inside[:, k + 4] = _END[raw[w.end[last - 1] - 1]] if len(w) else 0
    inside[:, k + 4] *= words > 0
    name = ranges_hash(w.hash, first, last) if len(w) else np.zeros(len(start), np.uint64)
    _, group, times = np.unique(np.stack([owner, name.view(np.int64)]), axis=1, return_inverse=True, return_counts=True)
    inside[:, k + 5] = (times[group.ravel()] > 1) & (words > 0)
    whole = w.owner()
    in_text = np.zeros(len(texts))
    found = distinct(whole)
    in_text[: len(found)] = found[: len(in_text)]
    inside[:, k + 6] = (in_text / np.maximum(w.count, 1))[owner]
    inside[:, k + 7] = np.log1p(w.count)[owner] / 5
    inside[:, k + 8] = words == 0
    lines = np.bincount(owner, minlength=len(texts))
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    same = owner[1:] == owner[:-1]
    before[1:][same], after[:-1][same] = inside[:-1][same], inside[1:][same]
    return np.hstack([inside, before, after]), (end - start).astype(float), lines


def marginals(score: np.ndarray, lines: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance of state 1 of each line, expected pairs of states over all chains), by forward-backward.

    ``score``: log weight of state 1 over state 0, chains one after another, of the lengths ``lines``.
    """
    order = np.argsort(-lines, kind="stable")
    begin = (np.cumsum(lines) - lines)[order]
    size = lines[order]
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # chains longer than t
    emit = np.stack([np.ones(len(score)), np.exp(np.clip(score, -30, 30))], 1)
    emit /= emit.sum(1, keepdims=True)
    step = np.exp(table - table.max())
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    for t in range(len(live)):
        at = begin[: live[t]] + t
        x = emit[at] * (ahead[at - 1] @ step if t else 1)
        ahead[at] = x / x.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(live) - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        nxt = emit[at + 1] * back[at + 1]
        x = nxt @ step.T
        joint = ahead[at][:, :, None] * step * nxt[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back[at] = x / x.sum(1, keepdims=True)
    p = ahead * back
    return p[:, 1] / p.sum(1), pairs


@dataclass
class Model:
    weights: np.ndarray  # of the features, and the constant
    table: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    scale: tuple = (1.0, 0.0)

    def lines(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.deviation, -6, 6) @ self.weights[:-1] + self.weights[-1]


def _climb(features, lines, y, ridge: float, steps: int) -> Model:
    """Weights by Adam steps on the conditional likelihood of chains whose lines all carry the label ``y``."""
    mean, deviation = features.mean(0), np.maximum(features.std(0), 1e-3)
    x = np.column_stack([np.clip((features - mean) / deviation, -6, 6), np.ones(len(features))])
    state = np.repeat(y, lines).astype(float)
    pairs = np.zeros((2, 2))
    for k in (0, 1):
        pairs[k, k] = np.maximum(lines[y == k] - 1, 0).sum()
    w = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p, expected = marginals(x @ w[:-4], lines, w[-4:].reshape(2, 2))
        g = np.append(x.T @ (state - p), (pairs - expected).ravel()) / len(x) - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.1 * 0.99 ** t * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(w[:-4], w[-4:].reshape(2, 2), mean, deviation)


def _means(model: Model, features, length, lines) -> np.ndarray:
    """Length-weighted marginals of each text, as log odds."""
    p, _ = marginals(model.lines(features), lines, model.table)
    owner = np.repeat(np.arange(len(lines)), lines)
    weight = length + 1
    p = np.bincount(owner, p * weight, len(lines)) / np.bincount(owner, weight, len(lines))
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, most_lines: int = 300_000, chain: int = 40, ridge: float = 1e-3, steps: int = 250) -> Model:
    """Learn from at most ``most`` labelled rows of the folds that may be learnt from, with at most ``most_lines`` lines together.

    The sample is bounded by whole rows, in the order of a hash of the id: a row whose lines don't fit into what is left of
    ``most_lines`` is passed over, and every line of a row in the sample is learnt from. If no row fits, the one of the fewest lines is the sample. Lines are cut
    into stretches of up to ``chain`` for the likelihood; the calibration runs over whole documents.
    """
    ship(docs.sparkSession)
    sample = training_sample(labels, "quality", fold(3) != 1, most)
    rows = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def count(batches):
        for texts, doc in parts(batches, ["doc_id"]):
            yield pa.RecordBatch.from_arrays([doc.cast(pa.int64()), pa.array(line_features(texts)[2].astype(np.int64))], names=["doc_id", "lines"])

    def features(batches):
        for texts, doc, y in parts(batches, ["doc_id", "y"]):
            f, n, lines = line_features(texts)
            ends = np.cumsum(lines)
            spans = [slice(e - k, e) for e, k in zip(ends.tolist(), lines.tolist())]
            columns = [doc.cast(pa.int64()), y.cast(pa.int32()), pa.array([f[x].astype(np.float32).tobytes() for x in spans], pa.binary()), pa.array([n[x].tobytes() for x in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "y", "f", "n"])

    # at most ``most`` numbers, to choose the rows before their features travel
    sizes = rows.mapInArrow(count, "doc_id long, lines long").groupBy("doc_id").agg(F.sum("lines").alias("lines")).withColumn("h", F.xxhash64("doc_id")).toPandas()
    sizes = sizes.sort_values(["h", "doc_id"], kind="stable")
    taken, left = [], most_lines
    for doc, n in zip(sizes.doc_id.tolist(), sizes.lines.tolist()):
        if n <= left:
            taken.append(doc)
            left -= n
    if not taken and len(sizes):
        taken = sizes.sort_values(["lines", "h", "doc_id"], kind="stable").doc_id.tolist()[:1]
    if not taken:
        return Model(np.zeros(WIDTH + 1), np.zeros((2, 2)), np.zeros(WIDTH), np.ones(WIDTH))
    chosen = docs.sparkSession.createDataFrame([(x,) for x in taken], "doc_id long")
    got = rows.join(F.broadcast(chosen), "doc_id").mapInArrow(features, "doc_id long, y int, f binary, n binary").toPandas()
    got = got.sort_values(["doc_id", "f"], kind="stable")
    f = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got.f]).astype(float)
    length = np.concatenate([np.frombuffer(b, float) for b in got.n])
    lines = got.n.map(len).to_numpy() // 8
    y = got.y.to_numpy()
    pieces = -(-lines // chain)
    stretch = np.full(int(pieces.sum()), chain)
    stretch[np.cumsum(pieces) - 1] = lines - (pieces - 1) * chain
    model = _climb(f, stretch, np.repeat(y, pieces), ridge, steps)
    model.scale = tuple(logistic(_means(model, f, length, lines)[:, None], y.astype(float), ridge=0.1))
    return model


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """The rows and columns of ``docs`` with ``score`` (0 to 1, higher is better) and ``n_lines`` (with a word), which
    replace columns of those names.

    Null, empty and blank texts count as one empty line. Lines are what ``\\n`` separates. Equal texts get equal scores.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score", "n_lines")
    names = docs.columns

    def run(batches):
        for texts, *columns in parts(batches, names, most=1 << 20):
            f, n, lines = line_features(texts)
            # adding up in another order would change last digits, so scores are rounded
            score = np.round(chance(_means(model, f, n, lines) * model.scale[0] + model.scale[1]), 9)
            words = np.array([bool(t.strip()) for t in texts])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array(np.where(words, lines, 0).astype(np.int64))], names=[*names, "score", "n_lines"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T._parse_datatype_string("score double, n_lines long").fields]))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Per document: fold, score and verdict at 0.5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
