"""Toxic passages as maximum-scoring segments of token log-odds.

A token's log-odds of toxic against clean documents (contexts, told apart by the token before) carry a Dirichlet prior of the whole corpus's counts, and count
only where they are ``z_least`` standard errors above zero. Every token also pays ``drift``, so a random text's score
falls. One linear scan finds all maximal scoring segments. With ``lambda``, the root of E[exp(lambda s)] = 1 under the
corpus's token distribution, ``lambda S - ln(K n)`` of the best segment follows the extreme-value (Gumbel) law in clean
texts; ``K`` is fitted there, and the evidence -ln P(larger) of the best segment and of all significant segments
together becomes a probability by a logistic fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.llm.fitting import chance, fold, logistic, training_sample
from watchgrid.llm.words import MARKS, U, Words, parts
from watchgrid.session import cut, ship

#: Numbers of characters of a word's beginnings that are tokens too.
_BEGINNINGS = range(4, 10)


@dataclass
class Model:
    """Token hashes (sorted), their scores, and the calibration."""

    token: np.ndarray
    score: np.ndarray
    drift: float
    lam: float = 1.0
    log_k: float = 0.0
    significant: float = 3.0
    weights: tuple = (0.0, 0.0, -2.0)


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in order, in linear time.

    ``score`` belongs to the tokens ``at``; all others score ``-drift``, so only runs between the given ones count.
    """
    stack: list[list] = []  # first, last, total before, total with
    back: list[int] = []  # the nearest candidate to the left whose total before is smaller
    total, last = 0.0, -1
    for i, s in zip(at.tolist(), score.tolist()):
        total -= drift * (i - last - 1)
        last = i
        before, total = total, total + s
        if s <= 0:
            continue
        item = [i, i, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j = back[j]
            if j < 0 or stack[j][3] >= item[3]:
                stack.append(item)
                back.append(j)
                break
            item = [stack[j][0], item[1], stack[j][2], item[3]]
            del stack[j:], back[j:]
    return [(a, b, r - l) for a, b, l, r in stack]


def _tokens(w: Words) -> list[np.ndarray]:
    """A word's tokens: the word, then its first 4 to 9 characters where it is longer (0 where not)."""
    out = [w.hash]
    for which, found in w.beginnings(_BEGINNINGS):
        h = np.zeros(len(w), np.uint64)
        h[which] = found
        out.append(h)
    return out


def _scan(model: Model, texts: list[bytes]):
    """Per text: number of tokens and segments."""
    w = Words([t.lower() for t in texts], MARKS)
    score = np.full(len(w), -np.inf)
    if len(model.token):
        for h in _tokens(w):
            at = np.minimum(np.searchsorted(model.token, h), len(model.token) - 1)
            np.maximum(score, model.score[at], out=score, where=model.token[at] == h)
    known = np.flatnonzero(score > -np.inf)
    cuts = np.searchsorted(known, w.first)
    for k, n in enumerate(w.count.tolist()):
        mine = known[cuts[k] : cuts[k + 1]]
        yield n, segments(mine - w.first[k], score[mine], model.drift) if len(mine) else []


def _evidence(model: Model, n: int, found: list) -> tuple[float, float, list]:
    """-ln P of the best segment, the sum over significant ones, and those."""
    best, together, kept = 0.0, 0.0, []
    for a, b, s in found:
        u = model.lam * s - math.log(n + 1) - model.log_k
        # P(larger) = 1 - exp(-exp(-u))
        e = u if u > 30 else -math.log(max(-math.expm1(-math.exp(-max(u, -30.0))), 1e-300))
        best = max(best, e)
        if e >= model.significant:
            together += e
            kept.append((a, b, e))
    return best, together, kept


def _contexts(batches):
    """(token, the token before it, in a toxic document, in a clean one), each once per slice."""
    for texts, y in parts(batches, ["y"]):
        w = Words([t.lower() for t in texts], MARKS)
        before = np.append(U(0), w.hash[:-1])[: len(w)]
        before[w.first[:-1][w.count > 0]] = 0
        toxic = y.to_numpy(zero_copy_only=False).astype(np.int64)[w.owner()]
        rows = np.concatenate([np.stack([h.view(np.int64), before.view(np.int64), toxic])[:, h != 0] for h in _tokens(w)], axis=1)
        rows = rows[:, np.lexsort(rows)]
        rows = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))] if rows.shape[1] else rows
        yield pa.record_batch([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2]), pa.array(1 - rows[2])], names=["token", "before", "t", "c"])


def _occurrences(tokens: np.ndarray):
    """(token, occurrences, words, tokens): the last two only in the row of token 0."""

    def run(batches):
        n, words, every = np.zeros(len(tokens), np.int64), 0, 0
        for (texts,) in parts(batches, []):
            w = Words([t.lower() for t in texts], MARKS)
            words += len(w)
            for h in _tokens(w):
                every += int(np.count_nonzero(h))
                at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                n += np.bincount(at[tokens[at] == h], minlength=len(tokens))
        none = np.zeros(len(tokens), np.int64)
        yield pa.record_batch([pa.array(np.append(tokens.view(np.int64), 0)), pa.array(np.append(n, 0)), pa.array(np.append(none, words)), pa.array(np.append(none, every))], names=["token", "n", "words", "every"])

    return run


def _root(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(x s) = 1; s has a negative mean and a positive value."""
    low, high = 1e-6, 1.0
    f = lambda x: float(p @ np.exp(np.minimum(x * s, 600.0))) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, most: int = 20000, least: int = 3, prior: float = 500.0, z_least: float = 3.5, drift: float = 0.5) -> Model:
    """Learn from at most ``most`` labelled rows of the folds that may be learnt from.

    Every token with ``least`` toxic contexts in them, and relatively more of these than clean ones, is weighed; how many reach the driver
    is bounded by the sample. The Dirichlet prior has a mass of ``prior`` spread as the tokens of all documents and half a
    context for each token of the sample. Corpus counts and the token distribution behind ``lambda`` are of all documents.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    sample = training_sample(labels, "toxic", fold(4) != 2, most)
    rows = cut(docs.join(F.broadcast(sample), "doc_id"))
    # a token counts once in each context, so copies of a document don't speak for its rare words
    contexts = rows.mapInArrow(_contexts, "token long, before long, t long, c long").groupBy("token", "before").agg(F.max("t").alias("t"), F.max("c").alias("c"))
    counts = cut(contexts.groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    n_t, n_c, kinds = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where((F.col("t") >= least) & (F.col("t") * F.lit(n_c) > F.col("c") * F.lit(n_t))).toPandas()
    token = top.token.to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    token, t, c = token[order], top.t.to_numpy(float)[order], top.c.to_numpy(float)[order]
    if not len(token):
        return Model(token, np.empty(0), drift)
    seen = docs.select("text").mapInArrow(_occurrences(token), "token long, n long, words long, every long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "words", "every")]).toPandas()
    words, every = (max(float(seen[c].max()), 1.0) for c in ("words", "every"))
    of = dict(zip(seen.token.tolist(), seen.n.tolist()))
    n = np.array([of.get(x, 0) for x in token.view(np.int64).tolist()], float)
    a, mass = prior * n / every + 0.5, prior + 0.5 * kinds
    odds = np.log((t + a) / (n_t + mass - t - a)) - np.log((c + a) / (n_c + mass - c - a))
    strong = odds / np.sqrt(1 / (t + a) + 1 / (c + a)) >= z_least
    token, score, p = token[strong], odds[strong] - drift, n[strong] / words
    model = Model(token, score, drift)
    if not (score > 0).any():
        return model
    model.lam = _root(np.append(p, max(1 - p.sum(), 0.0)), np.append(score, -drift))
    # clean texts have K n exp(-lambda s) segments of score s or more; taken at the smallest score that is strong
    weakest = float(score[score > 0].min())
    n, above = rows.where("y = 0").mapInArrow(_above(model, weakest), "n long, above long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("above"), F.lit(0))).first()
    model.log_k = math.log((above + 0.5) / (n + 1)) + model.lam * weakest
    x = rows.mapInArrow(_evidences(model), "y int, best double, together double").toPandas()
    model.weights = tuple(logistic(_inputs(x.best.to_numpy(), x.together.to_numpy()), x.y.to_numpy(float), ridge=0.1))
    return model


def _inputs(best, together):
    return np.column_stack([np.minimum(best, 30), np.log1p(together)])


def _above(model: Model, least: float):
    """(tokens, segments of at least that score), added up per slice."""

    def run(batches):
        for (texts,) in parts(batches, []):
            rows = [(n, sum(s >= least - 1e-9 for *_, s in found)) for n, found in _scan(model, texts)]
            yield pa.record_batch([pa.array([sum(c)], pa.int64()) for c in zip(*rows)], names=["n", "above"])

    return run


def _evidences(model):
    def run(batches):
        for texts, y in parts(batches, ["y"]):
            rows = [_evidence(model, n, found)[:2] for n, found in _scan(model, texts)]
            yield pa.record_batch([y.cast(pa.int32()), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64())], names=["y", "best", "together"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """The rows and columns of ``docs`` with ``score`` (0 to 1), ``n_passages`` and ``passages`` (arrays of first
    and last token and evidence), which replace columns of those names.

    Tokens are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text with A-Z in lower case; a word's score is the largest of
    its own and its beginnings' (4 to 9 characters), as invectives are inflected and compounded. Null and empty
    texts have no passage and the score of no evidence. Equal texts get equal scores.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score", "n_passages", "passages")
    names = docs.columns
    more = T._parse_datatype_string("score double, n_passages long, passages array<struct<first:long,last:long,evidence:double>>")
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("evidence", pa.float64())]))

    def run(batches):
        for texts, *columns in parts(batches, names):
            found = [_evidence(model, n, f) for n, f in _scan(model, texts)]
            x = _inputs(np.array([f[0] for f in found]), np.array([f[1] for f in found]))
            score = chance(x @ np.array(model.weights[:-1]) + model.weights[-1])
            passages = pa.array([[{"first": a, "last": b, "evidence": e} for a, b, e in f[2]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array([len(f[2]) for f in found], pa.int64()), passages], names=[*names, "score", "n_passages", "passages"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more.fields]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document: fold, score and verdict at 0.3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity(docs, model)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages")
