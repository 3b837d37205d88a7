"""N-gram Jaccard join by a token-group matrix.

1. Documents of one shingle set are one class, represented by the smallest id.
2. A sieve drops classes that can link with nothing: of a linked pair's sets, the first tokens (by hash; as many as may
   differ, and ``extra`` percent more) share that many more. What passes is looked at with all its tokens, and a token
   that no other set holds is struck out: a document keeps its shared tokens and its size, and its reach, the
   size of the largest set that it could link with if all of these were common.
3. Similar documents form groups: each is compared with one centre per min-hash, the document with the fewest tokens
   of its own, and whatever links connect is divided into groups of a bounded number of tokens.
4. The matrix has a row for a token and a group: the smallest size and the largest reach of its members with this
   token among the first ones (rare ones first). A document meets a group of another component at a row that both sizes allow.
   The overlap with the union of the group's tokens, stored once a group, bounds that with any member; only
   groups that could hold a link are opened, and their members compared.

Links inside a component need no search. So neither a third of all rows as near copies nor as exact copies
gives more than a few links a row, and a document that only shares a common passage is closed by its reach or by one union.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.llm.components import components
from watchgrid.llm.packs import by_part, packed
from watchgrid.llm.words import U, Words, mix, parts, shingles
from watchgrid.session import cut, ship

#: Tokens of a group, about: what one row of unions may hold.
GROUP_TOKENS = 1 << 17
#: Frequent tokens that are put in order; the others come before them by hash. Only speed depends on it.
FREQUENT = 1 << 16


def _sets(texts: list[bytes], width: int):
    """Distinct shingles of each text, by hash: (tokens, text, sizes)."""
    w = Words([t.lower() for t in texts])
    h, owner = shingles(w.hash, w.count, w.first, width)
    h = mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
    h, owner = h[new], owner[new]
    return h, owner, np.bincount(owner, minlength=len(texts))


def _names(h: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each set."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(mix(h + U(salt)), (np.cumsum(n) - n)[some])
    return out


def _profile(width: int):
    """Rows of documents: id, size, two set hashes."""

    def run(batches):
        for texts, ids in parts(batches, ["doc_id"]):
            h, _, n = _sets(texts, width)
            names = [pa.array(_names(h, n, k).view(np.int64)) for k in (11, 12)]
            yield pa.record_batch([ids.cast(pa.int64()), pa.array(n.astype(np.int64)), *names], names=["doc_id", "n", "s1", "s2"])

    return run


_TAG = U((1 << 40) - 1)
_SIEVE = [np.uint32, np.uint16, np.uint32, np.uint8, np.int8]


def _kinds(token: np.ndarray, who: np.ndarray):
    """Distinct rows with their kind. 0: a token single in this task, 1: stands for one known to be shared, 2: another of such,
    which may go to any part."""
    order = np.lexsort((who, token))
    token, who = token[order], who[order]
    new = np.append(True, (token[1:] != token[:-1]) | (who[1:] != who[:-1]))[: len(token)]
    token, who = token[new], who[new]
    head = np.append(True, token[1:] != token[:-1])[: len(token)]
    size = np.diff(np.append(np.flatnonzero(head), len(token)))
    return token, who, np.where(head, np.repeat(size > 1, size).astype(np.int8), np.int8(2))


def _part(token: np.ndarray, who: np.ndarray, kind: np.ndarray, n_parts: int) -> np.ndarray:
    return (mix(np.where(kind == 2, mix(token) + who, token)) % U(n_parts)).astype(np.int32)


def _met(token: np.ndarray, who: np.ndarray, kind: np.ndarray):
    """Of a part's rows, those whose token two different ones hold."""
    known = kind == 2
    t, g, k = token[~known], who[~known], kind[~known]
    order = np.lexsort((g, t))
    t, g, k = t[order], g[order], k[order]
    if len(t):
        head = np.append(True, t[1:] != t[:-1])
        other = np.append(False, (g[1:] != g[:-1]) & ~head[1:])
        shared = np.logical_or.reduceat(other | (k == 1), np.flatnonzero(head))[np.cumsum(head) - 1]
        keep = shared & (head | other)
        t, g = t[keep], g[keep]
    return np.concatenate([token[known], t]), np.concatenate([who[known], g])


def _sieve_packs(width: int, percent: int, extra: int, n_parts: int, most: int):
    """Packs of (48 bits of a token, 40 bits of a set's name): too few bits let more documents pass, and never fewer."""

    def flush(rows):
        token, tag, kind = _kinds(*(np.concatenate(x) for x in zip(*rows)))
        columns = [(token >> U(16)).astype(np.uint32), token.astype(np.uint16), (tag >> U(8)).astype(np.uint32), tag.astype(np.uint8), kind]
        return packed(columns, _part(token, tag, kind, n_parts))

    def run(batches):
        rows, held = [], 0
        for (texts,) in parts(batches, []):
            h, owner, n = _sets(texts, width)
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            first = place < np.repeat(n - -(-percent * n // 100) + np.maximum(1, extra * n // 100), n)
            rows.append((h[first] >> U(16), (_names(h, n, 11) & _TAG)[owner[first]]))
            held += int(first.sum())
            if held >= most:
                yield flush(rows)
                rows, held = [], 0
        if held:
            yield flush(rows)

    return run


def _sieve(batches):
    """(name, number of shared tokens)."""
    for high, low, tag, end, kind in by_part(batches, _SIEVE):
        _, who = _met(high.astype(np.uint64) << U(16) | low, tag.astype(np.uint64) << U(8) | end, kind)
        name, m = np.unique(who, return_counts=True)
        yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(m.astype(np.int64))], names=["tag", "m"])


def _all_tokens(width: int, n_parts: int, most: int):
    """Packs of (token, document). Of rows that repeat a document, those of the set named s1 count."""

    def flush(rows):
        token, doc, kind = _kinds(*(np.concatenate(x) for x in zip(*rows)))
        return packed([token, doc, kind], _part(token, doc, kind, n_parts))

    def run(batches):
        rows, held = [], 0
        for texts, ids, names in parts(batches, ["doc_id", "s1"]):
            h, owner, n = _sets(texts, width)
            right = (_names(h, n, 11).view(np.int64) == names.to_numpy(zero_copy_only=False))[owner]
            rows.append((h[right], ids.to_numpy(zero_copy_only=False).view(np.uint64)[owner[right]]))
            held += len(h)
            if held >= most:
                yield flush(rows)
                rows, held = [], 0
        if held:
            yield flush(rows)

    return run


def _shared_tokens(n_parts: int):
    """Shared tokens, packed by document."""

    def run(batches):
        for rows in by_part(batches, [np.uint64, np.uint64, np.int8]):
            token, doc = _met(*rows)
            order = np.argsort(doc, kind="stable")
            yield packed([token[order], doc[order]], (mix(doc[order]) % U(n_parts)).astype(np.int32))

    return run


def _document_sets(batches):
    """The sorted set of each document, and its size."""
    for token, doc in by_part(batches, [np.uint64, np.uint64]):
        order = np.lexsort((token, doc))
        token, doc = token[order], doc[order].view(np.int64)
        new = np.append(True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]))[: len(token)]
        token, doc = token[new], doc[new]
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
        ends = np.append(at[1:], len(doc))
        yield pa.record_batch([pa.array(doc[at]), pa.array([token[x:y].tobytes() for x, y in zip(at, ends)], pa.binary()), pa.array(ends[: len(at)] - at)], names=["rep", "tokens", "m"])


def _joined(batches):
    """The packs of each row as one sorted set, and its size."""
    for batch in batches:
        sets = [np.unique(np.frombuffer(b"".join(x), np.uint64)) for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int64())], names=["id", "tokens", "m"])


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all rows, row of each)."""
    packs = column.to_pylist()
    return np.frombuffer(b"".join(packs), np.uint64), np.repeat(np.arange(len(packs)), [len(x) // 8 for x in packs])


def _counts(batches):
    for batch in batches:
        token, n = np.unique(_flat(batch.column(0))[0], return_counts=True)
        yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])


def _minhashes(n_hashes: int):
    def run(batches):
        for batch in batches:
            token, row = _flat(batch.column(0))
            if not len(token):
                continue
            at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            low = np.stack([np.minimum.reduceat(mix(token + U(1000 + k)), at) for k in range(n_hashes)], 1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * n_hashes, pa.int32()), pa.array(low.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=[*batch.schema.names[1:], "minhash"])

    return run


def _prefixes(percent: int, order):
    """(token, and the row's other columns but m) for the first tokens of each document: rare ones first."""

    def run(batches):
        frequent, rank = order.value
        for batch in batches:
            col = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            token, row = _flat(col["tokens"])
            n, m = (col[k].to_numpy(zero_copy_only=False) for k in ("n", "m"))
            at = np.minimum(np.searchsorted(frequent, token), max(len(frequent) - 1, 0))
            place = np.where(frequent[at] == token, rank[at], 0) if len(frequent) else np.zeros(len(token), np.int64)
            by = np.lexsort((token, place, row))
            inner = np.arange(len(token)) - np.repeat(np.cumsum(m) - m, m)
            # tokens of its own come first of all, and are no use
            first = by[inner < np.repeat(m - -(-percent * n // 100) + 1, m)]
            keep = [k for k in col if k not in ("tokens", "m")]
            out = pa.table([col[k] for k in keep], names=keep).take(pa.array(row[first]))
            yield from pa.table([pa.array(token[first].view(np.int64)), *out.columns], names=["token", *keep]).combine_chunks().to_batches()

    return run


def _overlap(batches):
    """The columns but x and y, and the number of common tokens of x and y."""
    for batch in batches:
        col = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        common = []
        for x, y in zip(col["x"].to_pylist(), col["y"].to_pylist()):
            s, t = (np.frombuffer(b, np.uint64) for b in sorted((x, y), key=len))
            at = np.searchsorted(t, s)
            common.append(int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(s) else 0)
        keep = [k for k in col if k not in "xy"]
        yield pa.RecordBatch.from_arrays([*[col[k] for k in keep], pa.array(common, pa.int64())], names=[*keep, "common"])


def _compare(pairs: DataFrame, sets: DataFrame, others: DataFrame | None = None, schema: str = "") -> DataFrame:
    """``pairs`` (a, b and more, of the types in ``schema``) with the overlap of the token sets of a and b.

    The join by b comes last and feeds the comparison, so a set that many pairs look at isn't written once a pair.
    """
    one = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("x"))
    two = (sets if others is None else others).select(F.col("rep").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(_overlap, "b long, a long" + schema + ", common long")


def jaccard_classes(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n (set size), s1 (a name of the set) and rep (smallest document of the same set; itself where n is 0)."""
    profile = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(_profile(width), "doc_id long, n long, s1 long, s2 long")
    per = cut(profile.groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2")).alias("x")).select("doc_id", "x.*"))
    # written first, so that the join below only reads shuffles and a class of very many copies can be split
    shared = cut(per.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    return cut(per.join(shared, ["s1", "s2", "n"], "left").select("doc_id", "n", "s1", F.coalesce("rep", "doc_id").alias("rep")))


def shared_sets(docs: DataFrame, classes: DataFrame, width: int, percent: int, extra: int, pack_rows: int) -> DataFrame:
    """rep, n, m and tokens (the m tokens, packed in order, that other sets hold too), where m allows a link.

    Only documents that pass the sieve take part; those that link with something do.
    """
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    packs = docs.select("text").mapInArrow(_sieve_packs(width, percent, extra, n_parts, pack_rows), "part int, pack binary")
    found = packs.repartition("part").sortWithinPartitions("part").mapInArrow(_sieve, "tag long, m long").groupBy("tag").agg(F.sum("m").alias("m"))
    reps = classes.where("doc_id = rep and n > 0").select("rep", "n", "s1", F.col("s1").bitwiseAND(F.lit(int(_TAG))).alias("tag"))
    # a partner has percent of n tokens at least, and so much fewer first ones
    needed = f"greatest(1, {extra} * ceil({percent} * n / 100) div 100)"
    passed = cut(reps.join(found, "tag").where(f"m >= {needed}").select("rep", "n", "s1"))
    texts = docs.select("doc_id", "text").join(passed.select(F.col("rep").alias("doc_id"), "s1"), "doc_id")
    packs = texts.mapInArrow(_all_tokens(width, n_parts, pack_rows), "part int, pack binary")
    packs = packs.repartition("part").sortWithinPartitions("part").mapInArrow(_shared_tokens(n_parts), "part int, pack binary")
    sets = packs.repartition("part").sortWithinPartitions("part").mapInArrow(_document_sets, "rep long, tokens binary, m long")
    return cut(sets.join(passed, "rep").where(f"100 * m >= {percent} * n").select("rep", "n", "m", "tokens"))


def jaccard_links(docs: DataFrame, width: int = 5, percent: int = 75, n_hashes: int = 4, extra: int = 10, pack_rows: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(classes, found): see ``jaccard_classes``; rep and component, for documents that link with another set.

    Two sets link with 100 * overlap >= percent * union. ``component`` is the smallest document that links reach.
    Rows with a null doc_id are left out; of rows that repeat a doc_id, the one of the largest set counts.
    ``n_hashes``, ``extra`` and ``pack_rows`` change the work, not the result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    classes = jaccard_classes(docs, width)
    sets = shared_sets(docs, classes, width, percent, extra, pack_rows)
    small = sets.withColumn("reach", F.expr(f"({100 + percent} * m - {percent} * n) div {percent}")).select("rep", "n", "m", "reach")
    linked = f"{100 + percent} * common >= {percent} * (na + nb)"
    possible = f"{100 + percent} * least(ma, mb) >= {percent} * (na + nb)"
    side = lambda x: [F.col(k).alias(f"{k}{x}") for k in "nm"]
    sizes = ", na long, nb long"

    # groups: everyone against a centre per min-hash, the one with the fewest tokens of its own
    hashes = sets.select("tokens", "rep", "n", "m").mapInArrow(_minhashes(n_hashes), "rep long, n long, m long, minhash array<long>")
    hashes = cut(hashes.select("rep", "n", "m", F.posexplode("minhash").alias("k", "h")))
    leaders = cut(hashes.groupBy("k", "h").agg(F.min(F.struct(F.expr("n - m"), "rep", "n", "m")).alias("x"), F.count("*").alias("many")).where("many > 1").select("k", "h", F.col("x.rep").alias("b"), F.col("x.n").alias("nb"), F.col("x.m").alias("mb")))
    tries = hashes.select(F.col("rep").alias("a"), *side("a"), "k", "h").join(leaders, ["k", "h"]).where(f"a <> b and {possible}")
    tries = tries.select("a", "b", "na", "nb").distinct()
    stars = cut(_compare(tries, sets, schema=sizes).where(linked).select("a", "b"))
    known = cut(components(stars))

    # components are divided into groups, by number of tokens
    of = small.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "n", "m", "reach", F.coalesce("component", "rep").alias("component"))
    of = cut(of)
    weight = cut(of.groupBy("component").agg(F.sum("m").alias("weight"), F.count("*").alias("members")).where("members > 1"))
    slots = F.greatest(F.lit(1), F.ceil(F.coalesce("weight", F.lit(0)) / GROUP_TOKENS))
    member = of.join(weight, "component", "left").withColumn("slot", F.pmod(F.xxhash64("rep"), slots).cast("int"))
    member = cut(member.select("rep", "n", "m", "reach", "component", "slot", F.coalesce("members", F.lit(1)).alias("members")))

    # the matrix: first tokens of documents and, of these, of groups
    counts = sets.select("tokens").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 8")
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    frequent = top.token.to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(frequent)
    order = spark.sparkContext.broadcast((frequent[by], top.n.to_numpy().astype(np.int64)[by]))
    more = "n long, reach long, component long, slot int, members long"
    wide = sets.select("rep", "tokens", "m").join(member.drop("m"), "rep").select("tokens", "m", "rep", "n", "reach", "component", "slot", "members")
    first = cut(wide.mapInArrow(_prefixes(percent, order), f"token long, rep long, {more}"))
    several = cut(first.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token"))
    first = cut(first.join(several, "token"))
    matrix = cut(first.groupBy("token", "component", "slot").agg(F.min("n").alias("least"), F.max("reach").alias("farthest"), F.max("members").alias("beside")))
    # the document of the smaller component looks for groups of the larger one
    meet = "(members < beside or members = beside and component < other) and least <= reach and n <= farthest"
    groups = matrix.select("token", F.col("component").alias("other"), F.col("slot").alias("s"), "least", "farthest", "beside")
    met = first.join(groups, "token").where(meet).groupBy("rep", "component", "n", "reach", "other", "s").agg(F.min("least").alias("least"))
    met = cut(met)
    if met.isEmpty():
        return classes, known.select(F.col("node").alias("rep"), "component")

    # unions of the groups that are met, each stored once; a bound for all members
    inside = member.select(F.col("component").alias("other"), F.col("slot").alias("s"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("reach").alias("rb"))
    wanted = cut(met.select("other", "s").distinct())
    held = cut(inside.join(wanted, ["other", "s"]))
    union = held.join(sets.select(F.col("rep").alias("b"), "tokens"), "b").groupBy("other", "s").agg(F.min("b").alias("b"), F.collect_list("tokens").alias("tokens"))
    union = cut(union.select(F.col("b").alias("rep"), "tokens").mapInArrow(_joined, "rep long, tokens binary, m long"))
    # a group is named by its smallest member
    called = held.groupBy("other", "s").agg(F.min("b").alias("b"))
    met = met.join(called, ["other", "s"]).select(F.col("rep").alias("a"), "b", F.col("component").alias("ca"), F.col("other").alias("cb"), F.col("s"), F.col("n").alias("na"), "least")
    bounds = _compare(met, sets, union, ", ca long, cb long, s int, na long, least long")
    opened = cut(bounds.where(f"{100 + percent} * common >= {percent} * (na + least)").select("a", "ca", "na", F.col("cb").alias("other"), "s"))

    # members of opened groups: the centre of the component first, then whoever else may link
    centre = held.groupBy("other").agg(F.min(F.struct(F.col("nb") - F.col("mb"), "b", "nb", "mb")).alias("x")).select("other", "x.b", "x.nb", "x.mb")
    mine = small.select(F.col("rep").alias("a"), F.col("m").alias("ma"), F.col("reach").alias("ra"))
    tries = opened.select("a", "ca", "na", "other").distinct().join(cut(centre), "other").join(mine, "a").where(possible)
    found = cut(_compare(tries.select("a", "b", "na", "nb", "ca", "other"), sets, schema=sizes + ", ca long, other long").where(linked).select("a", "ca", "other"))
    rest = opened.join(found, ["a", "other"], "left_anti").join(held, ["other", "s"]).join(mine, "a").where(f"{possible} and nb <= ra and na <= rb")
    last = _compare(rest.select("a", "b", "na", "nb", "ca", "other"), sets, schema=sizes + ", ca long, other long").where(linked)
    edges = cut(found.select("ca", "other").union(last.select("ca", "other")).distinct())
    if edges.isEmpty():
        return classes, known.select(F.col("node").alias("rep"), "component")
    above = components(edges, "ca", "other").select(F.col("node").alias("component"), F.col("component").alias("top"))
    whole = of.select("rep", "component").join(cut(above), "component", "left").select("rep", F.coalesce("top", "component").alias("component"))
    return classes, whole


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles (set size) and component_id (smallest document reachable by links, itself included).

    A set holds the distinct runs of ``width`` words (``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased) of the whole text; of
    fewer words, the whole sequence; of no words or a null text, nothing, and links with nothing. Two
    documents link where 100 * overlap >= percent * union. Rows with a null ``doc_id`` are left out; rows that
    repeat a ``doc_id`` give one row. Other columns are ignored. Tokens are compared by 64 bits of hash.
    """
    classes, found = jaccard_links(docs, width, percent)
    # the smallest documents of classes are apart from each other, so links give all that classes don't
    return classes.join(cut(found), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Per document: set size and component."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a WHERE r.c < l.b)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
