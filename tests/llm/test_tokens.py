"""Operators on token ids and phrases, against the libraries and plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
from watchgrid.llm import alignment, byte_bpe, collocations, orc_ids

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    r = random.Random(3)
    pool = ["a", "It's", "don't", "é", "é", "H̱", "the.", "漢字かな", "🙂", "x#y", "...", "Hello,", "ΟΔΟΣ", "İstanbul", "<|endoftext|>", "<|startoftext|>", "</s>", "<s>", "<0x41>", "▁", " ", " ", "\x00", "\x1c", "\x85", "ﬁ", "한", "한", "123", "4.5", "?!", "\r\n"]
    texts = ["".join(r.choice(pool) + r.choice([" ", "  ", "\n", "\t", "", " "]) for _ in range(r.randint(0, 60))) for _ in range(80)]
    return texts + [None, "", " ", "\n\n", "w " * 20000, "q" * 5000, "word" * 40, "same text", "same text", "<|endoftext|>", "a\x0bb\x0cc", ".", " lead", "trail ", "baİ. Çİ, क़. क़ aİ", "ǅ. ẞ, ﬀ. ΣΑΣ, ŉ."]


def frame(spark, texts):
    rows = [(i if i % 11 else None, t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(4)


def test_orc_ids_like_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = odd_texts()
    orc_ids.write_ids(frame(spark, texts), str(tmp_path / "ids"), WORDS, shards=5)
    rows = orc_ids.read_ids(spark, str(tmp_path / "ids"))
    got = rows.collect()
    want = Counter((i if i % 11 else None, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in enumerate(texts))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    got.sort(key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and [r.start for r in got] == np.cumsum([0] + [len(r.ids) for r in got])[:-1].tolist()
    sums = {r.start: r for r in orc_ids.checksums(rows).collect()}
    for r in got:
        x = sums[r.start]
        assert (x.n_tokens, x.ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))


def test_orc_ids_of_empty_and_repeated_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    orc_ids.write_ids(empty, str(tmp_path / "none"), WORDS)
    assert orc_ids.checksums(orc_ids.read_ids(spark, str(tmp_path / "none"))).count() == 0
    # one document's copies are dealt to several files
    copies = spark.createDataFrame([(7, "same words")] * 400, "doc_id long, text string")
    orc_ids.write_ids(copies, str(tmp_path / "hot"), WORDS, shards=4)
    rows = orc_ids.read_ids(spark, str(tmp_path / "hot")).collect()
    assert len(rows) == 400 and len({r.shard for r in rows}) > 1 and len({r.start for r in rows}) == 400


def test_orc_files_are_pruned_by_id(spark, tmp_path):
    docs = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "concat_ws(' ', sha2(string(id), 256), sha2(string(-id), 256)) as text")
    orc_ids.write_ids(docs, str(tmp_path / "many"), WORDS, shards=2, stripe=50_000, stride=1000)
    files = sorted((tmp_path / "many").glob("*.orc"))
    assert len(files) == 2 and all(pyarrow.orc.ORCFile(f).nstripes > 1 for f in files)

    def read(doc_id):
        rows = spark.read.schema(orc_ids.SCHEMA).orc(str(tmp_path / "many")).where(f"doc_id = {doc_id}").select("doc_id")
        assert rows.collect() == ([(doc_id,)] if doc_id % 2 == 0 else [])
        plan = rows._jdf.queryExecution().executedPlan()
        assert f"EqualTo(doc_id,{doc_id})" in plan.toString()
        return int(plan.collectLeaves().head().metrics().apply("numOutputRows").value())

    assert read(31_000) <= 1000
    # within the range of a row group, so that its Bloom filter alone tells
    assert read(31_001) == 0


def by_hand(texts):
    """Numbers of op11 by sets of ends and nested loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(BYTES)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    token = byte_bpe.loaded(False).token
    out, count = [], Counter()
    for text in texts:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        left = [token[i] for i in a]
        right = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(left) == b"".join(right) == (" " + text).encode():
            out.append(([], 0, 0))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (left, right)]
        groups, at = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append(tuple([i for i, e in zip(ids, own) if at < e <= end] for ids, own in zip((a, b), ends)))
            at = end
        out.append((groups, len(a), len(b)))
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    rows = []
    for groups, n_a, n_b in out:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((n_a, n_b, len(groups), len(links), sum(count[k] == top[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return rows


def test_alignment_against_loops(spark):
    texts = odd_texts()
    got = alignment.alignment(frame(spark, texts), PIECES, keep=True).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    want = Counter((i if i % 11 else None, *row) for i, row in enumerate(by_hand(texts)))
    assert Counter((r.doc_id, *[r[c] for c in names]) for r in got) == want
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def test_alignment_does_not_depend_on_slices(spark):
    sides = alignment._loaded(PIECES)
    texts = [t.encode() for t in odd_texts() if t]
    whole = alignment.align_slice(sides, texts, True)
    for k, t in enumerate(texts):
        one = alignment.align_slice(sides, [t], True)
        assert one["groups"][0] == whole["groups"][k] and one["n_links"][0] == whole["n_links"][k]


def test_overlaps_against_loops():
    r = random.Random(5)
    for _ in range(200):
        start, doc, at = ([], []), ([], []), 0
        for d in range(r.randint(1, 3)):
            n = r.randint(1, 12)
            for side in (0, 1):
                cuts = sorted({0, *r.sample(range(n), r.randint(0, n - 1))})
                start[side].extend(at + c for c in cuts)
                doc[side].extend([d] * len(cuts))
            at += n
        a, b = (list(zip(s, [*s[1:], at])) for s in start)
        i, j, begins_a, begins_b = alignment.overlaps(*(np.array(x) for x in (start[0], doc[0], start[1], doc[1])))
        assert sorted(zip(i.tolist(), j.tolist())) == [(p, q) for p, x in enumerate(a) for q, y in enumerate(b) if x[0] < y[1] and y[0] < x[1]]
        assert [x[0] in start[1] for x in a] == begins_a.tolist() and [y[0] in start[0] for y in b] == begins_b.tolist()


def phrases_by_hand(docs, support, most, within):
    """Collocations by counting everything, with exact fractions."""
    count, words = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i : i + k])] += 1
    rows = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((int(Fraction(2_000_000 * a, f[p[:k]] + f[p[k:]])), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        rows += [(lang, i + 1, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most])]
    return sorted(rows)


@pytest.mark.parametrize("shards, most, partitions", [(1, 2000, 1), (8, 2000, 4), (40, 25, 7)])
def test_collocations_against_counting(spark, shards, most, partitions):
    r = random.Random(11)
    pool = ["The", "of", "and", "é", "x-y", "naïve", " ", "big", "cat", "\x00", "ſ", "K"]
    docs = [("".join(r.choice(pool[: r.randint(2, 12)]) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " "]) for _ in range(r.randint(0, 80))), r.choice(["en", "de", None, "und", "EN"])) for _ in range(150)]
    docs += [(None, "en"), ("", None), ("the same passage here again " * 60, "fr")] + [("copied words of one text", "de")] * 90
    given = spark.createDataFrame([(i % 70, t, x, 1) for i, (t, x) in enumerate(docs)], "doc_id long, text string, lang string, n long").repartition(partitions)
    got = collocations.collocations(given, support=12, most=most, shards=shards)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == phrases_by_hand(docs, 12, most, 80)


def test_phrases_are_counted_by_language_and_spelt_at_once():
    texts = [b"The \t big  cat.The big cat", "é\tnaïve ſ,".encode(), b"", b"x"] * 50
    part = collocations._Slice(texts, "en")
    for k in (1, 2, 3, 4):
        at = part.at(k)
        want = [b" ".join(part.words.blob[part.words.start[i] : part.words.end[i]] for i in range(a, a + k)).decode() for a in at.tolist()]
        assert part.spelt(at, k).to_pylist() == want and (k != 3 or "the big cat" in want)
    batch = pyarrow.RecordBatch.from_pydict({"text": [t.decode() for t in texts], "lang": ["en", "de"] * 100, "shard": [i % 8 for i in range(200)]})
    told = list(collocations._by_language([batch] * 30))
    assert sorted(x for x, _ in told) == ["de", "en"] and sum(len(some) for _, some in told) == 6000
    many = pyarrow.RecordBatch.from_pydict({"text": ["w " * 5000] * 2000, "lang": [f"l{i % 40}" for i in range(2000)]})
    sizes = [sum(map(len, some)) for _, some in collocations._by_language([many])]
    assert sum(sizes) == 20_000_000 and max(sizes) < 2.1e6 and len(sizes) < 200


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(empty).count() == 0


def test_byte_ids_of_long_white_space():
    for special in (True, False):
        ids = byte_bpe.loaded(special)
        library = ids.other()
        for text in ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x" + "\t" * 1_000_000 + "y", "\r\n \t" * 300_000 + "z <|endoftext|>", " " * 1_000_000]:
            assert ids.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        for text in filter(None, odd_texts()):
            assert ids.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
