"""Operators that work text by text, against brute force, the library, or held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from watchgrid.llm import byte_bpe, licenses, media, packing, quality_chain, quality_rules, sentencepieces, toxicity

SCHEMA = "doc_id long, text string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents():
    r = random.Random(7)
    pool = ["a", "bb", "é", "the", "MIT", "License", "漢字", "🙂", "x#y", "**", "Apache", "general", "public"]
    docs = [(i, "".join(r.choice(pool) + r.choice([" ", "  ", "\n", "\t", " "]) for _ in range(r.randint(0, 90)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "   \n "), (103, "w " * 30000), (104, "q" * 5000), (105, "same text"), (105, "same text"), (None, "no id")]
    return docs


def frame(spark, docs=None):
    return spark.createDataFrame(documents() if docs is None else docs, SCHEMA).repartition(4)


def test_pieces_like_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sentencepieces.encode_decode(frame(spark).selectExpr("*", "1 as n_tokens", "2 as extra"), PIECES).collect()
    assert len(rows) == len(documents())
    for x in rows:
        ids = library.encode(x.text or "")
        assert x.ids == ids and x.n_tokens == len(ids) and x.decoded == library.decode(ids) and x.extra == 2
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_segments_against_brute_force():
    def brute(s, lo, hi):
        best = max(((sum(s[i : j + 1]), -i, -j) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return []
        i, j = -best[1], -best[2]
        return brute(s, lo, i) + [(i, j)] + brute(s, j + 1, hi)

    r = random.Random(1)
    for _ in range(100):
        n = r.randint(1, 18)
        s = [-0.5] * n
        at = sorted(r.sample(range(n), r.randint(0, n)))
        for i in at:
            s[i] = r.uniform(-2, 3)
        got = toxicity.segments(np.array(at, int), np.array([s[i] for i in at]), 0.5)
        assert [(a, b) for a, b, _ in got] == brute(s, 0, n)


def test_rules_against_brute_force(spark):
    rows = quality_rules.quality_rules(frame(spark).selectExpr("*", "'x' as kept")).collect()
    assert len(rows) == len(documents())
    for x in rows:
        text = x.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [y for y in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        assert (x.n_words, x.word_chars, x.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert x.n_dup_lines == len(lines) - len(set(lines))
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = {k: windows.count(k) for k in set(windows)}
        covered = {i + k for i, y in enumerate(windows) if count[y] > 1 for k in range(3)}
        assert x.n_repeat_words == len(covered)
        assert x.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (x.base_failed and x.kept)


def brute_runs(w):
    """For each word, the longest run from it that starts elsewhere too."""
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    return best


def test_verdict_rests_on_repeats_alone(spark):
    r = random.Random(5)
    fresh = lambda a, b: [f"w{i}" for i in range(a, b)]
    table = [y for x in fresh(0, 80) for y in (x, "|")]
    docs = [table, fresh(0, 80), fresh(0, 61) + ["x"] + fresh(0, 61), fresh(0, 60) + fresh(100, 250) + fresh(0, 60), fresh(0, 20) * 2 + fresh(100, 160), fresh(0, 15) * 2 + fresh(100, 170), fresh(0, 49), fresh(0, 20) * 9]
    docs += [[r.choice("abcdefgh") if r.random() < 0.5 else f"w{r.randrange(40)}" for _ in range(r.randrange(45, 120))] for _ in range(40)]
    rows = {x.doc_id: x for x in quality_rules.quality_rules(frame(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])).collect()}
    for i, w in enumerate(docs):
        best, x = brute_runs(w), rows[i]
        under = {a + k for a, b in enumerate(best) if b >= 6 for k in range(b)}
        assert (x.n_covered, x.longest_repeat) == (len(under), max(best))
        assert x.kept == (not x.base_failed and 100 * len(under) <= 30 * len(w) and max(best) <= 60)
        assert x.symbols_failed == (100 * len(re.findall(r"[#*$%&|<>]", " ".join(w))) > 5 * len(w))
    assert [rows[i].kept for i in range(8)] == [True, True, False, False, False, True, False, False] and rows[0].symbols_failed


def test_longest_repeats_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        docs = [[r.randrange(3) for _ in range(r.randrange(15))] for _ in range(3)]
        want = []
        for d in docs:
            for i in range(len(d)):
                runs = [0]
                for j in range(len(d)):
                    k = 0
                    while i != j and i + k < len(d) and j + k < len(d) and d[i + k] == d[j + k]:
                        k += 1
                    runs.append(k)
                want.append(max(runs))
        owner = np.repeat(np.arange(3), [len(d) for d in docs])
        assert quality_rules.longest_repeats(np.array(sum(docs, []), np.int64), owner).tolist() == want


def test_packing(spark):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame(spark, [d for d in documents() if d[0] != 105]).selectExpr("*", "7 as piece", "'x' as length")
    rows = packing.pack_documents(docs).collect()
    by_doc, by_sequence = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_sequence.setdefault(x.sequence_id, []).append(x)
    for doc, text in documents():
        if doc == 105:
            continue
        ids = np.array(bpe.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, x in enumerate(sorted(by_doc[doc], key=lambda y: y.piece)):
            assert (x.piece, x.start, x.ids_crc32) == (k, at, zlib.crc32(ids[at : at + x.length].tobytes()))
            assert k == 0 or x.length == 2048
            at += x.length
        assert at == len(ids)
    for group in by_sequence.values():
        at = 0
        for x in sorted(group, key=lambda y: y.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(x.length for x in rows) // 2048) + 1


def brute_sum_of_squares(length, size):
    """Each piece where the sum of the squares of the counts of open sequences per gap becomes smallest; ties: the smallest
    gap, then an open sequence before a new one."""
    gaps, out = [], []
    for s in length:
        best = None
        for g in sorted({x for x in gaps if x >= s}) + [size]:
            after = sorted(gaps)
            if g in gaps:
                after.remove(g)
            elif g != size:
                continue
            after.append(g - s)
            count = {}
            for x in after:
                if x:
                    count[x] = count.get(x, 0) + 1
            total = sum(v * v for v in count.values())
            if best is None or total < best[0]:
                best = (total, g)
        out.append(best[1])
        if best[1] in gaps:
            gaps.remove(best[1])
        gaps.append(best[1] - s)
    return out, sorted(gaps)


def test_sum_of_squares_against_brute_force():
    r = random.Random(8)
    for _ in range(60):
        size = r.choice([6, 10, 17])
        length = [r.randint(1, size - 1) for _ in range(r.randint(1, 40))]
        to, gap = packing.sum_of_squares(np.array(length), size)
        left, before = {}, []
        for s, b in zip(length, to.tolist()):
            before.append(left.get(b, size))
            left[b] = left.get(b, size) - s
        want, gaps = brute_sum_of_squares(length, size)
        assert before == want and sorted(gap.tolist()) == gaps == sorted(left.values())


def test_more_than_one_shard_and_repeated_ids(spark):
    r = random.Random(6)
    docs = [(i // 2, " ".join(r.choice(["one", "two", "three"]) for _ in range(r.randint(0, 700)))) for i in range(400)]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = packing.pack(frame(spark, docs), path, public_tokenizers.PATTERN, size=512, shard=90).collect()
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append(x)
    assert len({x >> 32 for x in by if x >= 0}) > 2
    for group in by.values():
        group.sort(key=lambda x: x.offset)
        assert [x.offset for x in group] == [sum(y.length for y in group[:k]) for k in range(len(group))]
        assert sum(x.length for x in group) <= 512
    assert len(by) <= 1.05 * sum(x.length for x in rows) / 512 + 1


def test_ids_of_the_ranks_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = byte_bpe.loaded(True)
    points = [chr(x) for x in range(0x30000) if not 0xD800 <= x < 0xE000]
    texts = ["".join(points[k : k + 97]) for k in range(0, len(points), 97)] + [f"a{x}1 {x}{x} b" for x in points[::53]]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "don't I'LL  x\r\n\n  \t y", " " * 50]
    for text, e in zip(texts, bpe.encode_batch(texts, add_special_tokens=False)):
        assert ours.encode(text).tolist() == e.ids, text


def test_media(spark):
    rows = media.media_columns(frame(spark).selectExpr("*", "'p' as packets", "1 as media_bytes", "'e' as extra")).collect()
    assert len(rows) == len(documents()) and all(x.extra == "e" for x in rows)
    for x in rows:
        payload = media.padded((x.text or "").encode())
        assert media.read(bytes(x.media)) == payload and b"".join(bytes(x.media)[p.start : p.end] for p in x.packets) == payload
        assert (x.n_bytes, x.payload_bytes, x.tail_crc32) == (len((x.text or "").encode()), len(payload), zlib.crc32(payload[-64:]))
        assert x.payload_sha256 == hashlib.sha256(payload).hexdigest() and x.media_sha256 == hashlib.sha256(x.media).hexdigest()


def _unknown(name, body):
    return name.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body


def _wide(name, body):
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + media.size_code(len(body), 8) + body


def test_unknown_and_wide_sizes_groups_and_cues():
    m = media
    block = lambda t, data: m.size_code(1) + t.to_bytes(2, "big") + b"\x00" + data
    one = m.number(m.TIME, 5) + m.element(m.SIMPLE, block(1, b"aa")) + m.element(m.GROUP, m.element(m.BLOCK, block(2, b"bb")) + m.number(0x9B, 3))
    two = m.number(m.TIME, 50) + _wide(m.SIMPLE, block(0, b"cc"))
    info = m.element(m.INFO, m.number(m.SCALE, 1000))
    for wrap in (m.element, _unknown, _wide):
        for last in (m.element, _unknown, _wide):
            body = info + wrap(m.CLUSTER, one)
            place = len(body)
            body += last(m.CLUSTER, two) + m.element(m.CUES, m.element(m.POINT, m.number(m.CUE_TIME, 5) + m.element(m.POSITIONS, m.number(m.CUE_TRACK, 1) + m.number(m.CUE_PLACE, len(info)))) + m.element(m.POINT, m.number(m.CUE_TIME, 50) + m.element(m.POSITIONS, m.number(m.CUE_TRACK, 1) + m.number(m.CUE_PLACE, place))))
            for whole in (m.element, _unknown, _wide):
                data = whole(m.SEGMENT, body)
                found, cues, _ = m.packets(data)
                assert [(t, at, data[a:b]) for t, at, a, b in found] == [(1, 6000, b"aa"), (1, 7000, b"bb"), (1, 50000, b"cc")]
                assert [(c[0], c[1]) for c in cues] == [(5000, 1), (50000, 1)] and all(data[c[2] : c[2] + 4] == m.CLUSTER.to_bytes(4, "big") for c in cues)
                for at in (0, 6500, 7000, 8000, 50000, 50001):
                    assert m.packets_from(data, at) == [p for p in found if p[1] >= at]


def test_times_of_laced_frames_and_seeking():
    payload = bytes(range(256)) * 300
    data = media.write(payload)
    found, cues, tracks = media.packets(data)
    assert [t for _, t, _, _ in found] == [k * 100_000_000 for k in range(len(found))] and len(cues) > 2 and tracks[0][media.RATE] == 8000
    for at in (0, 1, 3_250_000_000, found[-1][1], found[-1][1] + 1):
        assert media.packets_from(data, at) == [p for p in found if p[1] >= at]


def test_broken_files():
    good = media.write(b"x" * 5000)
    assert media.read(good) == b"x" * 5000
    for bad in (good[:-9], good[: len(good) // 2]):
        with pytest.raises((ValueError, IndexError)):
            media.packets(bad)


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_all_lacings(lacing):
    parts = [b"a" * 300, b"b" * 300, b"c" * 300]
    sizes = {0: b"", 1: b"\x02\xff\x2d\xff\x2d", 2: b"\x02", 3: b"\x02" + media.size_code(300) + media.size_code(63, 1)}[lacing]
    body = b"".join(parts[:1] if not lacing else parts)
    data = media.size_code(5) + b"\x00\x07" + bytes([lacing << 1]) + sizes + body
    got = [(t, r, data[a:b]) for t, r, a, b in media.frames(data, 0, len(data))]
    assert got == [(5, 7, p) for p in (parts[:1] if not lacing else parts)]


def in_order(a, b, weight):
    row = [0.0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = max(before[j + 1], row[j], before[j] + weight(x) if x == y else 0.0)
    return row[-1]


def test_scan_against_brute_force():
    r = random.Random(9)
    one, two = "a b c d e f g h i j k l m n o p".split(), "p q a b r s q t".split()
    weights = {x: 1 + (k * 7) % 5 for k, x in enumerate(sorted({*one, *two}))}
    frequency = {int(licenses._hashes(x).view(np.int64)[0]): 1000 - 150 * n for x, n in weights.items()}
    templates = [("X", " ".join(one), ["k l m", "a b c d"]), ("Y", " ".join(two), ["s q", "q a"])]
    index = licenses.Index(templates, frequency, 1000)
    weight = lambda x: float(index.idf[np.searchsorted(index.vocabulary, licenses._hashes(x)[0])])
    texts = [one[:6] + ["zz"] * 12 + ["yy"] * 6 + one[6:], [], ["zz"] * 40]
    for _ in range(400):
        text = [r.choice([*one, "zz"]) for _ in range(r.randrange(30))]
        for _ in range(2):
            at, a, words = r.randrange(len(text) + 1), r.randrange(8), r.choice([one, two])
            part = [x if r.random() < 0.85 else "yy" for x in words[a:]]
            for _ in range(r.randrange(3)):
                part.insert(r.randrange(len(part) + 1), "vv")
            text[at:at] = part
        texts.append(text)
    seen = {}
    for text in texts:
        h = licenses._hashes(" ".join(text))
        v = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
        hit = np.flatnonzero(index.vocabulary[v] == h)
        want = set()
        for t, (label, words, keys) in enumerate(templates):
            words = words.split()
            wide, total = len(words) + len(words) // 4 + 4, sum(map(weight, words))
            for a in range(len(text)):
                window = text[a : a + wide]
                if any(f" {k} " in f" {' '.join(window)} " for k in keys) and 2 * in_order(words, window, weight) >= total:
                    want.add(label)
        labels, score = index.scan(h, hit, v[hit])
        assert labels == want and (score >= 0.5 if want else score == 0), text
        seen[frozenset(want)] = seen.get(frozenset(want), 0) + 1
    assert len(seen) == 4 and min(seen.values()) > 5


def test_whole_licences_with_changes(spark):
    r = random.Random(2)
    docs = [(k, f"word {k} other text") for k in range(400)]
    want = {}
    for k, (label, text, keys) in enumerate(licenses.TEMPLATES):
        words = text.split()
        for copy in range(2):
            changed = list(words)
            if len(words) > 25:
                key = {y for x in keys for y in x.split()}
                free = [i for i, x in enumerate(words) if x not in key]
                for i in sorted(r.sample(free, 3), reverse=True):
                    changed[i : i + 1] = [["x", words[i]], [], ["y"]][r.randrange(3)]
            docs.append((1000 + 2 * k + copy, "/* " + "before " * r.randrange(9) + "\n * ".join(" ".join(changed[i : i + 9]) for i in range(0, len(changed), 9)) + " after */"))
            want[1000 + 2 * k + copy] = label
    rows = {x.doc_id: x for x in licenses.license_scan(frame(spark, docs).selectExpr("*", "1 as labels", "'q' as score")).collect()}
    assert all(label in rows[d].labels.split(",") for d, label in want.items())
    assert all(rows[d].labels == "" and rows[d].score == 0 for d in range(400))


def test_notices_of_the_foundation(spark):
    notice = "This {} is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    kinds = {"AGPL-3.0": ("program", "GNU Affero General Public License", "3"), "GPL-2.0": ("program", "GNU General Public License", "2"), "LGPL-2.1": ("library", "GNU Lesser General Public License", "2.1"), "LGPL-3.0": ("library", "GNU Lesser General Public License", "3"), "GPL-3.0": ("program", "GNU General Public License", "3")}
    docs = [(i, f"/* some code {i} */ {notice.format(*k)} end") for i, k in enumerate(kinds.values())] + [(90 + i, "other words") for i in range(20)]
    rows = {x.doc_id: x.labels for x in licenses.license_scan(frame(spark, docs)).collect()}
    for i, label in enumerate(kinds):
        assert label in rows[i].split(",") and not set(rows[i].split(",")) & (set(kinds) - {label})


def test_licenses(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    docs = documents() + [(200, f"word {notice} more"), (201, "version 2.0 apache under licensed"), (202, "Released under the MIT License. " * 2)]
    rows = licenses.license_scan(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    for x in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), x.text or ""))
        at = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert x.base_labels == ",".join(sorted({b for _, b in at})) and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
    got = {x.doc_id: x.labels for x in rows}
    assert (got[200], got[201], got[202]) == ("Apache-2.0,apache", "", "MIT,mit")


def test_repetitive_texts_take_little_time():
    import time

    templates = [(label, text, keys) for label, text, keys in licenses.TEMPLATES]
    index = licenses.Index(templates, {}, 1000)
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
    near = [f"{notice} as published by someone else, either edition 3 of it" for _ in range(2000)]
    shuffled = notice.split() + "as published by the Free Software Foundation, either version 3 of the License".split()
    r = random.Random(4)
    mixed = [" ".join(r.sample(shuffled, len(shuffled))) for _ in range(2000)]
    for text, most in ((" ".join(near), 1.0), (" ".join([notice] * 2000), 1.0), (" ".join(mixed), 5.0)):
        h = licenses._hashes(text)
        v = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
        hit = np.flatnonzero(index.vocabulary[v] == h)
        start = time.process_time()
        index.scan(h, hit, v[hit])
        assert time.process_time() - start < 2 * most


def test_a_mention_is_no_notice(spark):
    docs = [(1, "we compared the MIT License and the GNU General Public License version 3 here"), (2, "This work is licensed under the GNU General Public License version 3."), (3, "SPDX-License-Identifier: MPL-2.0")]
    docs += [(k, f"other words of text {k}") for k in range(10, 60)]
    got = {x.doc_id: x.labels for x in licenses.license_scan(frame(spark, docs)).collect()}
    assert (got[1], got[2], got[3]) == ("gpl,mit", "GPL-3.0,gpl", "MPL-2.0")


def test_packing_of_long_white_space(spark):
    docs = [(k, f"a{c * 1_000_000}b") for k, c in enumerate(" \n\t")] + [(9, "<|endoftext|> x")]
    rows = packing.pack_documents(frame(spark, docs)).collect()
    for d, text in docs:
        ids = byte_bpe.loaded(True).other().encode(text, add_special_tokens=False).ids + [0]
        assert sum(x.length for x in rows if x.doc_id == d) == len(ids)
        for x in rows:
            if x.doc_id == d:
                assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes())


@pytest.mark.parametrize("most_lines", [300, 3])
def test_quality_learns_beside_a_giant_row(spark, most_lines):
    good, bad = "A sentence of ordinary words, as one would write it.\n" * 4, "BUY $$$ !!! ### 111\n" * 4
    docs = [(i, (good if i % 2 else bad) + f"line {i}") for i in range(60)] + [(1000, "x\n" * 400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    model = quality_chain.fit(frame(spark, docs), labels, most_lines=most_lines)
    assert np.abs(model.weights).max() > 0
    if most_lines == 300:
        rows = quality_chain.quality(frame(spark, docs), model).where("doc_id < 60").collect()
        assert all((x.score >= 0.5) == (x.doc_id % 2 == 1) for x in rows)


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    lines, table = np.array([3, 1, 4]), r.normal(size=(2, 2))
    score = r.normal(size=8)
    p, pairs = quality_chain.marginals(score, lines, table)
    want, both, at = np.zeros(8), np.zeros((2, 2)), 0
    for n in lines:
        weight = {}
        for k in range(2**n):
            s = [k >> i & 1 for i in range(n)]
            weight[tuple(s)] = np.exp(sum(score[at + i] * s[i] for i in range(n)) + sum(table[a, b] for a, b in zip(s, s[1:])))
        z = sum(weight.values())
        for s, x in weight.items():
            want[at : at + n] += np.array(s) * x / z
            for a, b in zip(s, s[1:]):
                both[a, b] += x / z
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, both)


def test_trained_scores(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(400):
        w = [word() for _ in range(r.randint(20, 60))]
        toxic, good = i % 4 == 0, i % 3 != 0
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["vilest", "scoundrel"]))
        docs.append((i, "\n".join(" ".join(x.upper() + "!!" if not good else x for x in w[k : k + 9]) for k in range(0, len(w), 9))))
        labels.append((i, int(good), int(toxic)))
    marks = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    all_docs = frame(spark, docs + [(900, None), (901, ""), (902, "z " * 30000), (None, "no id"), (0, docs[0][1])])
    truth = {d: (q, t) for d, q, t in labels}
    for module, score, k, cut in ((toxicity, toxicity.toxicity, 1, 0.3), (quality_chain, quality_chain.quality, 0, 0.5)):
        model = module.fit(all_docs, marks)
        rows = score(all_docs.selectExpr("*", "'e' as score"), model).collect()
        assert len(rows) == 405 and all(0 <= x.score <= 1 for x in rows)
        right = [(x.score >= cut) == bool(truth[x.doc_id][k]) for x in rows if x.doc_id in truth]
        assert np.mean(right) > 0.97
        empty = module.fit(frame(spark, []), marks.limit(0))
        assert all(0 <= x.score <= 1 for x in score(all_docs, empty).collect())


def test_empty_tables(spark):
    none = frame(spark, [])
    assert sentencepieces.encode_decode(none, PIECES).count() == 0
    assert quality_rules.quality_rules(none).count() == packing.pack_documents(none).count() == media.media_columns(none).count() == licenses.license_scan(none).count() == 0
