"""Licence scan by a positional index of rare template words.

The index holds, for each template, its words of the highest inverse document frequency (over all files): so many
that what is left weighs less than the share that a match needs. A file's words that the index holds are looked up once,
and their postings name templates and places; a template that no such word names costs nothing. Around a place, the
windows that begin at a template word and hold a mandatory key phrase are tried, those with the most votes by relative position first:
a window matches when the words that stand in it in the template's order carry the share of its weight, or more where a key phrase
is a third of the template. So words may
be inserted, left out or changed, and no match is missed (see ``Index``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid.llm.words import MARKS, Words, parts
from watchgrid.session import ship

# Phrases and labels of the base.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

_WORK = "This {0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_WARRANTY = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {1} for more details."
_GRANT_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS_MIT = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = {"AGPL-3.0": ("program", "GNU Affero General Public License", "3"), "GPL-2.0": ("program", "GNU General Public License", "2"), "GPL-3.0": ("program", "GNU General Public License", "3"), "LGPL-2.1": ("library", "GNU Lesser General Public License", "2.1"), "LGPL-3.0": ("library", "GNU Lesser General Public License", "3")}
_CREATIVE = {"CC-BY-4.0": ("CC BY 4.0", "Attribution 4.0"), "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Attribution-ShareAlike 4.0"), "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Attribution-NonCommercial 4.0"), "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Attribution-NoDerivatives 4.0")}
_IDENTIFIERS = ["0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
# Label, wording of the licence or of its usual notice, key phrases of which one must stand in the place.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ["Apache License, Version 2.0"]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ["except in compliance with the License", "apache.org/licenses/LICENSE-2.0"]),
    ("Apache-2.0", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.", ["each Contributor hereby grants to You"]),
    ("BSD-2-Clause", _BSD, ["source and binary forms"]),
    ("BSD-3-Clause", f"{_BSD} {_NO_ENDORSEMENT}", ["endorse or promote products"]),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", ["any person or organization obtaining a copy"]),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", ["Boost Software License"]),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["waived all copyright and related or neighboring rights"]),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", ["Eclipse Public License 2.0"]),
    ("GPL-2.0", "This work is licensed under the GNU General Public License version 2.", ["GNU General Public License version 2"]),
    ("GPL-3.0", "This work is licensed under the GNU General Public License version 3.", ["GNU General Public License version 3"]),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["with or without fee is hereby granted"]),
    ("MIT", "Released under the MIT License.", ["MIT License"]),
    ("MIT", _GRANT_MIT, ["to deal in the Software without restriction", "hereby granted, free of charge"]),
    ("MIT", _AS_IS_MIT, ["authors or copyright holders be liable"]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["Mozilla Public License, v. 2.0"]),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["unencumbered software"]),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ["alter it and redistribute it freely"]),
]
TEMPLATES += [(label, f"{_WORK.format(*k)} {_WARRANTY.format(*k)}", [f"{k[1]} as published by the Free Software Foundation, either version {k[2]} of"]) for label, k in _GNU.items()]
TEMPLATES += [(label, _WORK.format(*k), [f"{k[1]} as published by the Free Software Foundation, either version {k[2]} of"]) for label, k in _GNU.items()]
TEMPLATES += [(label, f"Licensed under {short}.", [short]) for label, (short, _) in _CREATIVE.items()]
TEMPLATES += [(label, f"This work is licensed under a Creative Commons {name} International License.", [f"Creative Commons {name}"]) for label, (_, name) in _CREATIVE.items()]
TEMPLATES += [(x, f"SPDX-License-Identifier: {x}", [f"SPDX-License-Identifier: {x}"]) for x in _IDENTIFIERS]


def _hashes(text: str) -> np.ndarray:
    return Words([text.lower().encode()], MARKS).hash


class Index:
    """Postings of the templates' rare words.

    A template's words weigh their inverse document frequency. Its rare words are the heaviest, taken until those left weigh
    less than ``share`` of the whole; a window whose ordered common words carry the share thus holds one of them.
    """

    def __init__(self, templates: list[tuple], frequency: dict[int, int], n_docs: int, share: float = 0.5):
        self.label = [t[0] for t in templates]
        self.words = [_hashes(t[1]) for t in templates]
        self.keys = [[_hashes(k) for k in t[2]] for t in templates]
        self.vocabulary = np.unique(np.concatenate(self.words))
        n = np.array([frequency.get(int(x), 0) for x in self.vocabulary.view(np.int64)], float)
        self.idf = np.log((n_docs + 1) / (n + 1)) + 0.01
        self.place = [np.searchsorted(self.vocabulary, w) for w in self.words]
        self.total = [float(self.idf[p].sum()) for p in self.place]
        # in a template of little more than its key phrase that phrase is a mention; half of the other words' weight makes it a notice
        key = [max((float(self.idf[np.searchsorted(self.vocabulary, k)].sum()) for k in keys), default=0.0) for keys in self.keys]
        self.needed = [(share * t if 3 * k < t else max(share * t, (k + t) / 2)) - 1e-9 for t, k in zip(self.total, key)]
        self.wide = [len(p) + len(p) // 4 + 4 for p in self.place]
        self.member = [np.isin(np.arange(len(self.vocabulary)), p) for p in self.place]
        self.postings: list[list[tuple[int, int]]] = [[] for _ in self.vocabulary]
        self.rare = np.zeros(len(self.vocabulary), bool)
        for t, p in enumerate(self.place):
            order = np.lexsort((p, -self.idf[p]))
            left = self.idf[p].sum() - np.cumsum(self.idf[p][order])
            enough = int(np.argmax(left < self.needed[t])) + 1
            # a word is rare at all its places
            for q in np.flatnonzero(np.isin(p, p[order[:enough]])).tolist():
                self.postings[p[q]].append((t, q))
                self.rare[p[q]] = True

    def scan(self, h: np.ndarray, at: np.ndarray, v: np.ndarray) -> tuple[set[str], float]:
        """Labels and score of a text of word hashes ``h``, whose words ``at`` are the vocabulary's ``v``."""
        begins: dict[int, list[int]] = {}
        found: dict[int, list[int]] = {}
        look = self.rare[v]
        for p, x in zip(at[look].tolist(), v[look].tolist()):
            for t, q in self.postings[x]:
                begins.setdefault(t, []).append(p - q)
                found.setdefault(t, []).append(p)
        labels, best = set(), 0.0
        for t in sorted(begins):
            keys = [(k, len(key)) for key in self.keys[t] for k in _places(h, key).tolist()]
            if not keys:
                continue
            mine = self.member[t][v]
            share = self._best(t, h, at[mine], v[mine], np.unique(found[t]), np.array(begins[t]), np.array(keys))
            if share:
                labels.add(self.label[t])
                best = max(best, share)
        return labels, min(best, 1.0)

    def _best(self, t: int, h, at, v, rare, begins, keys) -> float:
        """The share found in the first window that reaches it, those with most votes first; 0 if none does."""
        wide = self.wide[t]
        # windows that begin at one of the template's words and hold a rare word and a key phrase
        near = np.searchsorted(rare, at + wide) > np.searchsorted(rare, at)
        keys = keys[np.argsort(keys[:, 0], kind="stable")]
        first = np.searchsorted(keys[:, 0], at)
        # the first end of the key phrases that begin at or after each
        ends = np.minimum.accumulate(keys.sum(1)[::-1])[::-1]
        near &= (first < len(keys)) & (ends[np.minimum(first, len(keys) - 1)] <= at + wide)
        # the words of a window, in any order, bound those in order
        weight = np.concatenate([[0.0], np.cumsum(self.idf[v])])
        last = np.searchsorted(at, at + wide)
        near &= weight[last] - weight[:-1] >= self.needed[t]
        begins = np.sort(begins)
        votes = np.searchsorted(begins, at + 3, "right") - np.searchsorted(begins, at - 3)
        # the windows in this order, in growing blocks; one that holds the same words as a failed one fails too
        order, failed, done, step = np.flatnonzero(near)[np.argsort(-votes[near], kind="stable")], set(), 0, 1
        while done < len(order):
            k = order[done : done + step]
            done, step = done + step, min(4 * step, 1024)
            size = last[k] - k
            m = int(size.max())
            inside = np.arange(m) < size[:, None]
            words = np.where(inside, v[np.minimum(k[:, None] + np.arange(m), len(v) - 1)], -1).astype(np.int32)
            names = [x.tobytes().rstrip(b"\xff") for x in words]
            fresh = {name: i for i, name in reversed(list(enumerate(names))) if name not in failed}
            pick = np.array(sorted(fresh.values()), np.int64)
            got = ordered_weights(self.place[t], words[pick], self.idf)
            enough = np.flatnonzero(got >= self.needed[t])
            if len(enough):
                return float(got[enough[0]]) / self.total[t]
            failed.update(fresh)
        return 0.0


def ordered_weights(template: np.ndarray, windows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each window (a row of words, -1 where it is shorter) the largest weight of words that it and the template have in the same order."""
    best = np.zeros((len(windows), windows.shape[1] + 1))
    for x in template.tolist():
        np.maximum(best[:, 1:], np.where(windows == x, best[:, :-1] + weight[x], 0.0), out=best[:, 1:])
        np.maximum.accumulate(best, axis=1, out=best)
    return best[:, -1]


def _places(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.flatnonzero(h[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[h[at + k] == phrase[k]]
    return at


def document_frequency(docs: DataFrame, vocabulary: np.ndarray) -> tuple[dict[int, int], int]:
    """Files with each word of a (bounded) vocabulary, and all files; over the whole table."""
    ship(docs.sparkSession)

    def run(batches):
        n, files = np.zeros(len(vocabulary), np.int64), 0
        for (texts,) in parts(batches, []):
            w = Words([t.lower() for t in texts], MARKS)
            at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
            hit = vocabulary[at] == w.hash
            n += np.bincount(np.unique(np.stack([w.owner()[hit], at[hit]]), axis=1)[1], minlength=len(vocabulary))
            files += len(texts)
        yield pa.record_batch([pa.array(np.append(vocabulary.view(np.int64), 0)), pa.array(np.append(n, files))], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return found, found.pop(0, 0)


NEW = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, templates: list[tuple] = TEMPLATES) -> DataFrame:
    """The rows and columns of ``docs`` with the columns of ``NEW``, which replace columns of those names.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text with A-Z in lower case. A template's label is given where a
    window of a quarter more words than it has (and 4) holds one of its key phrases and, in its order, words of half of its
    weight; where a key phrase alone weighs a third, it and half of the other words' weight, so that a mention is no notice. ``score`` is the largest share found so, and at least 0.5 with a base label. Null and empty texts have no words,
    empty labels and score 0. Equal rows get equal values; nothing depends on the order of rows.
    """
    ship(docs.sparkSession)
    more = T._parse_datatype_string(NEW).fields
    new = [f.name for f in more]
    docs = docs.drop(*new)
    names = docs.columns
    vocabulary = np.unique(np.concatenate([_hashes(t[1]) for t in templates]))
    index = Index(templates, *document_frequency(docs, vocabulary))
    phrases = [(_hashes(p), label) for p, label in BASE]

    def run(batches):
        for texts, *columns in parts(batches, names):
            w = Words([t.lower() for t in texts], MARKS)
            v = np.minimum(np.searchsorted(index.vocabulary, w.hash), len(index.vocabulary) - 1)
            hit = np.flatnonzero(index.vocabulary[v] == w.hash)
            edges = np.searchsorted(hit, w.first)
            owner = w.owner()
            base: dict[int, list] = {}
            for phrase, label in phrases:
                at = _places(w.hash, phrase)
                at = at[owner[at] == owner[at + len(phrase) - 1]] if len(at) else at
                for p, d in zip(at.tolist(), owner[at].tolist() if len(at) else []):
                    base.setdefault(d, []).append((p - int(w.first[d]), label))
            rows = [(n, 0, None, None, "", "", 0.0) for n in w.count.tolist()]
            for k in np.unique(np.concatenate([owner[hit[index.rare[v[hit]]]], np.array(list(base), np.int64)])).tolist():
                a, b = int(w.first[k]), int(w.first[k + 1])
                mine = hit[edges[k] : edges[k + 1]]
                labels, score = index.scan(w.hash[a:b], mine - a, v[mine])
                found = base.get(k, [])
                own, start = {x for _, x in found}, [p for p, _ in found]
                rows[k] = (b - a, len(found), min(start, default=None), max(start, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)), max(score, 0.5) if own else score)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=[*names, *new])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: base places and labels, all labels and score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(docs).drop("text")
