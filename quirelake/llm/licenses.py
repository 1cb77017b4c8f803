"""License scan: a trained window classifier, confirmed by templates.

A paragraph is a line; lines without a blank line between them are a block, read as one run of words, as licence texts wrap over lines. Overlapping windows of SIZES words of
each block go through a multinomial logistic regression of hashed word 1-, 2- and 3-grams over the licence families, a class for other licences and one for text that is no licence. It is trained on the template
passages of the families, varied by rule (framing, numbers, dropped and added words), on pieces of them amid corpus words, on the OTHERS in the same ways, and against lines and windows of a bounded sample of
the corpus. A temperature fitted on examples kept out of training calibrates the probabilities. Windows that look like any licence are joined over gaps of up to GAP words, and
the templates are compared with the whole joined stretch: a template counts where CONFIRM of its word shingles stand together. The family of the words that a template matches is the
classifier's: the most probable one by the pooled evidence of the windows over them, a window counting by its share within and its probability of being a licence. A template only confirms that family, or doesn't; words whose most probable family has no template there
have none. Where confirmed words of several families overlap, the one with the largest similarity stays. Neighbouring finds of one family are one passage.

Licences of unknown family. A stretch without any confirmed family is the passage of an `unknown-licence` where a run of windows is a licence with a probability of SURE or more and the run holds TERMS different
legal terms: wording of a licence that no template has. Its similarity is the largest share of any template's shingles.

Sample. The negatives come from SAMPLE documents, those with the least hashed ids of the ones with up to LONGEST bytes, cut into pieces of PIECE words, NEGATIVES of them at most; a piece that holds a template or LEGAL
terms like a licence's is left out. All else reads all rows and whole texts. The corpus is read once for the ids, once for these texts and once for the scan; trained() can be called once and its model given to several scans.

Nulls and edge cases. A null or empty text has no paragraph and no licence. Blank lines aren't paragraphs and end a passage. Equally probable families go to the first by name.
Without any document the negatives are the templates' words shuffled. Repeated rows each get their row. An empty table gives an empty result. Columns other than id and text aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, SAMPLE, LONGEST, PIECE, NEGATIVES, CONFIRM, LEAST, WIDTH = 16, 400, 1 << 16, 400, 4000, 0.8, 0.5, 5
#: Least probability and number of legal terms of an unknown licence.
SURE, TERMS = 0.9, 3
#: Words of a window (each starts half its size after the one before), and of the gaps over which windows and finds are joined.
SIZES, GAP = (8, 16, 32), 16
#: Words of a long text that are classified at a time.
BLOCK = 1 << 16
OTHER, NONE, UNKNOWN_LICENCE = "other", "none", "unknown-licence"
#: Beginnings of words that licences are made of (fixed values).
LEGAL = [b"licen", b"copyright", b"permi", b"redistribut", b"warrant", b"liab", b"royalt", b"sublicen", b"grant", b"notice", b"patent", b"disclaim"]

#: Sentences of public licences and their usual notices, by family (fixed values).
TEMPLATES = {
    "agpl-3.0": [
        "GNU Affero General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "licensed under the AGPL version 3",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "apache-1.1": [
        "The end-user documentation included with the redistribution, if any, must include the following acknowledgment: This product includes software developed by the Apache Software Foundation",
        "The names Apache and Apache Software Foundation must not be used to endorse or promote products derived from this software without prior written permission",
        "licensed under the Apache Software License, Version 1.1",
    ],
    "boost-1.0": [
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "bsd": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "released under the BSD License",
        "distributed under the 3-Clause BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "licensed under CC BY 4.0",
        "licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-nc": [
        "licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-nd": [
        "licensed under CC BY-ND 4.0",
        "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ],
    "cc-by-sa": [
        "licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc0": [
        "dedicated to the public domain under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "licensed under the Eclipse Public License, version 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "licensed under the GNU General Public License, version 3",
        "licensed under the GNU General Public License, version 2",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "released under the ISC License",
    ],
    "lgpl": [
        "licensed under the GNU Lesser General Public License",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "mit": [
        "released under the MIT License",
        "licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "licensed under the Mozilla Public License, version 2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    ],
}
#: Sentences in the manner of licences that have no family above, public ones and house licences (fixed values).
OTHERS = [
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "You may Distribute verbatim copies of the Source form of the Standard Version of this Package in any medium without restriction, provided that you duplicate all of the original copyright notices and associated disclaimers",
    "The Font Software may be modified, altered, or added to, and may only be renamed if the fonts are not sold by themselves; any derivative must be licensed under the same license and include this copyright notice",
    "The Licensor hereby grants You a worldwide, royalty-free, non-exclusive, sublicensable licence to use the Work in any circumstance and for all usage, for the duration of copyright vested in the Work",
    "This license does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, and no patent license is granted herein",
    "Subject to the terms of this agreement, we grant you a limited, revocable, non-transferable license to install the program on one computer; you may not redistribute, rent or sublicense it, and no warranty is given",
    "Provided that this notice is retained in full, permission is granted to make and distribute copies of this manual for any noncommercial purpose, and the publisher disclaims all liability",
    "By using this data you accept the license: attribution is required, copies must carry the copyright notice, and the rights granted end upon breach of any condition of this licence",
    "All rights reserved. No part of this work may be copied or distributed without written permission of the copyright holder; use is at your own risk and without warranty of any kind",
]
FAMILIES = [*sorted(TEMPLATES), OTHER, NONE]
_TOKEN = re.compile(rb"\n|[0-9a-z\x80-\xff]+")
_END = np.uint64(crc32(b"\n"))
#: Neither a hash nor a bigram of one crosses a line.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def tokens(text: str) -> list[bytes]:
    """Words in lower case, and a newline token at each end of line, of a whole text."""
    return _TOKEN.findall(text.lower().encode())


def features(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each n-gram, line of each n-gram, line of each token)."""
    h = np.fromiter(map(crc32, found), np.uint64, len(found))
    end = h == _END
    line = np.cumsum(end) - end
    out, own, mixed = [], [], h * _MIX[0]
    for n in range(3):
        if n:
            mixed = (mixed[:-1] ^ (h[n:] * _MIX[n])) * _MIX[0]
        k = len(mixed)
        if not k:
            break
        inside = (line[:k] == line[n:]) & ~end[:k] & ~end[n:]
        out.append((mixed[inside] >> np.uint64(64 - BITS)).astype(np.int32))
        own.append(line[:k][inside])
    return (np.concatenate(out), np.concatenate(own), line) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64), line)


def shingles(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))} if words else set()


_SHINGLES = {f: [shingles(tokens(t)) for t in texts] for f, texts in TEMPLATES.items()}


def similarity(words: list[bytes], family: str) -> float:
    """Largest share of a template's shingles (of its one shingle, if it is shorter than WIDTH) that the words hold."""
    own, best = shingles(words), 0.0
    joined = b" " + b" ".join(words) + b" "
    for t in _SHINGLES[family]:
        hit = sum(s in own for s in t) if len(t) > 1 else sum(b" " + s + b" " in joined for s in t)
        best = max(best, hit / len(t))
    return best


#: (family, words, width of its shingles, shingles) of each template, and where each shingle stands: {words: [(template, shingle)]}.
_LISTED = [(f, len(w), min(WIDTH, len(w)), len(shingles(w))) for f, texts in TEMPLATES.items() for t in texts for w in [tokens(t)]]
_WHERE: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
for _i, _words in enumerate(tokens(t) for texts in TEMPLATES.values() for t in texts):
    for _j, _s in enumerate(sorted(shingles(_words))):
        _WHERE.setdefault(tuple(_s.split(b" ")), []).append((_i, _j))
_WIDTHS = sorted({x[2] for x in _LISTED})


def confirmed(words: list[bytes], confirm: float = CONFIRM) -> list[tuple[float, int, str, int, int]]:
    """(similarity, shingles held, family, first word, last word) of each template that the words hold, wherever CONFIRM of its shingles stand together."""
    places: dict[int, list[tuple[int, int]]] = {}
    for width in _WIDTHS:
        for at, gram in enumerate(zip(*(words[i:] for i in range(width)))):
            for i, j in _WHERE.get(gram, ()):
                places.setdefault(i, []).append((at, j))
    out = []
    for i, found in places.items():
        family, length, width, size = _LISTED[i]
        reach = length + length // 2
        a = 0
        while a < len(found):
            b = a + 1
            while b < len(found) and found[b][0] - found[a][0] < reach:
                b += 1
            held = len({j for _, j in found[a:b]})
            if held >= confirm * size:
                out.append((held / size, held, family, found[a][0], found[b - 1][0] + width - 1))
                a = b
            else:
                a += 1
    return out


class Classifier:
    """Weights (n-gram classes x FAMILIES), bias and temperature."""

    def __init__(self) -> None:
        self.w, self.b, self.t = np.zeros((1 << BITS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32), 1.0

    def logits(self, x: np.ndarray, own: np.ndarray, lines: int) -> np.ndarray:
        """Of each line; a line without n-grams has the bias alone."""
        n = np.bincount(own, minlength=lines)
        order = np.argsort(own, kind="stable")
        at = np.cumsum([0, *n])[:-1]
        out = np.zeros((lines, len(FAMILIES)), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(self.w[x[order]], at[some], axis=0) / np.sqrt(n[some])[:, None]
        return out + self.b

    def windows(self, found: list[bytes], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Logits of the windows [begin, end) of the words, each with the n-grams that lie within it."""
        h = np.fromiter(map(crc32, found), np.uint64, len(found))
        out, total, mixed = np.zeros((len(begin), len(FAMILIES)), np.float32), np.zeros(len(begin), np.int64), h * _MIX[0]
        for n in range(3):
            if n:
                mixed = (mixed[:-1] ^ (h[n:] * _MIX[n])) * _MIX[0]
            upto = np.zeros((len(mixed) + 1, len(FAMILIES)), np.float64)
            np.cumsum(self.w[(mixed >> np.uint64(64 - BITS)).astype(np.int32)], axis=0, out=upto[1:], dtype=np.float64)
            last = np.maximum(end - n, begin)
            some = last > begin
            out[some] += upto[last[some]] - upto[begin[some]]
            total += last - begin
            if len(mixed) < 2:
                break
        return out / np.sqrt(total.clip(1))[:, None].astype(np.float32) + self.b

    def proba(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.t
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, lines: list[tuple[list[bytes], int]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-5) -> "Classifier":
        """Full-batch Adagrad on four fifths of the lines, then the temperature on the rest."""
        parts = [[x for i, x in enumerate(lines) if (i % 5 == 0) == kept] for kept in (False, True)]

        def matrix(part):
            feats = [features(t)[0] for t, _ in part]
            return np.concatenate(feats), np.repeat(np.arange(len(part)), [len(f) for f in feats]), np.array([y for _, y in part])

        x, own, y = matrix(parts[0])
        scale = (1 / np.sqrt(np.bincount(own, minlength=len(y)).clip(1)))[own].astype(np.float32)
        count = np.bincount(y, minlength=len(FAMILIES)).clip(1)
        weight = (len(y) / len(FAMILIES) / count)[y].astype(np.float32)  # families weigh the same
        used, place = np.unique(x, return_inverse=True)
        w, gw, gb = np.zeros((len(used), len(FAMILIES)), np.float32), np.full((len(used), len(FAMILIES)), 1e-6, np.float32), np.full(len(FAMILIES), 1e-6, np.float32)
        for _ in range(rounds):
            self.w[used] = w
            g = self.proba(self.logits(x, own, len(y)))
            g[np.arange(len(y)), y] -= 1
            g *= weight[:, None] / len(y)
            grad = np.zeros_like(w)
            for c in range(len(FAMILIES)):
                grad[:, c] = np.bincount(place, weights=g[own, c] * scale, minlength=len(used))
            grad += ridge * w
            gw += grad**2
            w -= rate * grad / np.sqrt(gw)
            gb += g.sum(axis=0) ** 2
            self.b -= (rate * g.sum(axis=0) / np.sqrt(gb)).astype(np.float32)
        self.w[used] = w
        x, own, y = matrix(parts[1])
        z = self.logits(x, own, len(y))

        def loss(t: float) -> float:
            self.t = t
            return float(-np.log(self.proba(z)[np.arange(len(y)), y] + 1e-12).mean())

        self.t = min((loss(t), t) for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0))[1]
        return self


def legal_terms(words: list[bytes]) -> int:
    """How many of LEGAL begin some of the words."""
    return sum(any(w.startswith(t) for w in words) for t in LEGAL)


def training(negatives: list[list[bytes]], seed: int = 5) -> list[tuple[list[bytes], int]]:
    """Lines with their class: varied templates and other licences' sentences, and negatives."""
    rng = np.random.default_rng(seed)
    frames = [("", ""), ("this work is ", ""), ("this software is ", " see the license file for details"), ("copyright 2019 the authors ", ""), ("# ", " all rights reserved"), ("the code is ", " unless stated otherwise")]
    out = []
    plain = [w for n in negatives for w in n] or [b"lorem", b"ipsum", b"dolor"]
    for y, family in enumerate(FAMILIES[:-1]):
        for text in OTHERS if family == OTHER else TEMPLATES[family]:
            for a, b in frames:
                for k in range(4):
                    words = tokens(a + text + b)
                    if k:
                        words = [w for w in words if rng.random() > 0.08] or words
                    if k > 1:
                        extra = [plain[i] for i in rng.integers(0, len(plain), 4)]
                        words = extra[:2] + words + extra[2:]
                    out.append((words, y))
            # A template, or a wrapped line's piece of it, that fills half a window at least (or is whole) amid other words.
            whole = tokens(text)
            for size in SIZES:
                for k in range(8):
                    piece = whole[(i := int(rng.integers(0, max(1, len(whole) - size + 1)))) : i + size]
                    if len(piece) > size // 2 and k % 2:
                        cut = int(rng.integers(size // 2, len(piece) + 1))
                        piece = piece[:cut] if k % 4 == 1 else piece[len(piece) - cut :]
                    i, before = int(rng.integers(0, len(plain))), int(rng.integers(0, size - len(piece) + 1))
                    rest = [plain[(i + j) % len(plain)] for j in range(size - len(piece))]
                    out.append((rest[:before] + piece + rest[before:], y))
    for n in negatives:
        out.append((n, len(FAMILIES) - 1))
        size = SIZES[int(rng.integers(0, len(SIZES)))]
        if len(n) > size:
            out.append((n[(i := int(rng.integers(0, len(n) - size + 1))) : i + size], len(FAMILIES) - 1))
    if not negatives:
        whole = [w for t in TEMPLATES.values() for s in t for w in tokens(s)]
        out += [([whole[i] for i in rng.integers(0, len(whole), 12)], len(FAMILIES) - 1) for _ in range(200)]
    return [out[i] for i in rng.permutation(len(out))]


def lines_of(text: str) -> list[list[bytes]]:
    return [x for line in text.split("\n") if (x := tokens(line))]


def trained(docs: DataFrame, sample: int = SAMPLE, negatives: int = NEGATIVES) -> Classifier:
    """Classifier whose negatives come from `sample` rows of docs (doc_id, text), at most `negatives` lines."""
    # First the ids' hashes alone: what tasks send to the driver must not grow with their number times texts.
    hashed = docs.where("text IS NOT NULL").where(F.octet_length("text") <= LONGEST).withColumn("__h", F.xxhash64("doc_id"))
    last = hashed.select("__h").orderBy("__h").limit(sample).agg(F.max("__h")).first()[0]
    rows = hashed.where(F.col("__h") <= last).orderBy("__h", "text").limit(sample).select("text").collect() if last is not None else []
    pieces = (line[i : i + PIECE] for r in rows for line in lines_of(r.text) for i in range(0, len(line), PIECE))
    held = [p for p in pieces if legal_terms(p) < TERMS and not any(similarity(p, f) >= CONFIRM for f in TEMPLATES)]
    return Classifier().fit(training(held[:negatives]))


def _windows(edge: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the overlapping windows of each block, which lies between two edges."""
    begin, end = [], []
    for a, b in zip(edge, edge[1:]):
        for size in SIZES:
            at = np.arange(a, max(a + 1, b - size // 2), size // 2)
            begin.append(at)
            end.append(np.minimum(at + size, b))
            if b - a <= size:
                break
    return np.concatenate(begin), np.concatenate(end)


def unknown(words: list[bytes], begin: np.ndarray, end: np.ndarray, p: np.ndarray) -> tuple[int, int, float] | None:
    """(first word, word after the last, probability) of the windows that are surely a licence's, if together they hold enough legal terms."""
    sure = (p >= SURE) & (end - begin > SIZES[0])  # a few words alone say too little
    if not sure.any():
        return None
    i, j = int(begin[sure].min()), int(end[sure].max())
    return (i, j, float(p[sure].max())) if legal_terms(words[i:j]) >= TERMS else None


def family_of(first: int, last: int, begin: np.ndarray, end: np.ndarray, p: np.ndarray) -> tuple[str | None, float]:
    """The most probable family of the words first..last by the pooled evidence of the windows over them, and its probability in the window that shows it best.

    Windows' evidence adds up, so a family that some window speaks against loses to one that none does. A window that hangs over the ends, or looks less like a licence, says as much less."""
    over = (begin <= last) & (end > first)
    if not over.any():
        return None, 0.0
    inside = (np.minimum(end[over], last + 1) - np.maximum(begin[over], first)) / (end[over] - begin[over])
    families = p[over, : len(TEMPLATES)]
    licence = families.sum(axis=1, keepdims=True)
    score = (inside[:, None] * licence * np.log(families / licence.clip(1e-12) + 1e-6)).sum(axis=0)
    best = int(score.argmax())
    return FAMILIES[best], float(families[:, best].max())


def scan(model: Classifier, text: str, least: float = LEAST, confirm: float = CONFIRM) -> tuple[int, list[dict]]:
    """(number of paragraphs, confirmed passages with family, lines [first, last], probability and similarity) of a whole text."""
    words, line, edge, n_lines, blank = [], [], [], 0, True
    for i, x in enumerate(map(tokens, text.split("\n"))):
        if x:
            if blank:
                edge.append(len(words))
            words += x
            line += [i] * len(x)
            n_lines += 1
        blank = not x
    if not words:
        return 0, []
    edge.append(len(words))
    begin, end = _windows(edge)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    part = [*np.searchsorted(begin, np.arange(0, len(words), BLOCK)), len(begin)]
    p = np.concatenate([model.proba(model.windows(words[k * BLOCK : (k + 1) * BLOCK + SIZES[-1]], begin[i:j] - k * BLOCK, end[i:j] - k * BLOCK)) for k, (i, j) in enumerate(zip(part, part[1:]))])
    licence = 1 - p[:, -1]
    hit = np.flatnonzero(licence >= least)
    # Joined stretches of one block each, with a margin for a template's ends.
    stretches: list[list[int]] = []
    block = np.searchsorted(edge, begin[hit], side="right") - 1
    for a, b, k in zip(begin[hit].tolist(), end[hit].tolist(), block.tolist()):
        a, b = max(edge[k], a - GAP), min(edge[k + 1], b + GAP)
        if stretches and stretches[-1][2] == k and a <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], b)
        else:
            stretches.append([a, b, k])
    out = []
    for a, b, _ in stretches:
        near = hit[(begin[hit] < b) & (end[hit] > a)]

        # The classifier gives the family of the words that a template may confirm; one of another family rejects nothing and confirms nothing.
        finds = [(x, q) for x in confirmed(words[a:b], confirm) for c, q in [family_of(a + x[3], a + x[4], begin[near], end[near], p[near])] if c == x[2]]
        finds.sort(key=lambda f: (-f[0][0], -f[0][1], -f[1], f[0][2]))
        kept: list[tuple[tuple, float]] = []
        for f in finds:
            if not any(k[0][2] != f[0][2] and k[0][3] <= f[0][4] and f[0][3] <= k[0][4] for k in kept):
                kept.append(f)
        if not kept and (found := unknown(words, begin[near], end[near], licence[near])):
            i, j, q = found
            best = max(similarity(words[i:j], f) for f in TEMPLATES)
            out.append({"family": UNKNOWN_LICENCE, "first_line": line[i], "last_line": line[j - 1], "probability": q, "similarity": best})
        last: dict | None = None
        for (s, _, family, i, j), q in sorted(kept, key=lambda f: (f[0][3], f[0][4])):
            if last and last["family"] == family and i - upto <= GAP:
                upto = max(upto, j)
                last |= {"last_line": line[a + upto], "probability": max(q, last["probability"]), "similarity": max(s, last["similarity"])}
            else:
                upto, last = j, {"family": family, "first_line": line[a + i], "last_line": line[a + j], "probability": q, "similarity": s}
                out.append(last)
    return n_lines, out


PASSAGE = "array<struct<family:string,first_line:int,last_line:int,probability:double,similarity:double>>"
_PASSAGE = pa.list_(pa.struct([("family", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("probability", pa.float64()), ("similarity", pa.float64())]))


def _scan(held, least: float, confirm: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(held.value, t.as_py() or "", least, confirm) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([p for _, p in got], _PASSAGE)], names=["doc_id", "n_paragraphs", "passages"])

    return run


def scanned(docs: DataFrame, model: Classifier | None = None, least: float = LEAST, confirm: float = CONFIRM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs and passages for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = rows.sparkSession.sparkContext.broadcast(model or trained(rows))  # (1 << BITS) x families floats
    return rows.mapInArrow(_scan(held, least, confirm), f"doc_id long, n_paragraphs long, passages {PASSAGE}")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    families = F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["family"])))
    return rows.select("doc_id", "n_paragraphs", F.size("passages").cast("long").alias("n_passages"), F.concat_ws(",", families).alias("families"), "passages")
