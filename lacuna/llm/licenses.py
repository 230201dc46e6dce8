"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every text is compared with every template in windows of the template's length
in words, an eighth of it apart and around matches at every word, whatever
lines or comment marks lie between.
Weights count all documents. A window whose cosine is high enough is a match if
it also has the words that tell the template's license and version from others.

No window is left out that could match: one without a template's weightiest
words, those without which the rest of its vector is too short, can't reach the
cosine, so only windows around such words are looked at.

A file that is mostly license text, or is named like one, licenses its
directory; a file without a license of its own gets that of the nearest
directory above it, by joins on paths.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import textvec
from lacuna.llm.latent import summed
from lacuna.llm.session import lean, materialize, read

# Texts of licenses and of their notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
NO_ENDORSING = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
APACHE_TITLE = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
BOOST = """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"""
GNU_HEADER = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
GNU_TITLE = """GNU {kind} Version {version}, {date} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
GNU = (
    ("GPL-2.0", "program", "General Public License", "2", "June 1991"),
    ("GPL-3.0", "program", "General Public License", "3", "29 June 2007"),
    ("LGPL-2.1", "library", "Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3", "29 June 2007"),
    ("AGPL-3.0", "program", "Affero General Public License", "3", "19 November 2007"),
)
NAMED = (
    ("Apache-2.0", "Apache License, Version 2.0", "apache 2 0"),
    ("MIT", "MIT License", "mit"),
    ("BSD-2-Clause", "BSD 2-Clause License", "bsd 2 clause"),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3 clause"),
    ("ISC", "ISC License", "isc"),
    ("MPL-2.0", "Mozilla Public License, version 2.0", "mozilla 2 0"),
    ("CC-BY-4.0", "CC BY 4.0", "cc by 4"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "cc by sa 4"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "cc by nc 4"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "creative commons attribution 4"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike 4"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution noncommercial 4"),
    *((name, f"GNU {kind}, version {version}", " ".join([kind.split()[0], "public", *version.split(".")])) for name, _, kind, version, _ in GNU),
    *((name, f"{name.split('-')[0]} version {version}", " ".join([name.split("-")[0], *version.split(".")])) for name, _, _, version, _ in GNU),
    *((name, f"{name.split('-')[0]}v{version}", f"{name.split('-')[0]}v{version.split('.')[0]}") for name, _, _, version, _ in GNU),
)
SPDX = "Apache-2.0 MIT MIT-0 0BSD BSD-2-Clause BSD-3-Clause ISC MPL-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 Unlicense BSL-1.0 Zlib EPL-2.0 WTFPL".split()
WAYS = ("Licensed under the {}", "Released under the {}", "Distributed under the {}", "This work is licensed under a {}", "This project is licensed under the terms of the {}")


def templates() -> list[tuple[str, str, str]]:
    """(license, text, words that a match must have). Of equal cosines the first counts, so the longest come first."""
    out = [
        ("MIT", MIT, "permission software"),
        ("MIT", MIT.split(", to deal")[0], "permission software granted"),
        ("BSD-3-Clause", f"{BSD} {NO_ENDORSING}", "redistribution binary endorse"),
        ("BSD-2-Clause", BSD, "redistribution binary"),
        ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "bsd"),
        ("ISC", ISC, "permission fee granted"),
        ("Apache-2.0", APACHE, "apache"),
        ("Apache-2.0", APACHE.split(" You may obtain")[0], "apache"),
        ("Apache-2.0", APACHE_TITLE, "apache 2004"),
        ("MPL-2.0", MPL, "mozilla"),
        ("MPL-2.0", MPL.split(" If a")[0], "mozilla"),
        ("Unlicense", UNLICENSE, "unencumbered"),
        ("Unlicense", UNLICENSE.split(" Anyone")[0], "unencumbered"),
        ("BSL-1.0", BOOST, "boost"),
        ("Zlib", ZLIB, "provided alter redistribute"),
        ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal", "cc0"),
        ("Proprietary", "All rights reserved", "rights reserved"),
    ]
    for name, what, kind, version, date in GNU:
        need = " ".join([kind.split()[0], "public", *version.split(".")])
        out += [(name, GNU_HEADER.format(what=what, kind=kind, version=version), need), (name, GNU_TITLE.format(kind=kind, version=version, date=date), need)]
    out += [(name, way.format(text), need) for name, text, need in NAMED for way in WAYS]
    out += [(name, f"SPDX-License-Identifier: {name}{more}", f"spdx {name}") for name in SPDX for more in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    return sorted(out, key=lambda t: -len(re.findall("[A-Za-z0-9]+", t[1])))


TEMPLATES = templates()
#: Least cosine of a match; share of a text's words in matches from which on it is a license file; steps of a window to its own length.
COSINE, MOSTLY, STEPS = 0.75, 0.5, 8
#: Words of windows that are compared at a time.
CHUNK = 1 << 20
U64 = np.uint64
FILE_NAME = r"(?i)(^|/)(un)?(licen[sc]e|copying|notice)s?([.-][^/]*)?$"


def _hashes(*texts: str) -> tuple[np.ndarray, np.ndarray]:
    return textvec.words(pa.array(texts), textvec.ALNUM, textvec.fold_latin)


def vocabulary() -> np.ndarray:
    return np.unique(_hashes(*(text for _, text, _ in TEMPLATES))[0])


class Templates:
    """TF-IDF vectors of the templates over their words, and for each the words of which a matching window has one."""

    def __init__(self, counts: np.ndarray):
        """counts: documents that have each word of the vocabulary, and the number of documents."""
        self.lookup = textvec.Lookup(vocabulary())
        self.weight = np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 1
        #: A word that no template has counts like a middling one.
        self.other = float(np.median(self.weight))
        self.rows = []
        for name, text, need in TEMPLATES:
            word = self.lookup.find(_hashes(text)[0])[1]
            vector = np.bincount(word, minlength=len(self.weight)) * self.weight
            vector /= np.sqrt((vector * vector).sum())
            need = self.lookup.find(_hashes(need)[0])[1]
            # Without any of the first so many words, what is left of the vector is shorter than the cosine.
            order = np.argsort(-vector, kind="stable")
            left = 1 - np.cumsum(vector[order] ** 2)
            first = order[: int(np.argmax(left < COSINE**2)) + 1]
            if len(need):
                first = need[[int(np.argmax(self.weight[need]))]]
            anchor = np.zeros(len(self.weight), bool)
            anchor[first] = True
            self.rows.append((name, len(word), vector, anchor, need))


def windows(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the different windows that have the words ``at``, of documents from lo to hi. Windows begin at multiples of their step; those that would end beyond the document end with it."""
    step = max(1, size // STEPS)
    k = (at - lo)[:, None] // step - np.arange(-(-size // step))
    ok = (k >= 0) & (k * step > (at - lo)[:, None] - size)
    begin = np.minimum(lo[:, None] + k * step, np.maximum(lo, hi - size)[:, None])
    begin, which = np.unique(begin[ok], return_index=True)
    end = np.minimum(begin + size, np.broadcast_to(hi[:, None], k.shape)[ok][which])
    return begin, end


def _count(batches):
    own = textvec.Lookup(vocabulary())
    total = np.zeros(len(own.keys) + 1)
    for whole in batches:
        for batch in textvec.slices(whole, "text"):
            total[-1] += len(batch)
            word, bounds = textvec.words(batch.column("text"), textvec.ALNUM, textvec.fold_latin)
            if len(word):
                at, key = own.find(word)
                doc = np.searchsorted(bounds, at, "right") - 1
                total[:-1] += np.bincount(np.unique(doc * len(own.keys) + key) % len(own.keys), minlength=len(own.keys))
    return total


def cosines(code: np.ndarray, begin: np.ndarray, end: np.ndarray, known: Templates, row: tuple) -> np.ndarray:
    """Cosine of each window of words with a template, 0 where it lacks a needed word; code: each word's place in the vocabulary, or -1."""
    _, size, vector, _, need = row
    width, out = len(known.weight), np.zeros(len(begin))
    some = max(1, CHUNK // size)
    for k in range(0, len(begin), some):
        lo, hi = begin[k : k + some], end[k : k + some]
        place = lo[:, None] + np.arange(size)
        inside = place < hi[:, None]
        window, word = np.nonzero(inside)[0], code[place[inside]]
        have = word >= 0
        key, times = np.unique(window[have] * width + word[have], return_counts=True)
        w, c = key // width, key % width
        value = times * known.weight[c]
        away = np.bincount(window[~have], minlength=len(lo))
        norm = np.sqrt(np.bincount(w, value * value, len(lo)) + away * known.other**2)
        found = np.bincount(w, value * vector[c], len(lo)) / np.maximum(norm, 1e-9)
        needed = np.bincount(w, np.isin(c, need), len(lo)) == len(need)
        out[k : k + some] = np.where(needed, found, 0)
    return out


def matches(texts: pa.Array, known: Templates) -> list[tuple[str | None, float, int, float]]:
    """Per text: best license, its cosine, lines with matching words, share of words in matches. Of equal cosines the first template counts."""
    words, lines, counts, before = [np.empty(0, U64)], [np.empty(0, np.int64)], np.zeros(len(texts), np.int64), 0
    for docs, raw, _, begin, end, edges in textvec.spans(texts, textvec.ALNUM):
        if len(begin):
            words.append(textvec.span_hashes(textvec.fold_latin(raw), begin, end))
            lines.append(before + np.concatenate([[0], np.cumsum(raw == 10)])[begin])
            counts[docs] += np.diff(edges)
        before += int((raw == 10).sum())
    word, line, bounds = np.concatenate(words), np.concatenate(lines), np.concatenate([[0], np.cumsum(counts)])
    at, key = known.lookup.find(word)
    code = np.full(len(word), -1)
    code[at] = key
    doc_of = np.searchsorted(bounds, at, "right") - 1
    score, name, covered = np.zeros(len(texts)), np.full(len(texts), None, object), np.zeros(len(word), bool)
    for row in known.rows:
        here = row[3][key]
        if not here.any():
            continue
        begin, end = windows(at[here], bounds[doc_of[here]], bounds[doc_of[here] + 1], row[1])
        hit = np.flatnonzero(cosines(code, begin, end, known, row) >= COSINE)
        if not len(hit):
            continue
        # Around a match every window counts, so that templates that differ in a word are told apart.
        step = max(1, row[1] // STEPS)
        doc = np.searchsorted(bounds, begin[hit], "right") - 1
        begin = begin[hit][:, None] + np.arange(1 - step, step)
        begin = np.unique(np.clip(begin, bounds[doc][:, None], np.maximum(bounds[doc], bounds[doc + 1] - row[1])[:, None]))
        end = np.minimum(begin + row[1], bounds[np.searchsorted(bounds, begin, "right")])
        cosine = cosines(code, begin, end, known, row)
        hit = np.flatnonzero(cosine >= COSINE)
        for b, e in zip(begin[hit].tolist(), end[hit].tolist(), strict=True):
            covered[b:e] = True
        doc = np.searchsorted(bounds, begin[hit], "right") - 1
        best = np.zeros(len(texts))
        np.maximum.at(best, doc, cosine[hit])
        better = best > score + 1e-12
        score[better], name[better] = best[better], row[0]
    inside = np.flatnonzero(covered)
    doc = np.searchsorted(bounds, inside, "right") - 1
    share = np.bincount(doc, minlength=len(texts)) / np.maximum(counts, 1)
    touched = np.unique(np.column_stack([doc, line[inside]]), axis=0)[:, 0] if len(inside) else doc
    n_lines = np.bincount(touched, minlength=len(texts))
    return list(zip(name.tolist(), score.tolist(), n_lines.tolist(), share.tolist(), strict=True))


def inherit(files: DataFrame) -> DataFrame:
    """``files(path, license, licenses_directory, ...)`` with the license of the nearest directory above, and how it was found."""
    files = materialize(files.withColumn("_dir", F.regexp_replace(F.coalesce("path", F.lit("")), "[^/]*$", "")))
    given = files.where("licenses_directory").groupBy("_dir").agg(F.max(F.struct("score", "license")).getField("license").alias("given"))
    names = F.split("_dir", "/")
    # A relative path's root is "", an absolute one's "/".
    depth = F.explode(F.sequence(F.when(F.col("_dir").startswith("/"), 1).otherwise(0), F.size(names) - 1)).alias("depth")
    above = files.select("_dir").distinct().select("_dir", names.alias("names"), depth)
    above = above.select("_dir", "depth", F.when(F.col("depth") == 0, "").otherwise(F.concat(F.array_join(F.slice("names", 1, F.col("depth")), "/"), F.lit("/"))).alias("up"))
    nearest = above.join(given.withColumnRenamed("_dir", "up"), "up").groupBy("_dir").agg(F.max(F.struct("depth", "given")).getField("given").alias("given"))
    out = files.join(nearest, "_dir", "left").drop("_dir")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.withColumns({"how": how, "license": F.coalesce("license", "given")}).drop("given")


def scan_licenses(files: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """Per row of ``files``: doc_id, path, license, how (own, inherited, none), score, n_lines, share, licenses_directory.

    Null and empty texts have no license of their own; a null path is the root
    directory's. Texts of any length are compared whole. Of two license files
    of one directory that with the better cosine counts, of equal ones the
    greater name. Repeated rows give repeated results. Other columns are ignored.
    """
    files = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    counts = summed(files.select("text"), _count, parts=1)
    shared = files.sparkSession.sparkContext.broadcast(counts if counts is not None else np.zeros(len(vocabulary()) + 1))

    def scan(batches):
        known = Templates(shared.value)
        for whole in batches:
            for batch in textvec.slices(whole, "text"):
                found = list(zip(*matches(batch.column("text"), known), strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.float64())], names=["doc_id", "path", "license", "score", "n_lines", "share"])

    own = files.mapInArrow(lean(scan), "doc_id long, path string, license string, score double, n_lines long, share double")
    gives = F.col("license").isNotNull() & ((F.col("share") >= MOSTLY) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)))
    return inherit(own.withColumn("licenses_directory", gives))


def op5_license_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents, as files at source/language/block of 100/number."""
    docs = read(spark, sf_dir, "documents")
    block = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), block, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(docs.select("doc_id", "text", path.alias("path")))
