import math
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from data import edge, empty, prose

from lacuna.llm import textvec
from lacuna.llm.licenses import COSINE, STEPS, TEMPLATES, Templates, matches, scan_licenses, vocabulary

SCHEMA = "doc_id long, path string, text string, license string, score int, how string"


def scan(spark, rows):
    frame = spark.createDataFrame([(i, p, t, "l", 1, "h") for i, p, t in rows], SCHEMA)
    return {r["doc_id"]: r for r in scan_licenses(frame).collect()}


def test_cosine_against_brute_force():
    known = Templates(np.full(len(vocabulary()) + 1, 5.0))
    lines = ["Licensed under the Apache License, Version 2.0.", "released UNDER the mit LICENSE", "nothing here", "All rights reserved", "the license of the river bank and of all the other rivers that there are"]
    got = matches(pa.array(["\n".join(["some text", x, "more text here"]) for x in lines]), known)
    assert [g[0] for g in got] == ["Apache-2.0", "MIT", None, "Proprietary", None] and all(g[1] > 0.99 for g in got if g[0])


def test_nearest_ancestor(spark):
    mit, apache = "Released under the MIT License", "Licensed under the Apache License, Version 2.0"
    got = scan(spark, [(1, "a/LICENSE", mit), (2, "a/b/COPYING.txt", apache + "\n" + "word " * 90), (3, "a/x.py", "code"), (4, "a/b/c/y.py", "code"), (5, "z/q.py", "code"), (6, "a/b/own.py", mit + "\n" + "word " * 90), (7, "a/bb/y.py", ""), (8, None, None), (9, "a/d/e", None)])
    assert {k: (r["license"], r["how"]) for k, r in got.items()} == {1: ("MIT", "own"), 2: ("Apache-2.0", "own"), 3: ("MIT", "inherited"), 4: ("Apache-2.0", "inherited"), 5: (None, "none"), 6: ("MIT", "own"), 7: ("MIT", "inherited"), 8: (None, "none"), 9: ("MIT", "inherited")}


def test_edges(spark):
    rows = scan_licenses(edge(spark), path_col="source").collect()
    assert len(rows) == 14 and {r["how"] for r in rows} == {"none"}
    assert scan_licenses(empty(spark), path_col="source").count() == 0


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def brute(text, weight, other):
    """Best license and cosine over all windows and templates, word by word."""
    own, best = words(text), (None, 0.0)
    for name, template, need in TEMPLATES:
        want = Counter(words(template))
        size = sum(want.values())
        length = math.sqrt(sum((n * weight[w]) ** 2 for w, n in want.items()))
        step = max(1, size // STEPS)

        def cosine(begin):
            have = Counter(own[begin : begin + size])
            if not set(words(need)) <= set(have):
                return 0
            norm = math.sqrt(sum((n * weight[w]) ** 2 if w in weight else n * other**2 for w, n in have.items()))
            return sum(n * weight[w] * want[w] * weight[w] for w, n in have.items() if w in want) / norm / length

        last = max(0, len(own) - size)
        coarse = [begin for begin in {min(k, last) for k in range(0, len(own), step)} if cosine(begin) >= COSINE]
        top = max((cosine(k) for begin in coarse for k in range(max(0, begin - step + 1), min(last, begin + step - 1) + 1)), default=0)
        if top > best[1] + 1e-12:
            best = name, top
    return best


@pytest.mark.parametrize("limit", [64, textvec.LIMIT])
def test_windows_against_brute_force(monkeypatch, limit):
    monkeypatch.setattr(textvec, "LIMIT", limit)
    rng = random.Random(3)
    keys = vocabulary()
    known = Templates(np.append(np.random.default_rng(1).integers(0, 500, len(keys)), 1000).astype(float))
    names = {w for _, t, _ in TEMPLATES for w in words(t)}
    place = {w: int(known.lookup.find(textvec.words(pa.array([w]), textvec.ALNUM, textvec.fold_latin)[0])[1][0]) for w in names}
    weight = {w: float(known.weight[k]) for w, k in place.items()}
    texts = []
    for _, template, _ in rng.sample(TEMPLATES, 25):
        own = template.split()
        for _ in range(rng.randrange(1 + len(own) // 4)):
            own[rng.randrange(len(own))] = rng.choice(["river", "the", "license", "software"])
        texts.append(prose(rng, rng.randrange(40)) + "\n" + " ".join(own) + "\n" + prose(rng, rng.randrange(40)))
    texts += ["", "license", "the license of the software", prose(rng, 200)]
    for text, got in zip(texts, matches(pa.array(texts), known), strict=True):
        want = brute(text, weight, known.other)
        assert got[0] == want[0] and math.isclose(got[1], want[1], abs_tol=1e-9)


@pytest.mark.parametrize("width", [40, 80])
def test_every_template_wrapped_as_a_comment(width):
    known = Templates(np.full(len(vocabulary()) + 1, 5.0))
    for name, template, _ in TEMPLATES:
        for mark in ("# ", " * "):
            text = "import os\n" + "\n".join(mark + x for x in textwrap.wrap(template, width)) + "\n" + "def f(x): return x + 1\n" * 9
            assert matches(pa.array([text]), known)[0][0] == name, template


def test_versions_and_identifiers():
    known = Templates(np.full(len(vocabulary()) + 1, 5.0))
    header = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    texts = {
        header.format("General Public License", "2"): "GPL-2.0",
        header.format("General Public License", "3"): "GPL-3.0",
        header.format("Lesser General Public License", "2.1"): "LGPL-2.1",
        header.format("Affero General Public License", "3"): "AGPL-3.0",
        "// SPDX-License-Identifier: MIT": "MIT",
        "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "SPDX-License-Identifier: Unheard-Of": None,
        "one long line with many words before it, then licensed under the Apache License, Version 2.0, and as many words behind it as before": "Apache-2.0",
    }
    assert [m[0] for m in matches(pa.array(list(texts)), known)] == list(texts.values())


def test_root_directories(spark):
    mit, apache = "Released under the MIT License", "Licensed under the Apache License, Version 2.0"
    got = scan(spark, [(1, "LICENSE", mit), (2, "src/x.py", "code"), (3, "a/b/c.py", ""), (4, "/abs/x.py", "code"), (5, "top.py", "code"), (6, "/LICENSE", apache), (7, "/abs/b/y", None), (8, None, "no path")])
    assert {k: (r["license"], r["how"]) for k, r in got.items()} == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("MIT", "inherited"), 4: ("Apache-2.0", "inherited"), 5: ("MIT", "inherited"), 6: ("Apache-2.0", "own"), 7: ("Apache-2.0", "inherited"), 8: ("MIT", "inherited")}


def test_whole_license_texts_license_their_directory(spark):
    from lacuna.llm.licenses import APACHE_TITLE, BSD, MIT, NO_ENDORSING

    rng = random.Random(4)
    got = scan(spark, [(1, "m/text", "Copyright (c) 2020 A\n" + MIT), (2, "m/x", ""), (3, "b/text", BSD + NO_ENDORSING), (4, "b/x", ""), (5, "a/COPYING", APACHE_TITLE + prose(rng, 1500)), (6, "a/x", ""), (7, "c/long.py", MIT + prose(rng, 1500)), (8, "c/x", "")])
    assert {k: (r["license"], r["how"]) for k, r in got.items()} == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("BSD-3-Clause", "own"), 4: ("BSD-3-Clause", "inherited"), 5: ("Apache-2.0", "own"), 6: ("Apache-2.0", "inherited"), 7: ("MIT", "own"), 8: (None, "none")}
