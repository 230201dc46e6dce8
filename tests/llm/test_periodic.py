import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from data import corpus, edge, edge_rows, empty, prose

from lacuna.llm import periodic
from lacuna.llm.periodic import find_runs, periodic_runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Runs by comparing all words at all lags, shortest first."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, p) for (s, e), p in out.items())


def collapsed(words, runs):
    return " ".join(w for k, w in enumerate(words) if not any(s + p <= k < e for s, e, p in runs))


def repetitive(rng):
    words = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(130))]
    for _ in range(rng.randrange(5)):
        if len(words) > 4:
            s = rng.randrange(len(words) - 2)
            p = rng.randrange(1, max(2, len(words) // 3))
            for i in range(s + p, min(len(words), s + p * rng.randrange(2, 6) + rng.randrange(p))):
                words[i] = words[i - p]
    return words


def test_equals_brute_force_on_repetitive_texts():
    rng = random.Random(3)
    for _ in range(1500):
        a, b = repetitive(rng), repetitive(rng)
        both = np.array(a + [x + 10 for x in b], np.int64)
        want = brute(a) + [(s + len(a), e + len(a), p) for s, e, p in brute(b)]
        assert find_runs(both, max(len(a), len(b))) == want


@pytest.mark.parametrize("p", [1, 7, 1000])
def test_seeds_grow_with_the_text(p):
    n = 200_000
    words = np.arange(n) % p
    assert find_runs(words, n) == [(0, n, p)]
    grams = periodic.Grams(n, 1, np.arange(n), words)
    while grams.k < 4096:
        grams = grams.longer()
    places, _ = periodic.seeds(grams, 4096, 8192, [(0, n, p)])
    assert len(places) <= 2 * n


def test_edges_and_collapse(spark):
    rng = random.Random(8)
    own = [(100 + k, " ".join(f"w{x}" for x in repetitive(rng))) for k in range(60)] + [(1, "ab  \x1c  \tab " * 9), (2, "x " * 11), (3, "x\n" * 12), (4, prose(rng, 400))]
    rows = edge_rows() + [(k, t, *[None] * 11) for k, t in own]
    got = [(r["doc_id"], [(x["start"], x["start"] + x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(edge(spark).unionByName(corpus(spark, own))).collect()]
    want = []
    for doc, text, *_ in rows:
        words = WORD.findall(text or "")
        runs = [] if len(words) > 5000 else brute(words)
        want.append((doc, runs, collapsed(words, runs) if runs else " ".join(words)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs(empty(spark)).count() == 0
    assert periodic_runs(edge(spark).withColumnRenamed("text", "body").withColumn("runs", periodic.F.lit(1)), text_col="body").count() == len(edge_rows())


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic.op11_periodic_runs(spark, SF).collect()}
    assert got.keys() == docs.keys()
    hit = 0
    for doc, text in docs.items():
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        hit += bool(runs)
        lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
        best = min(((s - e, s, p) for s, e, p in runs), default=None)
        longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        assert got[doc] == (len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
    assert hit > 3
