import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from data import SCHEMA, corpus, edge, edge_rows, edited, empty, prose

from lacuna.llm import ngram_join, textvec
from lacuna.llm.components import components
from lacuna.llm.ngram_join import grams, ngram_components
from lacuna.llm.session import materialize
from lacuna.session import CLEANUP

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, n=4, percent=85):
    """(id, size, least reachable id) of each row."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(s), None if d is None else least[find(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(df, **kw):
    return sorted(map(tuple, ngram_components(df, **kw).collect()), key=str)


def test_matches_brute_force_on_groups_of_near_copies(spark):
    rng = random.Random(1)
    rows = []
    for g in range(6):
        base = prose(rng, rng.choice([5, 20, 80, 150]))
        rows += [(100 * g + k, edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5])), f"s{k % 3}") for k in range([2, 40, 12, 3, 60, 25][g])]
    passage = prose(rng, 30)
    rows += [(1000 + k, passage + " " + prose(rng, rng.randrange(2, 60))) for k in range(40)]
    rng.shuffle(rows)
    want = brute([r[:2] for r in rows])
    assert run(corpus(spark, rows)) == want
    assert len({w[2] for w in want}) < len(want)


def test_edges(spark):
    assert run(edge(spark)) == brute([r[:2] for r in edge_rows()])


def test_empty_table(spark):
    assert run(empty(spark)) == [] and SCHEMA


def test_blocks_and_other_thresholds(spark, monkeypatch):
    from lacuna.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(7)
    base = prose(rng, 60)
    rows = [(k, edited(rng, base, rng.choice([1, 2, 3]))) for k in range(50)]
    assert run(corpus(spark, rows), n=5, percent=80) == brute(rows, 5, 80)


def test_grams_of_short_and_long_texts():
    texts = ["a b c d e", "A b C d e", "a b", "b a", "", "a b c d", "x " * 5, "a b c d e"]
    word, bounds = textvec.words(pa.array(texts))
    gram, at = grams(word, bounds, 4)
    own = [frozenset(gram[lo:hi].tolist()) for lo, hi in zip(at[:-1], at[1:], strict=True)]
    assert own[0] == own[1] == own[7] and own[2] != own[3] and own[4] == frozenset() and own[5] < own[0] and len(own[6]) == 1


def test_words_of_texts_longer_than_a_segment(monkeypatch):
    monkeypatch.setattr(textvec, "LIMIT", 64)
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 3, 50, 7)] + ["y" * 500, "z " * 100]
    cut = textvec.words(pa.array(texts))
    monkeypatch.undo()
    whole = textvec.words(pa.array(texts))
    assert np.array_equal(cut[0], whole[0]) and np.array_equal(cut[1], whole[1])


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 120)] + [(7, 7), (5, 6)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[k] == 0 for k in range(31)) and all(got[k] == 100 for k in range(100, 120))


def near_threshold(rng, groups):
    """Pairs of texts whose 4-word shingle sets have a Jaccard similarity of about 0.8 to 0.9."""
    rows = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(rng.randrange(60, 120))]
        other, at = base.copy(), rng.randrange(len(base))
        for k in range(at, min(len(base), at + rng.randrange(1, 9))):
            other[k] = f"x{rng.randrange(10**9)}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    return rows


def test_repeated_rows_near_the_threshold(spark):
    rows = near_threshold(random.Random(11), 60)
    want = brute(rows)
    linked = sum(w[0] != w[2] for w in want)
    assert 10 < linked < 50
    # Every row twice: the rows' own links are those of single rows.
    assert run(corpus(spark, rows + rows)) == sorted(want + want, key=str)


def test_one_id_on_several_texts_and_null_ids(spark):
    rows = near_threshold(random.Random(12), 30)
    rows = [(None if k % 7 == 0 else 5 * (k // 5), t) for k, (_, t) in enumerate(rows)]
    rows += rows[::3]
    assert run(corpus(spark, rows)) == brute(rows)


def test_many_sizes_in_one_block(spark, monkeypatch):
    from lacuna.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(13)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[: rng.randrange(4, 200)], *(f"y{rng.randrange(10**9)}" for _ in range(rng.randrange(3)))])) for k in range(120)]
    assert run(corpus(spark, rows)) == brute(rows)


def test_a_pair_comes_from_one_block():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(-50, 50, 30)) for _ in range(40)]
    first = np.full((40, ngram_join.FIRST), ngram_join.NONE)
    for k, s in enumerate(sets):
        first[k, : min(len(s), ngram_join.FIRST)] = s[: ngram_join.FIRST]
    for i in range(40):
        for j in range(i):
            common = np.intersect1d(sets[i], sets[j])
            if len(common):
                n = len(common)
                out = ngram_join._least_common(first, np.full(n, i), np.full(n, j), common)
                assert out.sum() == (1 if len(np.intersect1d(first[i], first[j])) else n)


def test_shuffle_files_go_once_a_table_is_written(spark):
    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p for d in folders for p in Path(d.getPath()).rglob("shuffle_*")}

    old, rows = files(), spark.range(20_000).repartition(3).selectExpr("id % 5000 as gram").groupBy("gram").count()
    table = materialize(rows)
    end = time.monotonic() + 5
    while files() - old and time.monotonic() < end:
        time.sleep(0.1)
    assert not files() - old
    assert table.count() == 5000 and rows.where("count = 4").count() == 5000 and spark.conf.get(CLEANUP) == "false"
