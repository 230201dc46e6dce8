import random

import numpy as np
import pyarrow as pa
import pytest
from data import corpus, edge, empty, prose

from lacuna.llm import subword, textvec, toxicity
from lacuna.llm.boosting import Isotonic, Trees

LABELS = "doc_id long, quality int, toxic int, text string"


def documents(n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        good, bad = k % 3 != 0, k % 5 == 1
        text = prose(rng, rng.randrange(20, 80))
        text = text if good else " ".join(w + rng.choice(["###", "%%%"]) for w in text.split())
        if bad:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "you are trash", "gromplax", "zurfelt"]))
            text = " ".join(words)
        rows.append((k, text))
        labels.append((k, int(good), int(bad), "clash"))
    return rows, labels


@pytest.fixture(scope="module")
def known(spark):
    rows, labels = documents()
    return corpus(spark, rows), spark.createDataFrame(labels, LABELS), {k: (q, t) for k, q, t, _ in labels}


def test_quality_of_held_out_rows(known):
    docs, labels, truth = known
    rows = subword.scored(docs, subword.fit_quality(docs, labels)).collect()
    import zlib

    held = [(r["score"] >= subword.THRESHOLD) == bool(truth[r["doc_id"]][0]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean(held) > 0.95
    kept = subword.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["score"] >= subword.THRESHOLD}


def test_toxicity_of_held_out_rows(known):
    docs, labels, truth = known
    rows = toxicity.scored(docs, toxicity.fit_toxicity(docs, labels)).collect()
    import zlib

    held = [(r["score"] >= toxicity.THRESHOLD) == bool(truth[r["doc_id"]][1]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean(held) > 0.95


def test_training_never_sees_held_out_rows(spark, known):
    docs, labels, _ = known
    import zlib

    from lacuna.llm.labelled import fold, labelled

    got = labelled(docs, labels, "quality", fold("doc_id", 4) != 2, rows=50).toArrow()
    ids = got.column("doc_id").to_pylist()
    assert len(ids) == 50 and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)


@pytest.mark.parametrize("module", [subword, toxicity])
def test_edges(spark, known, module):
    fit = subword.fit_quality if module is subword else toxicity.fit_toxicity
    model = fit(known[0], known[1])
    scores = {(r["doc_id"], i): r["score"] for i, r in enumerate(module.scored(edge(spark), model).collect())}
    assert len(scores) == 14 and all(0 <= s <= 1 for s in scores.values())
    assert module.scored(empty(spark), model).count() == 0
    none = spark.createDataFrame([], LABELS)
    blind = fit(edge(spark), none)
    assert {r["score"] for r in module.scored(edge(spark), blind).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1, 1, ""), (4, None, None, ""), (4, 1, 0, ""), (4, 0, 1, ""), (5, 1, 1, "")], LABELS)
    assert module.scored(edge(spark), fit(edge(spark), odd)).count() == 14


def test_features_follow_whole_texts():
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (1, 50, 400)] + ["", "ab"]
    model = subword.SubwordModel(np.random.default_rng(0).normal(size=subword.KINDS << subword.BITS), 0.1)
    together = model.score(pa.array(texts))
    assert np.allclose(together, [model.score(pa.array([t]))[0] for t in texts])
    tox = toxicity.ToxicModel(toxicity.learn_lexicon(pa.array(["idiot " + t for t in texts]), np.array([1, 0, 1, 0, 1]), least=1, z=0))
    assert np.allclose(tox.features(pa.array(texts)), np.vstack([tox.features(pa.array([t])) for t in texts]))


def test_toxicity_of_texts_longer_than_a_run(monkeypatch):
    rng = random.Random(4)
    words = "idiot you scum 1d10t IDIOT a b b sooo !!! ??? you're #%& trashy worthless nothing Ärger 12".split()
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 40, 300, 2, 7, 80)] + ["you idiot scum " + prose(rng, 90), " ".join(["a"] * 99)]
    y = np.arange(len(texts)) % 2
    lexicon = toxicity.learn_lexicon(pa.array(texts), y, least=1, z=0)
    whole = toxicity.ToxicModel(lexicon).features(pa.array(texts))
    assert np.all(whole.any(0))
    monkeypatch.setattr(textvec, "LIMIT", 64)
    assert np.allclose(toxicity.ToxicModel(lexicon).features(pa.array(texts)), whole)
    assert all(map(np.array_equal, toxicity.learn_lexicon(pa.array(texts), y, least=1, z=0), lexicon))


def test_obfuscated_and_near_second_person():
    model = toxicity.ToxicModel((np.empty(0, np.uint64), np.empty(0)))
    col = {n: k for k, n in enumerate(toxicity.NAMES)}
    x = model.features(pa.array(["you are an 1d10t", "you idiot", "an idiot far away from the one that is you", "IDIOT !!! ???"]))
    assert x[0, col["leet"]] > 0 and x[1, col["near_you"]] > 0 and x[2, col["near_you"]] == 0 and x[3, col["shouted"]] > 0 and x[3, col["marks"]] > 0


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = Trees.fit(x[:1500], y[:1500])
    assert ((trees.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    assert trees.margin(np.empty((0, 4))).shape == (0,)
    steps = Isotonic.fit(trees.margin(x[:1500]), y[:1500])
    p = steps(np.sort(trees.margin(x[1500:])))
    assert np.all(np.diff(p) >= 0) and 0 <= p.min() and p.max() <= 1
    assert Isotonic(np.empty(0), np.empty(0))(np.zeros(2)).tolist() == [0.5, 0.5]


def plain_features(text):
    """Buckets of a text, one n-gram at a time: how often each is met."""
    from collections import Counter

    mask, raw = (1 << 64) - 1, text.encode()

    def word_hash(w):
        total = sum((b + 1) * pow(textvec._BASE, k, 1 << 64) for k, b in enumerate(w)) & mask
        return int(textvec.mix(np.array([(total + len(w)) & mask], np.uint64))[0])

    def bucket(x):
        return ((x * 0x9E3779B97F4A7C15) & mask) >> (64 - subword.BITS)

    words, out = [word_hash(w) for w in raw.replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w], Counter()
    out.update(bucket(w) for w in words)
    for a, b in zip(words, words[1:]):
        pair = 0 if a == b else int(textvec.mix(np.array([(a * 0xD6E8FEB86659FD93 + b) & mask], np.uint64))[0])
        out[bucket(pair) + (1 << subword.BITS)] += 1
    for k, n in ((2, 3), (3, 5)):
        out.update(bucket(int.from_bytes(raw[i : i + n], "little")) + (k << subword.BITS) for i in range(len(raw) - n + 1))
    return out


@pytest.mark.parametrize("limit", [64, 7, textvec.LIMIT])
def test_subword_features_against_plain_ones(monkeypatch, limit):
    monkeypatch.setattr(textvec, "LIMIT", limit)
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (1, 9, 80, 3)] + ["", "a", "ab\n", "so so so  so", " \t ", "y" * 200 + " z", "ü é " * 30]
    got = subword._bags(pa.array(texts))
    for text, (ids, share) in zip(texts, got, strict=True):
        want = plain_features(text)
        assert dict(zip(ids.tolist(), (share * sum(want.values())).round().astype(int).tolist(), strict=True)) == want
    model = subword.SubwordModel(np.random.default_rng(0).normal(size=subword.KINDS << subword.BITS), 0.1)
    for text, score in zip(texts, model.score(pa.array(texts)), strict=True):
        want = plain_features(text)
        z = sum(model.weight[b] * n for b, n in want.items()) / max(1, sum(want.values())) + 0.1
        assert np.isclose(score, 1 / (1 + np.exp(-z)))


def test_long_labelled_texts_are_learned_from(spark):
    rng = random.Random(6)
    rows = [(k, ("idiot scum " if k % 2 else "kind words ") + prose(rng, 40_000 if k < 4 else 20)) for k in range(60)] + [(1, "idiot again"), (7, None)]
    labels = spark.createDataFrame([(k, 1, k % 2, "") for k in range(60)], LABELS)
    from lacuna.llm.labelled import fold, labelled

    got = {r["doc_id"]: r for r in labelled(corpus(spark, rows), labels, "toxic", fold("doc_id", 5) != 9).collect()}
    assert sorted(got) == list(range(60)) and len(got[0]["text"]) > 200_000 and got[1]["text"] in [t for d, t, *_ in rows if d == 1]
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(corpus(spark, rows[4:60]), toxicity.fit_toxicity(corpus(spark, rows), labels)).collect()}
    assert np.mean([(s >= 0.5) == bool(k % 2) for k, s in scores.items()]) > 0.9
