import numpy as np
import pytest

from lacuna.llm import lattice
from lacuna.llm.lattice import decode, near_duplicates, roots

SCHEMA = "vec_id long, embedding array<float>, label int, node string, cells string, weight int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "n", "c", 2) for i, v in rows], SCHEMA)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def near(rng, v, c):
    z = rng.normal(size=v.shape)
    z = unit(z - (z @ v) * v)
    return c * v + np.sqrt(1 - c * c) * z


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    assert len(roots()) == 240 and np.allclose((roots() ** 2).sum(1), 2)
    x = rng.normal(size=(500, 8)) * 2
    p = decode(x)
    assert np.all((2 * p) % 1 == 0) and np.all(p.sum(1) % 2 == 0)
    best = ((x - p) ** 2).sum(1)
    for r in roots():
        assert np.all(((x - p - r) ** 2).sum(1) >= best - 1e-9)


def brute(rows):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    cos = unit(x) @ unit(x).T
    return cos


def test_recall_and_no_false_links(spark):
    rng = np.random.default_rng(3)
    base = unit(rng.normal(size=(400, 64)))
    rows = [(k, v) for k, v in enumerate(base)] + [(1000 + k, near(rng, base[k], 0.9 + 0.1 * rng.random())) for k in range(300)]
    rows += [(2000 + k, near(rng, base[0], 0.99)) for k in range(60)]
    got = {r["vec_id"]: r for r in near_duplicates(table(spark, rows)).collect()}
    cos = brute(rows)
    true = (cos >= 0.9).sum(1) - 1
    found = np.array([got[i]["n_links"] for i, _ in rows])
    assert np.all(found <= true) and found.sum() >= 0.9 * true.sum()
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i, _ in rows)
    for k in range(60):
        assert got[2000 + k]["component_id"] == 0


def meetings(dim, vectors):
    """Recall of pairs at a cosine of 0.9, and the share of random pairs that meet."""
    rng = np.random.default_rng(dim)
    a = unit(rng.normal(size=(600, dim)))
    b = np.array([near(rng, v, 0.9) for v in a])
    known = lattice.Lattice(dim, *lattice.shape(vectors))
    x, y = known.cells(a), known.cells(b)
    recall = (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean()
    pairs = set()
    for t in range(x.shape[1]):
        held = {}
        for k in range(600):
            for cell in x[k, t].tolist():
                held.setdefault(cell, set()).add(k)
        pairs |= {(i, j) for own in held.values() for i in own for j in own if i < j}
    return recall, len(pairs) / (600 * 599 / 2)


@pytest.mark.parametrize("dim", [8, 16, 32, 64, 128, 256, 768, 1024])
def test_neither_recall_nor_chance_meetings_depend_on_length(dim):
    recall, chance = meetings(dim, 1000)
    # Of eight dimensions, random vectors are near each other more often.
    assert recall >= 0.92 and chance <= (0.01 if dim < 16 else 0.001)


@pytest.mark.parametrize("dim, vectors", [(64, 30_000_000), (768, 30_000_000), (64, 1_000_000_000)])
def test_more_vectors_meet_by_chance_less_often(dim, vectors):
    recall, chance = meetings(dim, vectors)
    assert recall >= 0.92 and chance <= 2e-5


def test_tables_for_few_vectors():
    assert lattice.shape(0) == lattice.shape(lattice.MANY) == (lattice.TABLES, lattice.BLOCKS, lattice.SCALE)


def test_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(5)
    v = unit(rng.normal(size=64))
    rows = [(k, near(rng, v, 0.999)) for k in range(70)]
    assert {r["n_links"] for r in near_duplicates(table(spark, rows)).collect()} == {69}


def test_edges(spark):
    a, b = np.eye(8)[0], np.eye(8)[1]
    rows = [(1, a), (2, a), (2, a), (3, 2 * a), (4, None), (5, np.zeros(8)), (6, [float("nan")] * 8), (7, [None] + [1.0] * 7), (8, b), (9, []), (10, [1.0] * 16), (None, a), (None, None), (11, [float("inf")] + [0] * 7), (12, 1e-30 * b)]
    got = sorted(map(tuple, near_duplicates(table(spark, rows)).collect()), key=str)
    four = lambda i: (i, 4, 1, i == 1)
    alone = lambda i: (i, 0, i, True)
    want = [four(1), four(2), four(2), four(3), *map(alone, (4, 5, 6, 7, 9, 10, 11)), (8, 1, 8, True), (12, 1, 8, False), (None, 4, None, False), (None, 0, None, False)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).count() == 0
