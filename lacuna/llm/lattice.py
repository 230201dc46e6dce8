"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to a few blocks of eight numbers; each
block is decoded to the nearest point of the E8 lattice. The points of a
table's blocks are its cell. A vector also visits the neighbouring cells that
it lies nearest to. Vectors that meet in a cell of any table are compared by
cosine in double precision.

Exact copies are one vector with a weight. A cell is compared in blocks of
bounded size, and a pair that meets more than once counts only in the first
cell it meets in. Tasks send link counts by vector and a spanning forest, not
pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.components import components
from lacuna.llm.session import lean, materialize, read

#: Tables, E8 blocks of a table, size of a cell for 64 dimensions, cells visited besides the own one.
TABLES, BLOCKS, SCALE, PROBES = 12, 3, 0.25, 6
#: Least cosine of a link; vectors of a block that are compared in one task.
COSINE, BLOCK = 0.9, 1024
U64 = np.uint64
#: Up to so many vectors the numbers above hold. Beyond, cells are larger (WIDE) but have more blocks (DEEP and one for each LESS times as many vectors), which chance meetings get rarer by; MORE times the tables keep recall.
MANY, WIDE, DEEP, LESS, MORE = 2_000_000, 0.32, 4, 17, 2.3


def shape(vectors: int) -> tuple[int, int, float]:
    """(tables, blocks, scale) for so many vectors: chance meetings of a vector stay about as many, by measured rates."""
    extra = max(0, math.ceil(math.log(max(vectors, 1) / MANY, LESS)))
    return (math.ceil(TABLES * MORE**extra), DEEP + extra, WIDE) if extra else (TABLES, BLOCKS, SCALE)


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring cells."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        v = np.array([0.5 if signs >> k & 1 else -0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points of rows of eight numbers."""
    best, least = None, None
    for shift in (0.0, 0.5):
        y = x - shift
        p = np.rint(y)
        odd = np.flatnonzero(p.sum(-1) % 2 != 0)
        rest = y[odd] - p[odd]
        k = np.abs(rest).argmax(-1)
        p[odd, k] += np.where(rest[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
        p += shift
        far = ((x - p) ** 2).sum(-1)
        if best is None:
            best, least = p, far
        else:
            best = np.where((far < least)[:, None], p, best)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Lattice:
    def __init__(self, dim: int, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES, seed: int = 5):
        rng = np.random.default_rng([seed, dim])
        # Projections shrink as vectors get longer, and cells with them: recall and chance meetings are those of 64 dimensions.
        self.tables, self.blocks, self.scale, self.probes = tables, blocks, scale * np.sqrt(64 / dim), probes
        self.project = rng.normal(0, 1 / np.sqrt(dim), (tables, dim, 8 * blocks))
        self.offset = rng.random((tables, 8 * blocks))
        self.roots = roots()
        self.coef = rng.integers(1, 1 << 62, (tables, blocks, 8)).astype(U64) * U64(2) + U64(1)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cells of each vector by table: its own first, then those it visits. Shape (vectors, tables, 1 + probes)."""
        n = len(unit)
        out = np.empty((n, self.tables, 1 + self.probes), U64)
        with np.errstate(over="ignore"):
            step = (2 * self.roots).astype(np.int64).astype(U64)
            for t in range(self.tables):
                y = (unit @ self.project[t] / self.scale + self.offset[t]).reshape(n * self.blocks, 8)
                p = decode(y)
                part = ((2 * p).astype(np.int64).astype(U64).reshape(n, self.blocks, 8) * self.coef[t]).sum(-1)
                own = part.sum(-1)
                gain = ((y - p) @ self.roots.T).reshape(n, self.blocks * len(self.roots))
                near = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes]
                moved = (step @ self.coef[t].T).T.reshape(-1)
                out[:, t, 0] = own
                out[:, t, 1:] = own[:, None] + moved[near]
                out[:, t] = _mix(out[:, t] + U64(t + 1) * U64(0x9E3779B97F4A7C15))
        return out


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _lattice(known: dict[int, Lattice], dim: int, form: tuple[int, int, float]) -> Lattice:
    if dim not in known:
        known[dim] = Lattice(dim, *form)
    return known[dim]


def _cells(batches: Iterator[pa.RecordBatch], form: tuple[int, int, float]) -> Iterator[pa.RecordBatch]:
    known: dict[int, Lattice] = {}
    for whole in batches:
        for at in range(0, len(whole), 1000):
            batch = whole.slice(at, 1000)
            node = batch.column(0).to_numpy()
            sizes = np.asarray(pa.compute.list_value_length(batch.column(1)))
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                flat = batch.column(1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                cells = _lattice(known, dim, form).cells(_unit(flat, dim)).reshape(len(rows), -1)
                width = cells.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(cells.view(np.int64).reshape(-1)))], names=["node", "cells"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of a sorted stream by its first columns; a group is bounded by the size of blocks."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        table = pa.Table.from_batches(rest).combine_chunks()
        key = [table.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        edges = [0, *new.tolist()]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(lo, hi - lo)
        rest = table.slice(edges[-1]).to_batches()
    if rest and sum(map(len, rest)):
        yield pa.Table.from_batches(rest)


def _met_before(a: np.ndarray, b: np.ndarray, cell: np.uint64, width: int) -> np.ndarray:
    """For pairs of rows of cells: whether they share a cell in an earlier table, or one in the same table that comes first."""
    met = np.zeros(len(a), bool)
    open_ = np.arange(len(a))
    for t in range(a.shape[1] // width):
        own = slice(t * width, (t + 1) * width)
        x, y = a[open_, own], b[open_, own]
        same = x[:, :, None] == y[:, None, :]
        here = (x[:, :, None] == cell) & same
        last = here.any((1, 2))
        low = np.where(same, x[:, :, None], ~U64(0)).min((1, 2))
        met[open_[same.any((1, 2)) & (~last | (low < cell))]] = True
        open_ = open_[~same.any((1, 2))]
        if not len(open_):
            break
    return met


def _compare(cosine: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 + PROBES
        for group in _groups(batches, 3):
            cell = np.array([group.column("cell")[0].as_py()], np.int64).view(U64)[0]
            node, weight, side = (group.column(c).to_numpy() for c in ("node", "weight", "side"))
            sizes = np.asarray(pa.compute.list_value_length(group.column("embedding").combine_chunks()))
            u, v, n = [], [], []
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                left, right = rows[side[rows] < 2], rows[side[rows] > 0]
                if not len(left) or not len(right):
                    continue
                take = lambda c, r: group.column(c).combine_chunks().take(pa.array(r)).flatten().to_numpy(zero_copy_only=False)
                cells = take("cells", rows).view(U64).reshape(len(rows), -1)
                unit = _unit(take("embedding", rows), dim)
                li, ri = np.searchsorted(rows, left), np.searchsorted(rows, right)
                a, b = np.nonzero(unit[li] @ unit[ri].T >= cosine)
                a, b = li[a], ri[b]
                own = node[rows]
                # In a block against itself each pair is seen from both sides.
                once = own[a] < own[b] if (side[rows] == 1).all() else own[a] != own[b]
                a, b = a[once], b[once]
                fresh = np.concatenate([np.empty(0, bool), *(~_met_before(cells[a[k : k + 50_000]], cells[b[k : k + 50_000]], cell, width) for k in range(0, len(a), 50_000))])
                a, b = a[fresh.astype(bool)], b[fresh.astype(bool)]
                w = weight[rows]
                links = np.bincount(np.concatenate([a, b]), np.concatenate([w[b], w[a]]), len(rows)).astype(np.int64)
                some = np.flatnonzero(links)
                u.append(own[some]), v.append(np.full(len(some), -1)), n.append(links[some])
                root = np.arange(len(rows))

                def find(x: int, root: np.ndarray = root) -> int:
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return int(x)

                first = np.unique(b, return_index=True)[1]
                for x, y in [*zip(a[first].tolist(), b[first].tolist(), strict=True), *zip(a.tolist(), b.tolist(), strict=True)]:
                    p, q = find(x), find(y)
                    if p != q:
                        root[q] = p
                        u.append(own[x : x + 1]), v.append(own[y : y + 1]), n.append(np.zeros(1, np.int64))
            if u:
                u, v, n = (np.concatenate(x) for x in (u, v, n))
                yield pa.RecordBatch.from_pydict({"u": u, "v": v, "n": n, "edge": n == 0})

    return compare


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors and those with a null or non-finite component
    link with nothing; vectors of different length don't link. A repeated row
    is another vector. A null id stays null, is never a component's id and is
    not kept. Other columns are ignored; an empty table gives an empty result.
    """
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("node", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("embedding")))
    members = materialize(rows.select("vec_id", "node"))
    classes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    classes = materialize(classes)
    form = shape(classes.count())
    cells = materialize(classes.select("node", "embedding").mapInArrow(lean(lambda batches: _cells(batches, form)), "node long, cells array<long>"))
    met = cells.select(F.explode("cells").alias("cell"), "node")
    shared = met.groupBy("cell").agg(F.count("*").alias("many")).where("many > 1")
    met = materialize(met.join(shared, "cell"))
    full = met.join(classes.select("node", "weight", "embedding").join(cells, "node"), "node")
    cuts = F.ceil(F.col("many") / BLOCK)
    own = F.pmod(F.xxhash64("node"), cuts)
    dealt = full.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2)
    dealt = dealt.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "node", "weight", "embedding", "cells")
    found = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(lean(_compare(cosine)), "u long, v long, n long, edge boolean")
    found = materialize(found)
    links = found.where("not edge").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    group = materialize(components(found.where("edge").select("u", "v")))
    named = classes.select("node", "weight", "least").join(links, "node", "left").join(group, "node", "left").select("node", "weight", "least", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "node").alias("component"))
    named = materialize(named)
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(lowest, "component").select("node", (F.col("weight") - 1 + F.col("others")).alias("n_links"), "component_id")
    out = members.join(known, "node", "left")
    name = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.coalesce(F.col("vec_id") == name, F.lit(False)).alias("kept"))


def op9_lattice_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings with a cosine of 0.9 or more."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))
