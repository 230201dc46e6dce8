"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token sequences; those longer than a sequence are cut. Pieces
are dealt into shards of bounded size, and each shard is packed by several
islands. A chromosome is a packing. Crossover puts whole well-filled bins of
one parent into the other, removes what is then there twice, swaps displaced
pieces into bins that they fill better, and puts the rest back by best fit. Between epochs each island sends its elite
to the next one of its shard. Pieces of badly filled bins of all shards are
then packed once more together.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.session import lean, materialize, read
from lacuna.llm.tokens import default_vocabulary, tokens

#: Tokens of a sequence; the id that ends a document.
CAPACITY, END = 2048, 0
#: Pieces of a shard, islands of a shard, epochs, chromosomes of an island, generations of an epoch, bins that a child may swap items in.
SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS, SWAPS = 3000, 2, 2, 6, 10, 64
#: Tasks of an epoch, at most.
MOST_TASKS = 20_000
#: Bins filled less than this are packed again with those of other shards.
LOOSE = 0.97


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and END, cut only where they exceed ``capacity``; the first piece is the short one."""

    def cut(batches):
        known = tokens(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(known.encode(text or ""), np.uint32(END)).astype("<u4")
                count = -(-len(ids) // capacity)
                first = len(ids) - capacity * (count - 1)
                for k in range(count):
                    lo, hi = max(0, first + (k - 1) * capacity), first + k * capacity
                    rows.append((doc, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], items: list[int], free: list[tuple[int, int]], place: np.ndarray, bins: int, capacity: int) -> int:
    """Put items, in this order, each into the fullest bin that takes it; free is the sorted (room, bin) list. Returns how many bins there are then."""
    for i in items:
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, bins
            bins += 1
        place[i] = b
        if room > size:
            insort(free, (room - size, b))
    return bins


def _tidy(place: np.ndarray) -> np.ndarray:
    return np.unique(place, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, place: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones (least is best)."""
    fill = np.bincount(place, sizes) / capacity
    return len(fill), -float((fill**2).sum())


def crossover(sizes: np.ndarray, into: np.ndarray, giver: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """Whole well-filled bins of ``giver`` go into a copy of ``into``; bins that hold their items are dissolved and what they lose is best-fitted."""
    fill = np.bincount(giver, sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // 4), replace=False)] = True
    return _repair(sizes, into, chosen[giver], giver, rng, capacity)


def mutate(sizes: np.ndarray, place: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """Some of the emptiest bins, and a few others, are dissolved."""
    fill = np.bincount(place, sizes)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill)[: max(1, len(fill) // 20)]] = True
    gone[rng.integers(0, len(fill), max(1, len(fill) // 40))] = True
    return _place(sizes, place, ~gone[place], rng, capacity, SWAPS)


def _repair(sizes: np.ndarray, into: np.ndarray, moved: np.ndarray, giver: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    hit = np.zeros(into.max() + 1, bool)
    hit[into[moved]] = True
    stay = moved | ~hit[into]
    return _place(sizes, np.where(moved, giver + into.max() + 1, into), stay, rng, capacity, SWAPS)


def _place(sizes: np.ndarray, place: np.ndarray, stay: np.ndarray, rng: np.random.Generator, capacity: int, swaps: int = 0) -> np.ndarray:
    """Items that stay keep their bins, but for some that are swapped for displaced ones; the others, large ones first with a little noise, are best-fitted."""
    out = np.full(len(sizes), -1, np.int64)
    out[stay] = _tidy(place[stay])
    bins = int(out.max()) + 1
    items = np.flatnonzero(~stay)
    if swaps and bins and len(items) > 1:
        items = _swap(sizes, out, items, rng.permutation(bins)[:swaps], capacity)
    room = capacity - np.bincount(out[out >= 0], sizes[out >= 0], bins).astype(int)
    free = sorted((r, b) for b, r in enumerate(room.tolist()) if r > 0)
    items = items[np.argsort(-(sizes[items] + rng.random(len(items)) * 8), kind="stable")]
    best_fit(sizes.tolist(), items.tolist(), free, out, bins, capacity)
    return _tidy(out)


def _swap(sizes: np.ndarray, out: np.ndarray, items: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """In each of some bins one or two items are swapped for one or two displaced ones, if that fills it better; returns what is displaced then."""
    items = items[np.argsort(sizes[items], kind="stable")]
    size = sizes[items]
    # A bin's items are looked up once for all bins, as none but its own turn changes it.
    order = np.argsort(out, kind="stable")
    ends = np.searchsorted(out[order], np.arange(-1, len(sizes)), "right").tolist()
    rooms = (capacity - np.bincount(out[out >= 0], sizes[out >= 0]).astype(int)).tolist()
    for b in bins.tolist():
        own, room = order[ends[b] : ends[b + 1]].tolist(), rooms[b]
        if room <= 0 or len(own) > 8:
            continue
        best, at = (0, None, None), np.arange(len(size))
        own_size = dict(zip(own, sizes[own].tolist(), strict=True))
        for away in [(), *((i,) for i in own), *((i, j) for k, i in enumerate(own) for j in own[:k])]:
            lost = sum(own_size[i] for i in away)
            one = int(size.searchsorted(lost + room, "right")) - 1
            if one >= 0 and (gain := int(size[one]) - lost) > best[0]:
                best = gain, away, [one]
            other = size.searchsorted(lost + room - size, "right") - 1
            # Partners get no larger as an item does, so those beyond it come first.
            if n := int(np.count_nonzero(other > at)):
                both = size[:n] + size[other[:n]]
                k = int(both.argmax())
                if (gain := int(both[k]) - lost) > best[0]:
                    best = gain, away, [k, int(other[k])]
            if best[0] == room:
                break
        if best[0]:
            _, away, into = best
            out[items[into]] = b
            out[list(away)] = -1
            keep = np.ones(len(items), bool)
            keep[into] = False
            items = np.concatenate([items[keep], np.array(away, items.dtype)])
            items = items[np.argsort(sizes[items], kind="stable")]
            size = sizes[items]
            if len(items) < 2:
                break
    return items


def evolve(sizes: np.ndarray, seed: list[int], migrants: list[np.ndarray], capacity: int = CAPACITY) -> np.ndarray:
    """One epoch of one island: the best packing it finds, as a bin number for each item."""
    rng = np.random.default_rng(seed)
    if not len(sizes):
        return np.empty(0, np.int32)
    fresh = lambda: _place(sizes, np.zeros(len(sizes), int), np.zeros(len(sizes), bool), rng, capacity)
    pool = [*migrants, *(fresh() for _ in range(POPULATION - len(migrants)))]
    rank = [fitness(sizes, p, capacity) for p in pool]
    bound = max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    for _ in range(GENERATIONS):
        if min(rank)[0] <= bound:
            break
        for _ in range(POPULATION):
            a, b = (min(rng.integers(0, len(pool), 2).tolist(), key=rank.__getitem__) for _ in range(2))
            child = crossover(sizes, pool[a], pool[b], rng, capacity) if a != b else pool[a]
            child = mutate(sizes, child, rng, capacity)
            score, worst = fitness(sizes, child, capacity), max(range(len(pool)), key=rank.__getitem__)
            if score < rank[worst]:
                pool[worst], rank[worst] = child, score
    return pool[min(range(len(pool)), key=rank.__getitem__)].astype(np.int32)


def _islands(shards: DataFrame, count: int, epoch: int, capacity: int) -> DataFrame:
    """One epoch of all islands: rows (shard, island, sizes, elites) get place and bins."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            place, bins = [], []
            for row in frame.itertuples():
                found = evolve(np.asarray(row.sizes, np.int64), [epoch, row.shard, row.island], [np.frombuffer(e, np.int32) for e in row.elites], capacity)
                place.append(found.tobytes())
                bins.append(int(found.max()) + 1 if len(found) else 0)
            yield frame[["shard", "island"]].assign(place=place, bins=bins)

    # A number of tasks, as rows are few and small, but each is seconds of work.
    rows = shards.repartition(min(count * ISLANDS, MOST_TASKS), "shard", "island")
    return rows.mapInPandas(lean(run), "shard long, island int, place binary, bins int")


def _pack(items: DataFrame, count: int, capacity: int) -> DataFrame:
    """(item, sequence_id, offset) of ``count`` items (item, length), each shorter than a sequence."""
    parts = max(1, -(-count // SHARD))
    shards = items.groupBy(F.pmod(F.xxhash64("item"), F.lit(parts)).alias("shard"))
    shards = materialize(shards.agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("own")).select("shard", F.col("own.item").alias("item"), F.col("own.length").alias("sizes")))
    island = F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island")
    elites = None
    for epoch in range(EPOCHS):
        ready = shards.select("shard", "sizes", island)
        if elites is None:
            ready = ready.withColumn("elites", F.array().cast("array<binary>"))
        else:
            own = elites.select("shard", "island", F.array("place").alias("own"))
            guest = elites.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.array("place").alias("guest"))
            ready = ready.join(own, ["shard", "island"]).join(guest, ["shard", "island"]).select("shard", "sizes", "island", F.concat("own", "guest").alias("elites"))
        elites = materialize(_islands(ready, parts, epoch, capacity))
    best = elites.groupBy("shard").agg(F.min(F.struct("bins", "island", "place")).getField("place").alias("place"))

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                place, sizes = np.frombuffer(row.place, np.int32), np.asarray(row.sizes, np.int64)
                order = np.argsort(place, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                first = np.searchsorted(place[order], place[order])
                offset = np.empty(len(place), np.int64)
                offset[order] = before - before[first]
                yield pd.DataFrame({"item": np.asarray(row.item, np.int64), "sequence_id": (np.int64(row.shard) << 20) + place, "offset": offset, "fill": np.bincount(place, sizes)[place] / capacity})

    return shards.join(best, "shard").mapInPandas(lean(lay), "item long, sequence_id long, offset long, fill double")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all rows of ``docs`` with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the one id END. Repeated rows are packed each. A
    document longer than ``capacity`` is cut, and its full pieces are sequences
    of their own. Other columns are ignored; an empty table has no pieces.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = materialize(pieces(docs, vocabulary or default_vocabulary(), capacity).withColumn("item", F.monotonically_increasing_id()))
    whole = cut.where(F.col("length") == capacity).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = cut.where(F.col("length") < capacity).select("item", "length")
    first = materialize(_pack(items, items.count(), capacity))
    loose = materialize(items.join(first.where(F.col("fill") < LOOSE).select("item"), "item"))
    second = _pack(loose, loose.count(), capacity).select("item", (F.col("sequence_id") + (1 << 60)).alias("sequence_id"), "offset")
    placed = first.where(F.col("fill") >= LOOSE).select("item", "sequence_id", "offset").unionAll(second)
    return whole.unionByName(cut.join(placed, "item")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"))
