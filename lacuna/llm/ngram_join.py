"""Exact n-gram Jaccard join by vertical partitioning.

A document's set is its distinct word n-grams. A corpus-wide count sketch puts
all n-grams in one global order, rare ones first. The order is cut into
fragments of equal mass; a set is cut with it. The overlap of two sets is
counted in each fragment separately and summed per pair.

Which pairs are counted:

* Equal sets are one class, named by 128 bits; only classes are compared.
* Linked sets share an n-gram among the first ``n - ceil(t * n) + 1`` of each
  in the global order (prefix filter), have sizes in proportion ``t``, and
  parity sketches that differ in no more bits than the sets may differ in
  members. All three filters are exact.
* First every class is compared with one hub, the best of those of the prefix
  n-grams it shares. Then only classes whose components still differ are compared, in bounded
  blocks of like sizes. So a group of near copies costs a star and not all its pairs.

A row is known by a hash of its id and text, so that rows with one id are told
apart. Only texts of classes that are in candidate pairs are cut into fragments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm import textvec
from lacuna.llm.components import components
from lacuna.llm.session import drop_shuffles, join_keys, lean, materialize, read, release

#: Counters of the sketch that orders n-grams, and fragments of the order.
COUNTERS, FRAGMENTS = 1 << 20, 8
#: Bits of the least and of the longest sketch, and of the least one that blocks compare; members of a block that are compared in one task.
BITS, MOST_BITS, LEAST_BITS, BLOCK = 1024, 1 << 17, 256, 1024
#: Added to the role of a class in a block: it is no guest.
HOME = 4
#: N-grams that say in which block a pair is emitted; none of them.
FIRST, NONE = 8, np.iinfo(np.int64).max
U64 = np.uint64


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's word n-grams in order, and the bounds of documents; fewer than n words are one n-gram."""
    sizes = np.diff(bounds)
    out = hashes.copy()
    for k in range(1, n):
        out[: len(out) - k] = textvec.mix(out[: len(out) - k] * U64(0xD6E8FEB86659FD93) + hashes[k:]) if k < len(out) else out[: len(out) - k]
    keep = np.ones(len(hashes), bool)
    for k in range(1, n):
        tail = bounds[1:][sizes >= n] - k
        keep[tail] = False
    for d in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():
        lo, hi = int(bounds[d]), int(bounds[d + 1])
        whole = np.array([hi - lo], U64)
        for h in hashes[lo:hi]:
            whole = textvec.mix(whole * U64(0xA0761D6478BD642F) + h)
        out[lo] = whole[0]
        keep[lo + 1 : hi] = False
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    return out[keep], np.concatenate([[0], np.cumsum(counts)])


def _batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for batch in textvec.slices(whole, "text"):
            yield batch, *grams(*textvec.words(batch.column("text")), n)


class Order:
    """The global order of n-grams, from counts of hashed n-grams over the whole corpus."""

    def __init__(self, counts: np.ndarray):
        #: Powers of two of an n-gram's estimated count.
        self.level = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.uint8)
        mass = np.bincount(self.level, weights=counts, minlength=65)
        self.mass, self.before = mass / max(mass.sum(), 1), (np.cumsum(mass) - mass) / max(mass.sum(), 1)

    def place(self, gram: np.ndarray) -> np.ndarray:
        """Positions in the order: the level in 8 bits, then 56 bits of the hash."""
        return (self.level[gram & U64(len(self.level) - 1)].astype(U64) << U64(56)) | (gram >> U64(8))

    def fragment(self, place: np.ndarray) -> np.ndarray:
        level = (place >> U64(56)).astype(int)
        share = self.before[level] + self.mass[level] * ((place & U64((1 << 56) - 1)).astype(float) / 2**56)
        return np.clip((share * FRAGMENTS).astype(int), 0, FRAGMENTS - 1)


def _count_grams(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of hashed n-grams; each task sends one array of fixed size, and two levels of tasks add them."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, gram, _ in _batches(batches, n):
            total += np.bincount((gram & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield from parts(total)

    def parts(total):
        if total.any():
            step = COUNTERS // 16
            yield pa.RecordBatch.from_pydict({"part": list(range(16)), "n": [total[k * step : (k + 1) * step].astype(np.uint32 if total.max() < 1 << 32 else np.int64).tobytes() for k in range(16)]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_buffer()
                got = np.frombuffer(raw, np.uint32 if raw.size == COUNTERS // 4 else np.int64).astype(np.int64)
                sums[part] = sums[part] + got if part in sums else got
        if sums:
            yield pa.RecordBatch.from_pydict({"part": list(sums), "n": [x.tobytes() for x in sums.values()]})

    schema = "part long, n binary"
    # Written and not collected at once, so that the tasks' arrays go from the executors' disks.
    some = materialize(docs.select("text").mapInArrow(lean(count), schema).repartition(16, "part").mapInArrow(lean(add), schema))
    out = np.zeros((16, COUNTERS // 16), np.int64)
    for row in some.collect():
        out[row["part"]] = np.frombuffer(row["n"], np.int64)
    release(some)
    return out.reshape(-1)


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix in which linked sets must share an n-gram."""
    return n - (n * percent + 99) // 100 + 1


def _bits(n: int) -> int:
    """Bits of a set's sketch: a power of two, at least four for each member."""
    return min(MOST_BITS, max(BITS, 1 << (4 * n - 1).bit_length()))


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A sketch folded to so many words: a place modulo a smaller power of two is the parity of those that fall together."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words)) if len(bits) > words else bits


def _class(own: np.ndarray) -> bytes:
    """128 bits that name a set of n-grams."""
    with np.errstate(over="ignore"):
        once = textvec.mix(own)
        again = textvec.mix(once * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))
        sums = np.array([once.sum() ^ U64(len(own)), again.sum() + U64(len(own))], U64)
    return textvec.mix(sums).tobytes()


def _sets(docs: DataFrame, order, n: int, percent: int) -> DataFrame:
    """Per document: size, class of its set and half of its bits, and of a class once in each task: parity sketch and prefix."""

    def make(batches):
        seen: set[bytes] = set()
        for batch, gram, bounds in _batches(batches, n):
            size, sig, bits, prefix = [], [], [], []
            place = order.value.place(gram)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.unique(place[lo:hi])
                size.append(len(own))
                sig.append(_class(own) if len(own) else None)
                if not len(own) or sig[-1] in seen:
                    bits.append(None), prefix.append(None)
                    continue
                seen.add(sig[-1])
                places = _bits(len(own))
                odd = np.bincount((textvec.mix(own) & U64(places - 1)).astype(int), minlength=places).astype(np.uint8) & 1
                bits.append(np.packbits(odd).tobytes())
                prefix.append(own[: _need(len(own), percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array([s and int.from_bytes(s[:8], "little", signed=True) for s in sig], pa.int64()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "sig", "half", "bits", "prefix"])

    return docs.mapInArrow(lean(make), "doc_id long, key long, n long, sig binary, half long, bits binary, prefix array<long>")


def _members(docs: DataFrame, order, n: int) -> DataFrame:
    """(sig, members): the class of each text and its set, cut into the fragments of the global order. A task sends a class once."""

    def cut(batches):
        seen: set[bytes] = set()
        for batch, gram, bounds in _batches(batches, n):
            sig, members = [], []
            place = order.value.place(gram)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.unique(place[lo:hi])
                name = _class(own)
                if len(own) and name not in seen:
                    seen.add(name)
                    at = np.searchsorted(order.value.fragment(own), np.arange(1, FRAGMENTS))
                    sig.append(name), members.append([x.view(np.int64) for x in np.split(own, at)])
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(members, pa.list_(pa.list_(pa.int64())))], names=["sig", "members"])

    return docs.select("text").mapInArrow(lean(cut), "sig binary, members array<array<long>>")


def _sizes_fit(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _near(percent: int):
    """Keeps pairs (a, b, na, nb, x, y) whose sketches x and y differ in no more bits than linked sets may differ in members."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.empty(len(batch), np.int64)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                words = min(len(x), len(y))
                apart[k] = np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum(dtype=np.int64)
            keep = apart * (100 + percent) <= (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * (100 - percent)
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    return near


def _sketched(pairs: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes (a, b, na, nb) of pairs of halves (half, other), materialized, that fit in size and pass the parity filter."""
    need = materialize(pairs.select(F.explode(F.array("half", "other")).alias("half")).distinct())
    own = join_keys(one.select("half", "sig", "n", "bits"), need, "half", "left_semi")
    x = own.toDF("half", "a", "na", "x")
    y = own.toDF("other", "b", "nb", "y")
    both = pairs.join(x, "half").join(y, "other").where((F.col("a") != F.col("b")) & _sizes_fit("na", "nb", percent))
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(lean(_near(percent)), "a binary, b binary, na long, nb long")


def _links(pairs: DataFrame, docs: DataFrame, one: DataFrame, order, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) that link: overlaps are counted by fragment and summed."""
    need = materialize(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(one.select("sig", "key"), "sig").select("key").distinct())
    own = _members(join_keys(docs, need, "key", "left_semi"), order, n).groupBy("sig").agg(F.first("members").alias("members"))
    parts = materialize(own.select("sig", F.posexplode("members").alias("fragment", "members")).where(F.size("members") > 0))
    one = pairs.join(parts.select(F.col("sig").alias("a"), "fragment", F.col("members").alias("x")), "a")
    both = one.join(parts.select(F.col("sig").alias("b"), "fragment", F.col("members").alias("y")), ["b", "fragment"])
    counted = both.select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).cast("long").alias("partial"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("common"))
    return summed.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short sketches for blocks: folded to half as many bits as a set has members, or somewhat more; and the first of its n-grams."""
    for batch in batches:
        short = []
        for bits, n in zip(batch.column("bits"), batch.column("n").to_pylist(), strict=True):
            bits = np.frombuffer(bits.as_buffer(), U64)
            short.append(_fold(bits, min(len(bits), max(LEAST_BITS, 1 << (n // 2).bit_length()) // 64)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("half"), pa.array(short, pa.binary()), batch.column("first")], names=["half", "brief", "first"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """A stream sorted by key, cut between groups: tables, and where in them each group begins, and the end. Groups are bounded, so tables are."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        key = table.column("key").to_numpy()
        new = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
        if new:
            yield table.slice(0, new[-1]), [0, *new]
            table = table.slice(new[-1])
        rest = table.to_batches()
    if rest:
        table = pa.Table.from_batches(rest)
        yield table, [0, len(table)]


def _least_common(first: np.ndarray, p: np.ndarray, q: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """For pairs that meet in n-grams: whether each is the least that is among the first of both, or none is."""
    x, y = first[p], first[q]
    held = np.where((x[:, :, None] == y[:, None, :]).any(2) & (x != NONE), x, NONE).min(1)
    return (held == NONE) | (held == gram)


def _compare(percent: int):
    """Candidate pairs of each block of one n-gram's classes: other component, fitting size and short sketch, not both guests.

    Classes that share many n-grams meet in as many blocks. Each row has the
    first of its class's n-grams, and a pair that has some of these in common
    comes from the block of the least of them only.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _groups(batches):
            n, label, role = (table.column(c).to_numpy() for c in ("n", "label", "role"))
            side, home, brief = role & 3, role >= HOME, table.column("brief").to_pylist()
            gram, lists = table.column("gram").to_numpy(), table.column("first").combine_chunks()
            first = np.full((len(table), FIRST), NONE)
            sizes = np.asarray(pa.compute.list_value_length(lists))
            first[np.arange(FIRST) < sizes[:, None]] = lists.flatten().to_numpy()
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                left, right = np.flatnonzero(side[lo:hi] < 2), np.flatnonzero(side[lo:hi] > 0)
                if not home[lo:hi].any() or (label[lo:hi] == label[lo]).all():
                    continue
                words = min(map(len, brief[lo:hi])) // 8
                bits = np.array([_fold(np.frombuffer(x, U64), words) for x in brief[lo:hi]])
                left, right = lo + left, lo + right
                for k in range(0, len(left), 256):
                    x, y = left[k : k + 256, None], right[None, :]
                    # In a block against itself each pair is seen from both sides.
                    ok = (label[x] != label[y]) & (home[x] | home[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((side[x] != 1) | (x < y))
                    u, v = np.nonzero(ok)
                    u, v = left[k + u], right[v]
                    for at in range(0, len(u), 1 << 16):
                        p, q = u[at : at + (1 << 16)], v[at : at + (1 << 16)]
                        apart = np.bitwise_count(bits[p - lo] ^ bits[q - lo]).sum(1, dtype=np.int64)
                        near = apart * (100 + percent) <= (n[p] + n[q]) * (100 - percent)
                        p, q = p[near], q[near]
                        once = _least_common(first, p, q, gram[p])
                        found.append((p[once], q[once]))
            if found:
                u, v = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
                half = table.column("half")
                yield pa.RecordBatch.from_arrays([half.take(u).combine_chunks(), half.take(v).combine_chunks()], names=["half", "other"])

    return compare


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("half", "other").alias("half"), F.greatest("half", "other").alias("other")).distinct()


def _apart(rest: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """Pairs (half, other) of classes of one n-gram, of ``rest(gram, half, n, label)``, whose labels differ and that are near by their short sketches.

    The classes of an n-gram are one block, if they are few; those without
    another of like size are left out first. Of the others, sizes fall into
    bands. Linked sets have sizes in proportion, so that they are of one band
    or of neighbouring ones: a class is at home in its band and a guest in the
    one below. Bands are compared in blocks. Blocks are known by a hash; should
    two have the same, they are compared together.
    """
    counted = rest.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many"))
    counted = materialize(counted.where("lo < hi").select("gram", "many"))
    hot = materialize(counted.where(F.col("many") > BLOCK).select("gram"))
    by_size = Window.partitionBy("gram").orderBy("n")
    few = join_keys(rest, hot, "gram", "left_anti").join(counted.where(F.col("many") <= BLOCK).select("gram"), "gram")
    few = few.withColumns({"before": F.lag("n").over(by_size), "after": F.lead("n").over(by_size)})
    few = few.where((100 * F.col("before") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("after")))
    few = few.select(F.xxhash64("gram").alias("key"), "gram", "half", "n", "label", F.lit(HOME + 1).alias("role"))
    step = 1.0001 * math.log(100 / min(percent, 99))
    many = join_keys(rest, hot, "gram", "inner").withColumn("band", F.floor(F.log("n") / step)).withColumn("home", F.explode(F.array(F.lit(True), F.lit(False))))
    many = materialize(many.withColumn("band", F.when(F.col("home"), F.col("band")).otherwise(F.col("band") - 1)))
    bands = many.groupBy("gram", "band").agg(F.count("*").alias("size"), F.max("home").alias("any"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    bands = materialize(bands.where("any and lo < hi").select("gram", "band", F.ceil(F.col("size") / BLOCK).alias("blocks")))
    many = many.join(bands, ["gram", "band"]).withColumn("own", F.pmod(F.xxhash64("half"), F.col("blocks")))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2)
    block = F.xxhash64("gram", "band", F.least("own", "other"), F.greatest("own", "other"))
    many = many.select(block.alias("key"), "gram", "half", "n", "label", (side + F.when(F.col("home"), HOME).otherwise(0)).alias("role"))
    first = F.slice(F.array_sort("grams"), 1, FIRST).alias("first")
    brief = materialize(one.select("half", "n", "bits", first).mapInArrow(lean(_brief), "half long, brief binary, first array<long>"))
    tasks = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = few.unionAll(many).join(brief, "half").repartition(tasks, "key").sortWithinPartitions("key")
    return _ordered(dealt.mapInArrow(lean(_compare(percent)), "half long, other long"))


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Two rows link when ``100 * intersection >= percent * union`` of their
    n-gram sets. component_id is the least id that links reach. Null and empty
    texts have an empty set and link with nothing; texts of fewer than n words
    have one n-gram, the whole sequence. Repeated rows give repeated results; a
    null id stays null and never is another row's component. Other columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    order = docs.sparkSession.sparkContext.broadcast(Order(_count_grams(docs, n)))
    sets = materialize(_sets(docs, order, n, percent))

    # Prefix n-grams that more than one class has. Should two classes have the same half, each gets the n-grams of both.
    postings = sets.where("prefix is not null").select("half", F.explode("prefix").alias("gram"))
    common = materialize(postings.groupBy("gram").agg(F.min("half").alias("lo"), F.max("half").alias("hi")).where("lo < hi").select("gram"))
    drop_shuffles(docs.sparkSession)
    seen = materialize(postings.join(common, "gram").select("half", "gram"))
    drop_shuffles(docs.sparkSession)
    met = seen.groupBy("half").agg(F.collect_set("gram").alias("grams"))
    one = sets.where("prefix is not null").select("sig", "half", "key", "n", "bits", F.size("prefix").alias("prefix")).join(met, "half")
    one = one.groupBy("half", "sig").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first(F.col("prefix") - F.size("grams")).alias("alone"), F.first("grams").alias("grams"))
    one = materialize(one)
    classes = materialize(sets.select("doc_id", "n", "sig"))
    release(sets, common, seen)
    shared = one.select("half", "n", "alone", F.explode("grams").alias("gram"))

    # Stars: the hub of an n-gram has the most in common with others; a class is compared with the hub that it meets most.
    hubs = materialize(shared.groupBy("gram").agg(F.min(F.struct("alone", "half", "n")).alias("hub")))
    stars = shared.select("gram", "half", "n").join(hubs, "gram").select("half", "n", F.col("hub.half").alias("other"), F.col("hub.n").alias("m"), F.col("hub.alone").alias("alone")).where((F.col("half") != F.col("other")) & _sizes_fit("n", "m", percent))
    stars = stars.groupBy("half", "other", "alone").agg(F.count("*").alias("times"))
    nearest = stars.groupBy("half").agg(F.max(F.struct("times", -F.col("alone"), "other")).alias("best")).select("half", F.col("best.other").alias("other"))
    tried = materialize(_ordered(nearest))
    release(hubs)
    links = materialize(_links(materialize(_sketched(tried, one, percent)), docs, one, order, n, percent))
    drop_shuffles(docs.sparkSession)
    label = components(links)

    # What is left: members of one n-gram that are still apart. Labels are compared by their hashes.
    named = one.select("sig", "half", "n").join(label.select(F.col("node").alias("sig"), "component"), "sig", "left").select("half", "n", F.xxhash64(F.coalesce("component", "sig")).alias("label"))
    rest = materialize(shared.select("gram", "half").join(named, "half"))
    left = materialize(_apart(rest, one, percent).join(tried, ["half", "other"], "left_anti"))
    release(rest, tried)
    more = _links(materialize(_sketched(left, one, percent)), docs, one, order, n, percent)
    label = materialize(components(links.unionAll(more)))
    release(one, left, links)

    # From classes to documents.
    rows = classes.join(label.select(F.col("node").alias("sig"), "component"), "sig", "left").select("doc_id", "n", F.coalesce("component", "sig").alias("class"))
    rows = materialize(rows)
    least = materialize(rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size"))
    out = rows.join(least, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("least", "doc_id")).alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return ngram_components(read(spark, sf_dir, "documents"))
