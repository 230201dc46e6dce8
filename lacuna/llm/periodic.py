"""Periodic runs of words, found by seeds that are extended along diagonals.

A run of smallest period q and length L is a diagonal: L - q words in a row
that equal the word q further on. A run counts from a length of
max(LEAST, 2 * q) on, so its diagonal has at least max(LEAST - q, q) words, and
every lag has a k-gram length that each of its diagonals must hold. Lags are
taken in bands [k, 2k), with one index of k-grams for a band: pairs of a
k-gram's occurrences in one document, a lag of the band apart, are seeds. A
table of how far each lag is covered leaves out seeds on a diagonal that is
known. Inside a run of a shorter period, whose k-grams occur again and again,
only those of its first period are seeds, so that seeds grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.session import lean, read

#: Words of a run, at least; periods that it holds, at least.
LEAST, TIMES = 12, 2
#: The k-gram that every diagonal of a lag under 8 holds; words that are searched at once (a longer text is searched alone).
FIRST, WORDS = 6, 500_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each different pair."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


class Grams:
    """Numbers of the k-grams at the places where a k-gram occurs more than once in its document; k doubles."""

    def __init__(self, n: int, k: int, at: np.ndarray, number: np.ndarray):
        again = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        self.n, self.k, self.at, self.number = n, k, at[again], number[again]

    def longer(self, by: Grams | None = None) -> Grams:
        """The grams of self followed by those of ``by`` (itself if not given)."""
        by = by or self
        slot = np.full(self.n + 1, -1)
        slot[by.at] = by.number
        follow = slot[np.minimum(self.at + self.k, self.n)]
        keep = follow >= 0
        return Grams(self.n, self.k + by.k, self.at[keep], _pairs(self.number[keep], follow[keep]))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of every place of the half-open ranges."""
    size = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which]


def seeds(grams: Grams, low: int, high: int, known: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of pairs of occurrences of a k-gram, lags from ``low`` until before ``high``.

    ``known`` are runs (start, end, period) of shorter periods. Two occurrences
    in one run whose period is at most half a k-gram have a multiple of its
    period as lag and show nothing new. Otherwise a diagonal begins within the
    first period of a run that one of its occurrences is in, or outside all.
    """
    n, at, number = grams.n + 1, grams.at, grams.number
    order = np.lexsort((at, number))
    at, number = at[order], number[order]
    start, end, period = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for s, e, p in known:
        if 2 * p <= grams.k <= e - s:
            inside = slice(s, e - grams.k + 1)
            start[inside], end[inside], period[inside] = s, e, p
    in_run, head = start[at] >= 0, at < start[at] + period[at]
    key = number * n + at
    base = number * n
    forward = np.flatnonzero(~in_run | head)
    i = at[forward]
    least = np.maximum(i + low, np.where(in_run[forward], end[i] - grams.k + 1, 0))
    a, j = _ranges(np.searchsorted(key, base[forward] + least), np.searchsorted(key, base[forward] + np.minimum(i + high, n)))
    back = np.flatnonzero(~in_run | head) if known else np.zeros(0, np.int64)
    j2 = at[back]
    b, i2 = _ranges(np.searchsorted(key, base[back] + np.maximum(j2 - high + 1, 0)), np.searchsorted(key, base[back] + np.maximum(j2 - low + 1, 0)))
    places = np.concatenate([i[a], at[i2]])
    return places, np.concatenate([at[j], j2[b]]) - places


def _reach(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step``, equal the word ``lag`` further on."""
    done, block, n = 0, 16, len(words)
    while True:
        size = min(block, n - lag - at - done if step > 0 else at - done + 1)
        if size <= 0:
            return done
        lo = at + done if step > 0 else at - done - size + 1
        differ = words[lo : lo + size] != words[lo + lag : lo + lag + size]
        if differ.any():
            return done + int(np.argmax(differ if step > 0 else differ[::-1]))
        done, block = done + size, block * 4


def extend(words: np.ndarray, places: np.ndarray, lags: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, lag) of the longest diagonal through each seed, once each, by lag and start."""
    covered: dict[int, int] = {}
    for i in np.lexsort((places, lags)).tolist():
        at, lag = int(places[i]), int(lags[i])
        if covered.get(lag, -1) > at:
            continue
        end = at + k + _reach(words, at + k, lag, 1)
        covered[lag] = end
        yield at - _reach(words, at - 1, lag, -1), end, lag


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, end exclusive, by start and period.

    ``words`` are numbers; words of different documents must have different
    ones, so that nothing repeats across them. No document has more than
    ``longest`` words.
    """
    found: dict[tuple[int, int], int] = {}
    one = Grams(len(words), 1, np.arange(len(words)), words)
    two = one.longer()
    four = two.longer()
    band, low = four.longer(two), 1
    while len(band.at) and TIMES * low <= longest:
        high = FIRST + 2 if low == 1 else 2 * low
        places, lags = seeds(band, low, high, [(s, e, p) for (s, e), p in found.items()])
        for s, e, lag in extend(words, places, lags, band.k):
            # A longer period of the same stretch is a multiple of the one that is there.
            if e + lag - s >= max(LEAST, TIMES * lag):
                found.setdefault((s, e + lag), lag)
        band, low = (four.longer() if low == 1 else band.longer()), high
    return sorted((s, e, p) for (s, e), p in found.items())


def _search(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text, all texts searched as one array."""
    split = [t.split() for t in texts]  # bytes split at the white space of ASCII only
    numbers: dict[tuple[int, bytes], int] = {}
    words = np.array([numbers.setdefault((k, w), len(numbers)) for k, own in enumerate(split) for w in own], np.int64)
    runs = find_runs(words, max(map(len, split), default=0))
    first, at = 0, 0
    for own in split:
        mine = []
        while at < len(runs) and runs[at][0] < first + len(own):
            s, e, p = runs[at]
            mine.append((s - first, e - first, p))
            at += 1
        yield own, mine
        first += len(own)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, of each run its first period only."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, e, p in runs:
        edge[s + p] += 1
        edge[e] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def _chunks(texts: list[bytes | None], size: int = WORDS) -> Iterator[list[bytes]]:
    """Texts in order, so many at a time as have ``size`` words at most (by their bytes), or one."""
    chunk, held = [], 0
    for text in texts:
        text = text or b""
        if chunk and held + len(text) > 2 * size:
            yield chunk
            chunk, held = [], 0
        chunk.append(text)
        held += len(text)
    if chunk:
        yield chunk


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's (doc_id, runs, collapsed): its runs by start and period, and its words with only the first period of each run.

    Words are divided by ASCII white space. A run is a stretch of words with
    smallest period q, of at least max(12, 2 * q) words, that no neighbour
    extends. A null or empty text has no runs and collapses to nothing.
    Repeated rows and rows without an id get a result each. Other columns are
    ignored; an empty table gives an empty one. Each document is searched
    whole, in one task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done = batch.column(1).cast(pa.binary()).to_pylist(), 0
            for chunk in _chunks(texts):
                runs, collapsed = [], []
                for words, own in _search(chunk):
                    runs.append([{"start": s, "length": e - s, "period": p} for s, e, p in own])
                    collapsed.append(collapse(words, own).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(chunk)), pa.array(runs, pa.list_(RUN)), pa.array(collapsed, pa.string())], names=["doc_id", "runs", "collapsed"])
                done += len(chunk)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(work), f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def damaged(text: Column, doc_id: Column) -> Column:
    """Every tenth document by crc32 of its id, with its end made of repetitions of a few words; others as they are, as is one without an id."""
    words = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"))
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def periodic(w: Column) -> Column:
        g, n = F.floor(h / 10), F.greatest(F.size(w), F.lit(1))
        a = F.pmod(g, n)
        period = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        chosen = F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, period)).cast("int")))
        return F.array_join(chosen, " ")

    # The words are one element of an array, so that they are not divided again for each of them.
    once = F.get(F.transform(F.array(words), periodic), 0)
    return F.when((h % 10 == 0) & F.rlike(text, F.lit("[^\\x20\\x09-\\x0D]")), once).otherwise(text)


def _sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, every tenth of which is damaged: number, longest, and digests of runs and collapsed text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs.select("doc_id", damaged(F.col("text"), F.col("doc_id")).alias("text")))
    # The longest; of these the first, then the one of least period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), _sha256(F.array_join(lines, "")).alias("runs_sha256"), _sha256(F.col("collapsed")).alias("collapsed_sha256"))
    length, start, period = F.col("best.length"), -F.col("best.start"), -F.col("best.period")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
