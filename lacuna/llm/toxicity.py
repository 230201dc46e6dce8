"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

The lexicon starts from a fixed list of insults and learns more words and word
beginnings from the labelled sample, in any language: those that mark toxic
documents far more often than others. Features are densities of lexicon words,
second-person words near them, capitals, punctuation and obfuscation.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import textvec
from lacuna.llm.boosting import Isotonic, Trees
from lacuna.llm.labelled import fold, labelled
from lacuna.llm.session import lean, read

THRESHOLD = 0.5
#: Parts of the sample for cross-fitting; toxic documents that a word of the lexicon is in, at least.
PARTS, LEAST = 4, 4
U64 = np.uint64

# Insults and second-person words that the lexicon starts from.
INSULTS = "idiot idiots moron morons stupid scum loser losers trash worthless pathetic disgusting clown dumb dumbass fool jerk garbage filth vermin pig pigs hate hateful kill ugly liar bastard bitch crap damn shit fuck fucking asshole retard freak creep coward imbecile".split()
SECOND_PERSON = "you your yours yourself u ur ya tu toi ton ta te tes vous votre vos du dich dir dein deine ihr euch euer sie tú ti tus usted ustedes vosotros".split()

#: Letters and what stands for letters in obfuscated words.
LEET = textvec.table(lambda b: b >= 0x80 or chr(b).isalnum() or chr(b) in "@$!*")
_PLAIN = textvec.LOWER.copy()
_PLAIN[list(b"01345789@$!")] = list(b"oieastbgasi")
#: Beginnings of words that the lexicon may learn, in bytes.
BEGINNINGS = (4, 5, 6, 7)


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.unique(textvec.words(pa.array([" ".join(words)]), textvec.LETTER, textvec.fold_latin)[0])


def _tokens(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the words and of their beginnings; a beginning that is the whole word is 0."""
    folded = textvec.fold_latin(raw)
    starts = []
    for k in BEGINNINGS:
        part = textvec.span_hashes(folded, begin, np.minimum(begin + k, end)) ^ U64(0x5851F42D4C957F2D)
        part[end - begin <= k] = 0
        starts.append(part)
    return textvec.span_hashes(folded, begin, end), starts


def marks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every different word and word beginning of each text, once."""
    found = [(np.empty(0, U64), np.empty(0, np.int64))]
    cut, last = [], -1
    for docs, raw, _, begin, end, edges in textvec.spans(texts, textvec.LETTER):
        if docs.start == last:
            cut.append(last)
        last = docs.start
        if not len(begin):
            continue
        doc = np.repeat(np.arange(docs.start, docs.stop), np.diff(edges))
        word, starts = _tokens(raw, begin, end)
        for h in (word, *starts):
            pair = np.unique(np.rec.fromarrays([h[h != 0], doc[h != 0]], names="h,d"))
            found.append((pair.h, pair.d))
    h, d = (np.concatenate(x) for x in zip(*found, strict=True))
    if cut:
        # A document of several runs counts once for a word that is in more than one of them.
        long = np.isin(d, cut)
        pair = np.unique(np.rec.fromarrays([h[long], d[long]], names="h,d"))
        h, d = np.concatenate([h[~long], pair.h]), np.concatenate([d[~long], pair.d])
    return h, d


def choose(keys: np.ndarray, bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int, *, least: int = LEAST, z: float = 3.5, size: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log-odds of the words and beginnings that mark toxic documents most surely, ``size`` at most, by their counts of documents of both kinds."""
    if not n_bad or not n_good:
        return np.empty(0, U64), np.empty(0)
    odds = np.log((bad + 0.5) / n_bad) - np.log((good + 0.5) / n_good)
    sure = odds / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    pick = np.flatnonzero((bad >= least) & (sure >= z))
    pick = pick[np.lexsort([keys[pick], -sure[pick]])][:size]
    return keys[pick], odds[pick]


def learn_lexicon(texts: pa.Array, y: np.ndarray, **limits) -> tuple[np.ndarray, np.ndarray]:
    """The lexicon of a few texts at hand."""
    h, d = marks(texts)
    keys, at = np.unique(h, return_inverse=True)
    return choose(keys, np.bincount(at, y[d] == 1, len(keys)), np.bincount(at, y[d] != 1, len(keys)), int((y == 1).sum()), int((y != 1).sum()), **limits)


NAMES = "length insults insult_kinds learned learned_kinds learned_most learned_mass beginnings begin_kinds begin_mass near_you you capitals shouted marks questions symbols digits leet spaced stretched repeats hits_all kinds_all".split()


class ToxicModel:
    """Lexicon, trees and calibration; everything that scoring needs."""

    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray], trees: Trees | None = None, steps: Isotonic | None = None):
        self.lexicon, self.trees, self.steps = lexicon, trees, steps
        self.insults = _word_hashes(INSULTS)
        self.seed = textvec.Lookup(self.insults)
        self.you = textvec.Lookup(_word_hashes(SECOND_PERSON))
        self.learned = textvec.Lookup(*lexicon)
        self.any = textvec.Lookup(np.unique(np.concatenate([self.insults, lexicon[0]])))

    def features(self, texts: pa.Array) -> np.ndarray:
        """One row per text. Counts are summed over all runs of a document, then divided by its words or bytes."""
        out = np.zeros((len(texts), len(NAMES)))
        col = {name: k for k, name in enumerate(NAMES)}
        size, odd_words = np.zeros(len(texts)), np.zeros(len(texts))
        none, last = np.empty(0, np.int64), -1
        for docs, raw, starts, begin, end, edges in textvec.spans(texts, textvec.LETTER):
            if docs.start != last:
                # Of the document that goes on in the next run: keys met, places near the end (from 0 down), last word.
                met, you_left, bad_left, before_word = {}, none, none, None
            last = docs.start
            x = out[docs]
            many = len(x)
            words = np.diff(edges)
            size[docs] += np.diff(starts)
            x[:, col["length"]] += words
            if not len(raw):
                continue
            upper = (raw >= 65) & (raw <= 90)
            for name, mask in (("capitals", upper), ("marks", raw == 33), ("questions", raw == 63), ("symbols", np.isin(raw, np.frombuffer(b"*#$%&@^~|", np.uint8))), ("digits", (raw >= 48) & (raw <= 57))):
                x[:, col[name]] += textvec.sums(mask, starts)
            same = np.zeros(len(raw), bool)
            same[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & textvec.LETTER[raw[2:]]
            for k in (0, 1):  # what comes before is another document's
                same[np.minimum(starts[:-1] + k, len(raw) - 1)[starts[:-1] + k < len(raw)]] = False
            x[:, col["stretched"]] += textvec.sums(same, starts)
            if not len(begin):
                continue
            doc = np.repeat(np.arange(many), words)
            word, heads = _tokens(raw, begin, end)
            tally = lambda at, w=None: np.bincount(doc[at], w, many)

            def kinds(name: str, doc_of: np.ndarray, key: np.ndarray, n_keys: int) -> None:
                pair = np.unique(doc_of.astype(np.int64) * max(n_keys, 1) + key)
                if many == 1:
                    pair = np.setdiff1d(pair, met.get(name, none), assume_unique=True)
                    met[name] = np.concatenate([met.get(name, none), pair])
                x[:, col[name]] += np.bincount(pair // max(n_keys, 1), minlength=many)

            seed_at, seed_key = self.seed.find(word)
            x[:, col["insults"]] += tally(seed_at)
            kinds("insult_kinds", doc[seed_at], seed_key, len(self.seed.keys))
            at, key = self.learned.find(word)
            odds = self.learned.values[key] if len(key) else np.empty(0)
            x[:, col["learned"]] += tally(at)
            kinds("learned_kinds", doc[at], key, len(self.learned.keys))
            np.maximum.at(x[:, col["learned_most"]], doc[at], odds)
            x[:, col["learned_mass"]] += tally(at, odds)
            hits = [(doc[at], key)]
            begins, mass = np.zeros(many), np.zeros(many)
            for head in heads:
                a, k = self.learned.find(head)
                begins += tally(a)
                mass += tally(a, self.learned.values[k] if len(k) else np.empty(0))
                hits.append((doc[a], k))
            hit_doc, hit_key = (np.concatenate(v) for v in zip(*hits, strict=True))
            x[:, col["beginnings"]] += begins
            x[:, col["begin_mass"]] += mass
            kinds("begin_kinds", np.concatenate([h[0] for h in hits[1:]]), np.concatenate([h[1] for h in hits[1:]]), len(self.learned.keys))
            kinds("kinds_all", hit_doc, hit_key, len(self.learned.keys))
            x[:, col["hits_all"]] += np.bincount(hit_doc, minlength=many)
            you_at, _ = self.you.find(word)
            x[:, col["you"]] += tally(you_at)
            you_at = np.concatenate([you_left, you_at])
            bad = np.concatenate([bad_left, np.unique(np.concatenate([seed_at, at]))])
            near = np.zeros(len(bad), bool)
            if len(you_at) and len(bad):
                k = np.searchsorted(you_at, bad)
                before, after = you_at[np.maximum(k - 1, 0)], you_at[np.minimum(k, len(you_at) - 1)]
                # Places below 0 are in the run before, thus in the first document.
                of = lambda place: doc[np.maximum(place, 0)]
                near = np.minimum(np.where((before <= bad) & (of(before) == of(bad)), bad - before, 99), np.where((after >= bad) & (of(after) == of(bad)), after - bad, 99)) <= 3
                x[:, col["near_you"]] += np.bincount(of(bad[near]), minlength=many)
            loud = np.concatenate([[0], np.cumsum(upper)])
            x[:, col["shouted"]] += tally(np.flatnonzero((loud[end] - loud[begin] == end - begin) & (end - begin > 2)))
            together, single = doc[1:] == doc[:-1], end - begin == 1
            x[:, col["spaced"]] += tally(np.flatnonzero(single[1:] & single[:-1] & together))
            x[:, col["repeats"]] += tally(np.flatnonzero((word[1:] == word[:-1]) & together))
            if many == 1:
                if before_word is not None:
                    x[0, col["spaced"]] += single[0] & before_word[1]
                    x[0, col["repeats"]] += word[0] == before_word[0]
                before_word = word[-1], single[-1]
                you_left, bad_left = (v[v >= len(word) - 3] - len(word) for v in (you_at, bad[~near]))
        for docs, raw, starts, begin, end, edges in textvec.spans(texts, LEET):
            odd_words[docs] += np.diff(edges)
            odd = np.concatenate([[0], np.cumsum(~textvec.LETTER[raw])]) if len(raw) else np.zeros(1, int)
            hidden = np.flatnonzero((odd[end] > odd[begin]) & (end - begin > 3) & (end - begin < 40) & (10 * (odd[end] - odd[begin]) <= 7 * (end - begin)))
            if len(hidden):
                at, _ = self.any.find(textvec.span_hashes(_PLAIN[raw], begin[hidden], end[hidden]))
                doc = np.searchsorted(edges, hidden[at], "right") - 1
                out[docs][:, col["leet"]] += np.bincount(doc, minlength=len(edges) - 1)
        per = {"leet": odd_words} | dict.fromkeys("capitals marks questions symbols digits stretched".split(), size) | dict.fromkeys("insults learned beginnings begin_mass you near_you shouted spaced repeats".split(), out[:, col["length"]].copy())
        for name, total in per.items():
            out[:, col[name]] /= np.maximum(total, 1)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of a toxic document; without a trained model 0.5 for every text."""
        if self.trees is None or self.steps is None:
            return np.full(len(texts), 0.5)
        return np.clip(self.steps(self.trees.margin(self.features(texts))), 0, 1)


def _lexicons(sample: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part of the sample a lexicon that never saw its labels, and last that of all labels.

    Executors count documents by word, part and label; one task chooses from
    the words that enough toxic documents of the sample have.
    """
    kinds = [(k, t) for k in range(PARTS) for t in (0, 1)]
    sizes = {(r["part"], r["toxic"]): r["count"] for r in sample.groupBy("part", F.when(F.col("y") == 1, 1).otherwise(0).alias("toxic")).count().collect()}
    size = np.array([sizes.get(k, 0) for k in kinds]).reshape(PARTS, 2)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textvec.slices(whole, "text"):
                h, d = marks(batch.column("text"))
                kind = 2 * batch.column("part").to_numpy() + (batch.column("y").to_numpy() == 1)
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "kind": kind[d].astype(np.int32)})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        counts = np.array([np.concatenate([np.empty(0), *(b.column(f"n{k}").to_numpy() for b in found)]) for k in range(2 * PARTS)]).reshape(PARTS, 2, -1)
        keys = np.concatenate([np.empty(0, np.int64), *(b.column("h").to_numpy() for b in found)]).view(U64)
        for k in range(PARTS + 1):
            rest = np.arange(PARTS) != k
            n, by = size[rest].sum(0), counts[rest].sum(0)
            h, odds = choose(keys, by[1], by[0], int(n[1]), int(n[0]))
            yield pa.RecordBatch.from_pydict({"part": [k], "h": [h.tobytes()], "odds": [odds.tobytes()]})

    by_word = sample.mapInArrow(lean(emit), "h long, kind int").groupBy("h").agg(*(F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(2 * PARTS)))
    bad = sum((F.col(f"n{2 * k + 1}") for k in range(PARTS)), F.lit(0))
    rows = by_word.where(bad >= LEAST).repartition(1).mapInArrow(lean(pick), "part long, h binary, odds binary").collect()
    out = [(np.empty(0, U64), np.empty(0))] * (PARTS + 1)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["h"], U64), np.frombuffer(r["odds"])
    return out


def train(sample: DataFrame) -> ToxicModel:
    """Cross-fitted on ``sample(doc_id, key, text, y)``: a document's lexicon features and calibration margin come from models that never saw its label.

    Words are counted, features made and trees of each fold grown by tasks;
    the driver holds lexicons and a table of one feature row per document.
    """
    spark = sample.sparkSession
    sample = sample.select("text", "y", "key", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part"))
    lexicons = _lexicons(sample)
    shared = spark.sparkContext.broadcast(lexicons)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [ToxicModel(x) for x in shared.value]
        for batch in batches:
            part = batch.column("part").to_numpy()
            x = np.zeros((len(batch), len(NAMES)))
            for k in np.unique(part).tolist():
                own = np.flatnonzero(part == k)
                x[own] = models[k].features(batch.column("text").take(pa.array(own)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "part", "y")), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "part", "y", "x"])

    rows = sample.mapInArrow(lean(describe), "key long, part int, y int, x binary").orderBy("key", "x").toArrow()
    y, part = rows.column("y").to_numpy().astype(float), rows.column("part").to_numpy()
    if not 0 < (y == 1).sum() < len(y):
        return ToxicModel((np.empty(0, U64), np.empty(0)))
    x = np.frombuffer(b"".join(rows.column("x").to_pylist())).reshape(len(y), -1)
    data = spark.sparkContext.broadcast((x, y, part))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, part = data.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                own = part == k
                trees = Trees.fit(x[~own], y[~own]) if (~own).any() else None
                margin = trees.margin(x[own]) if trees is not None else np.zeros(int(own.sum()))
                yield pa.RecordBatch.from_pydict({"part": [k], "trees": [pickle.dumps(trees if k == PARTS else None)], "margin": [margin.tobytes()]})

    grown = spark.range(0, PARTS + 1, 1, PARTS + 1).mapInArrow(lean(grow), "part long, trees binary, margin binary").collect()
    margin, trees = np.zeros(len(y)), None
    for r in grown:
        margin[part == r["part"]] = np.frombuffer(r["margin"])
        trees = pickle.loads(r["trees"]) or trees
    return ToxicModel(lexicons[PARTS], trees, Isotonic.fit(margin, y))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Learn from labelled documents whose crc32(doc_id) modulo 5 is not 0."""
    return train(labelled(docs, labels, "toxic", fold("doc_id", 5) != 0))


def scored(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``; null and empty texts get the score of no words, repeated rows one each."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.trees, model.steps))

    def score(batches):
        known = ToxicModel(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known.score(batch.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(score), "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = scored(docs, fit_toxicity(docs, labels))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
