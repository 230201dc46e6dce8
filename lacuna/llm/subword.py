"""Quality classifier: supervised subword embeddings.

Hashed words, word pairs and byte 3- and 5-grams each have a learned vector (a
word after itself is one pair, whatever the word); a
document is the mean of its vectors; a linear layer and a softmax give the
class. Vectors and layer are trained together by stochastic gradient descent in
numpy. Because the mean is linear, a trained model is one number per bucket,
and scoring is a table lookup over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import textvec
from lacuna.llm.labelled import fold, labelled
from lacuna.llm.session import give_back, lean, read

#: Buckets of each kind of feature, length of vectors, passes over the sample.
BITS, WIDTH, EPOCHS = 15, 8, 4
KINDS = 4
#: Scores from here on count as class 1.
THRESHOLD = 0.7
U64 = np.uint64


def _bucket(x: np.ndarray) -> np.ndarray:
    return ((x * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)).astype(np.int64)


def features(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For runs of documents and each kind: documents, buckets in text order, edges of documents. Case and punctuation count.

    A document that goes on in the next run takes its last word and last bytes
    along, so that no pair or n-gram is lost between runs.
    """
    last = -1
    for docs, raw, starts, begin, end, edges in textvec.spans(texts, textvec.SOLID):
        if docs.start != last:
            word_left, left = np.empty(0, U64), np.empty(0, np.uint8)
        last = docs.start
        word = textvec.span_hashes(raw, begin, end) if len(begin) else np.empty(0, U64)
        yield docs, _bucket(word), edges
        word = np.concatenate([word_left, word])
        edges = np.append(edges[:1], edges[1:] + len(word_left))
        alone = np.ones(len(word), bool)
        alone[edges[1:][np.diff(edges) > 0] - 1] = False
        pair = textvec.mix(word[:-1] * U64(0xD6E8FEB86659FD93) + word[1:])[alone[:-1]] if len(word) > 1 else np.empty(0, U64)
        # Stuttering marks poor text whatever the word is, so all such pairs share what is learned.
        pair[(word[:-1] == word[1:])[alone[:-1]]] = 0
        yield docs, _bucket(pair) + (1 << BITS), np.concatenate([[0], np.cumsum(np.maximum(np.diff(edges) - 1, 0))])
        for k, n in ((2, 3), (3, 5)):
            head = left[max(0, len(left) - n + 1) :]
            own = np.concatenate([head, raw])
            bounds = np.append(starts[:1], starts[1:] + len(head))
            if len(own) < n:
                yield docs, np.empty(0, np.int64), np.zeros(len(starts), np.int64)
                continue
            gram = np.zeros(len(own) - n + 1, U64)
            for b in range(n):
                gram |= own[b : len(own) - n + 1 + b].astype(U64) << U64(8 * b)
            whole = np.ones(len(own), bool)
            for b in range(1, n):
                tail = bounds[1:][np.diff(bounds) >= b] - b
                whole[tail] = False
            yield docs, _bucket(gram[whole[: len(gram)]]) + (k << BITS), np.concatenate([[0], np.cumsum(np.maximum(np.diff(bounds) - n + 1, 0))])
        word_left, left = word[len(word) - min(1, len(word)) :], np.concatenate([left, raw[-4:]])[-4:]


class SubwordModel:
    """One number per bucket and a bias: what mean vectors and softmax come to for two classes."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float64), float(bias)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of class 1; an empty text has only the bias."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for docs, bucket, edges in features(texts):
            total[docs] += textvec.sums(self.weight[bucket], edges)
            count[docs] += np.diff(edges)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -500, 500)))


def _bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document's buckets and their share among its features; only a few texts' features are held at a time."""
    out = []
    for part in textvec.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", textvec.LIMIT):
        parts: list[list[np.ndarray]] = [[] for _ in range(len(part))]
        for docs, bucket, edges in features(part.column(0)):
            for d, own in zip(range(docs.start, docs.stop), np.split(bucket, edges[1:-1]), strict=True):
                parts[d].append(own)
        for own in parts:
            ids, n = np.unique(np.concatenate(own), return_counts=True)
            out.append((ids.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)))
    return out


def _descend(bags: list, y: np.ndarray, epochs: int, rate: float, seed: int) -> SubwordModel:
    """Gradient descent, one document at a time, with a step per bucket that shrinks as the bucket is met."""
    rng = np.random.default_rng(seed)
    size = KINDS << BITS
    vector = rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32)
    layer = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    bias = np.log(np.array([1 + (y == 0).sum(), 1 + (y == 1).sum()], np.float32) / len(y))
    seen = np.full(size, 1e-8, np.float32)
    steps, step = epochs * len(y), 0
    for _ in range(epochs):
        for d in rng.permutation(len(y)).tolist():
            ids, share = bags[d]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ vector[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[d]] -= 1
            back = layer @ g
            seen[ids] += share**2 * float(back @ back)
            vector[ids] -= (lr * share / np.sqrt(seen[ids]))[:, None] * back
            layer -= lr * np.outer(hidden, g)
            bias -= lr * 0.1 * g
    return SubwordModel(vector @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0])


def _sigmoid_fit(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset for which sigmoid(slope * z + offset) fits y best, by Newton's method on smoothed targets."""
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x, theta = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (p - target) + 1e-4 * (theta - [1, 0]))
        theta -= np.clip(step, -1, 1)
    return max(float(theta[0]), 0.05), float(theta[1])


def train(bags: list, y: np.ndarray, *, epochs: int = EPOCHS, rate: float = 0.3, seed: int = 7) -> SubwordModel:
    """Four fifths of the sample train vectors and layer, one fifth calibrates the probabilities; no rows give 0.5 for every text."""
    if not len(y):
        return SubwordModel(np.zeros(KINDS << BITS), 0.0)
    apart = np.arange(len(y)) % 5 == 4
    model = _descend([b for b, out in zip(bags, apart, strict=True) if not out], y[~apart], epochs, rate, seed)
    if len({*y[apart].tolist()}) == 2:
        z = np.array([share @ model.weight[ids] + model.bias for (ids, share), out in zip(bags, apart, strict=True) if out])
        slope, offset = _sigmoid_fit(z, y[apart])
        model = SubwordModel(model.weight * slope, model.bias * slope + offset)
    return model


def _make_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textvec.slices(whole, "text"):
            bags = _bags(batch.column("text"))
            columns = [batch.column(c) for c in ("doc_id", "key", "y")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([b[k].tobytes() for b in bags], pa.binary()) for k in (0, 1))], names=["doc_id", "key", "y", "ids", "share"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bags, y = [], []
    for batch in batches:
        y += batch.column("y").to_pylist()
        bags += [(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)) for i, v in zip(batch.column("ids"), batch.column("share"), strict=True)]
    model = train(bags, np.array(y, np.int64))
    yield pa.RecordBatch.from_pydict({"weight": [model.weight.tobytes()], "bias": [model.bias]})


def fit_quality(docs: DataFrame, labels: DataFrame) -> SubwordModel:
    """Learn from labelled documents whose crc32(doc_id) modulo 4 is not 2.

    All tasks make bags of features of the sample, each of at most as many
    entries as there are buckets; one task descends on them.
    """
    bags = labelled(docs, labels, "quality", fold("doc_id", 4) != 2).mapInArrow(lean(_make_bags), "doc_id long, key long, y int, ids binary, share binary")
    rows = bags.repartition(1).sortWithinPartitions("key", "doc_id").mapInArrow(lean(_learn), "weight binary, bias double").collect()
    return SubwordModel(np.frombuffer(rows[0]["weight"]), rows[0]["bias"]) if rows else train([], np.empty(0))


def scored(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``; null and empty texts get the score of no features, repeated rows one each."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def score(batches):
        known = SubwordModel(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known.score(batch.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(score), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns unchanged. The text stays in the JVM's row."""
    model = fit_quality(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = SubwordModel(*shared.value)
        for texts in batches:
            yield pa.array(known.score(texts))
        give_back()

    return docs.where(score("text") >= threshold)


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = scored(docs, fit_quality(docs, labels))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
