"""Quality classifier: logistic regression on hashed word n-grams, learned by FTRL-proximal.

Features: words and pairs of words, and the same over word shapes (the first two and last three
characters with letters and digits made alike, or "=" for a word that repeats the one before), hashed
to 2^18 places; values are log(1 + count), scaled to length 1. Scores are sparse dot products.

Training: at most `bound` labelled documents (a documented parameter) in parts of about `shard_rows`, by
their place in the sample; each part is learned by itself in a task, in that order, `epochs` times, and
the weights are averaged. A task holds the features of one part.

Defined results: null and empty texts get the score of the bias alone; repeated rows get equal rows; a
null doc_id is scored; without labels every score is 0.5; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import table
from inkwell.llm.labels import labelled, remainder

BITS, BOUND, SHARD_ROWS, EPOCHS, THRESHOLD = 18, 16_000, 2_000, 10, 0.7
_KIND = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _places(hashes: np.ndarray, family: int, bits: int) -> np.ndarray:
    return ((hashes * np.uint64(2) + np.uint64(2 * family + 1)) * _MIX) >> np.uint64(64 - bits)


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, values)."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    n = len(words)
    w = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    s = np.fromiter([zlib.crc32(x[:2] + x[-3:]) for x in raw.translate(_KIND).split()], np.uint64, n)
    s[1:][w[1:] == w[:-1]] = np.uint64(61)
    pair = lambda h: h[:-1] * np.uint64(0x100000001B3) + h[1:]
    found = np.concatenate([_places(w, 1, bits), _places(pair(w), 2, bits), _places(s, 3, bits), _places(pair(s), 4, bits)])
    places, counts = np.unique(found.astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    return places, values / np.sqrt(values @ values)


class Ftrl:
    """Follow the regularised leader, proximal, for logistic loss; the last place is the bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(places, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-max(-30.0, min(30.0, x))))


def score(weights: np.ndarray, places: np.ndarray, values: np.ndarray) -> float:
    return float(sigmoid(float(weights[places] @ values) + float(weights[-1])))


def _learn(epochs: int, bits: int):
    """(text, label, place, shard) to a row of weights for each shard."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            for text, label, place, shard in zip(*(c.to_pylist() for c in batch.columns)):
                places, values = features(text, bits)
                kept.setdefault(shard, []).append((place, places.astype(np.int32), values.astype(np.float32), label))
        for shard in sorted(kept):
            model = Ftrl(1 << bits)
            rows = sorted(kept.pop(shard), key=lambda r: r[0])
            for _ in range(epochs):
                for _, places, values, label in rows:
                    model.learn(places, values, label)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["rows", "weights"])

    return of


def train(docs: DataFrame, labels: DataFrame, label: str, held_out, bound: int = BOUND, shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """The weights, the bias last: a vector of 2^bits floats for each part comes to the driver."""
    sample, size = labelled(docs, labels, label, held_out, bound)
    shards = max(1, -(-size // shard_rows))
    sample = sample.withColumn("shard", F.col("place") % shards)
    dealt = sample.select("text", "label", "place", "shard").repartition(shards, "shard")
    found = dealt.mapInArrow(_learn(epochs, bits), "rows long, weights binary").collect()
    if not found:
        return np.zeros((1 << bits) + 1, np.float32)
    return np.average([np.frombuffer(r["weights"], np.float32) for r in found], axis=0, weights=[r["rows"] for r in found]).astype(np.float32)


def scored(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """(doc_id, score), a row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(shared.value, *features(x.as_py(), bits)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"), "quality", remainder(4) == 2)
    return scored(docs, weights).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
