"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, with a softmax.

Every word, every pair of neighbouring words and every character 3- and 4-gram (white space counts as a word's edge) of a text has a row in
one hashed table of learned vectors. A document is the mean of its rows; a softmax layer over it gives
the label's probability. Table and layer are trained by numpy stochastic gradient descent with a linearly
falling rate on at most ``max_rows`` labelled documents, the ones whose ids hash lowest.

Because the layer is linear in the mean, scoring needs one number per table row: the difference of
the two classes' products with that row. Those 2 ** BITS numbers go to the executors, and a text is
scored by one gather and one sum over its whole length.

Defined results: null and empty texts have no rows and get the learned bias; rows with a null doc_id are
not held out and never learned from; null labels are ignored; of several labels of one document the
highest counts; without any labelled row every score is 0.5; rows are scored one by one; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrowtext import mix64, slices, span_hashes, utf8, words

BITS = 18
DIM = 12
GRAMS = (3, 4)
MAX_ROWS = 6000
EPOCHS = 6
RATE = 0.6
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


_PAIR = np.uint64(0x3F84D5B5B5470917)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row, the table rows of its words, word pairs and characters' n-grams, repeats included.

    Characters are taken as Unicode code points. Pairs are hashed by the difference of their words, so all
    immediate repeats of any word share one row.
    """
    data, off = utf8(column)
    starts, ends, first = words(data, off)
    hashes = span_hashes(data, starts, ends)
    word_rows = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    texts = data.tobytes()
    for i in range(len(off) - 1):
        points = np.frombuffer(texts[off[i] : off[i + 1]].decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
        points[(points == 32) | ((points >= 9) & (points <= 13))] = 32
        own = hashes[first[i] : first[i + 1]]
        rows = [word_rows[first[i] : first[i + 1]], (mix64((own[1:] ^ own[:-1]) + _PAIR) >> np.uint64(64 - BITS)).astype(np.int64)]
        acc = np.full(len(points), 0x51, np.uint64)
        for k in range(max(GRAMS)):
            acc = acc[: len(points) - k] * np.uint64(0x100000001B3) + points[k:]
            if k + 1 in GRAMS and len(acc):
                rows.append((mix64(acc * np.uint64(k + 1)) >> np.uint64(64 - BITS)).astype(np.int64))
        yield np.concatenate(rows)


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> list[tuple[str, int]]:
    """(text, label) of the ``max_rows`` labelled, not held-out ids whose hashes are lowest; bounded by that parameter."""
    ids = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("label")).where("id is not null and label is not null")
    ids = ids.where(~held_out("id")).groupBy("id").agg(F.max("label").cast("int").alias("label"))
    some = ids.orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(max_rows)
    named = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    met = named.join(F.broadcast(some), "id").where("text is not null").orderBy(F.xxhash64(F.lit("order"), "id"), "id", "text").limit(max_rows)
    return [(r.text, r.label) for r in met.collect()]


class Classifier:
    """Vectors of all table rows, a layer of two classes and a bias."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        self.layer = np.zeros((2, DIM), np.float32)
        self.bias = np.zeros(2, np.float32)

    def train(self, rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Classifier:
        docs = []
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            for (_, label), found in zip(part, features(pa.array([t for t, _ in part], pa.large_string()))):
                if len(found):
                    keys, n = np.unique(found, return_counts=True)
                    docs.append((keys, (n / n.sum()).astype(np.float32), int(label > 0)))
        if not docs:
            return self
        share = np.mean([y for _, _, y in docs])
        self.bias[:] = np.log(np.clip([1 - share, share], 1e-3, 1))
        rng, steps, done = np.random.default_rng(seed), epochs * len(docs), 0
        for _ in range(epochs):
            for i in rng.permutation(len(docs)):
                keys, weight, label = docs[i]
                step = rate * (1 - done / steps)
                mean = weight @ self.table[keys]
                out = self.layer @ mean + self.bias
                p = np.exp(out - out.max())
                p /= p.sum()
                p[label] -= 1
                pull = self.layer.T @ p
                self.layer -= step * np.outer(p, mean)
                self.bias -= 0.1 * step * p
                # vectors move by the document's share of each row, scaled to the document's length
                self.table[keys] -= (step * len(keys) ** 0.5) * weight[:, None] * pull[None, :]
                done += 1
        return self

    def weights(self) -> tuple[np.ndarray, float]:
        """(one number per table row, bias): class 1 less class 0."""
        return self.table @ (self.layer[1] - self.layer[0]), float(self.bias[1] - self.bias[0])


def score_texts(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    means = [weights[f].mean(dtype=np.float64) if len(f) else 0.0 for f in features(column)]
    return 1 / (1 + np.exp(-(np.array(means) + bias)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """Train on labelled rows that are not held out, score every document."""
    rows = training_rows(docs, labels, doc_id, text, label, max_rows)
    model = docs.sparkSession.sparkContext.broadcast(Classifier().train(rows).weights())  # 2 ** BITS floats

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in slices(batches):
            score = score_texts(batch.column(2), weights, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return named.mapInArrow(work, SCHEMA)
