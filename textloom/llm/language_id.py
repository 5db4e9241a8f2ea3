"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a text's or a language's most frequent 1- to 3-grams. A document's distance
to a language sums, over the document's n-grams, how far each is out of place in the language's
list; an n-gram missing there counts as far as the list is long. The nearest language wins.

Profiles are learned from at most about ``per_language`` training documents of each language (their
expected number; each document's own hash decides), all n-grams of whose whole texts are counted on the
executors; only profiles reach the driver. Letters are lower-cased; everything else separates words.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text where
nothing could be learned; ties go to the language first in code point order and n-grams of equal
count rank by code point; rows with a null doc_id are not held out and never learned from; rows are
judged one by one; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.arrowtext import slices
from textloom.scratch import materialize

TOP = 300
MAX_N = 3
PER_LANGUAGE = 4000
#: Languages whose sampling rates are broadcast; beyond it they are joined.
MAX_BROADCAST = 10_000
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_BITS = 21


@lru_cache(1)
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, 0 for what isn't one."""
    table = np.zeros(sys.maxunicode + 1, np.int64)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys, counts); a key holds up to three code points of 21 bits, the first highest, 32 as word edge."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    if not points.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edged = np.concatenate([[0], points, [0]])
    keep = (edged > 0) | np.concatenate([[True], edged[:-1] > 0])
    c = np.where(edged > 0, edged, 32)[keep]
    pairs = (c[:-1] << _BITS) | c[1:]
    triples = (pairs[:-1] << _BITS) | c[2:]
    inner = c[1:-1] != 32
    found = np.concatenate([c[c != 32], pairs, triples[inner]])
    return np.unique(found, return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    if len(keys) > top:
        floor = np.partition(counts, len(counts) - top)[len(counts) - top]
        keys, counts = keys[counts >= floor], counts[counts >= floor]
    return keys[np.lexsort((keys, -counts))][:top]


def held_out(doc_id: str = "doc_id"):
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE, top: int = TOP) -> dict[str, np.ndarray]:
    """{language: ranked n-gram keys} from the rows of ``docs`` with text, language and id."""
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit("language"), F.col(doc_id)).alias("h"), F.col(doc_id).alias("id")).where("lang is not null and id is not null")
    share = materialize(known.groupBy("lang").count().select("lang", F.least(F.lit(1.0), per_language / F.col("count")).alias("share")), "lang")
    if share.count() <= MAX_BROADCAST:
        share = F.broadcast(share)
    chosen = known.join(share, "lang").where("text is not null").where((F.pmod("h", F.lit(1_000_003)) / 1_000_003.0) < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by: dict[str, list[str]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(value)
            for name, texts in by.items():
                keys, counts = gram_counts("\n".join(texts))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    grams = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = grams.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    out: dict[str, list] = {}
    for row in sorted(best.collect(), key=lambda r: (r.lang, r.place)):  # top rows a language
        out.setdefault(row.lang, []).append(row.gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Ranker:
    """Out-of-place distances of a ranked list to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP) -> None:
        self.names, self.top = sorted(profiles), top
        self.keys = np.unique(np.concatenate([profiles[n] for n in self.names])) if self.names else np.zeros(0, np.int64)
        self.place = np.full((len(self.names), len(self.keys) + 1), -1, np.int64)
        for i, n in enumerate(self.names):
            self.place[i, np.searchsorted(self.keys, profiles[n])] = np.arange(len(profiles[n]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys, counts = gram_counts(text or "")
        if not len(keys) or not self.names:
            return "und", 0.0
        mine = ranked(keys, counts, self.top)
        at = np.searchsorted(self.keys, mine)
        known = np.append(self.keys, -1)[at] == mine
        place = self.place[:, np.where(known, at, len(self.keys))]
        away = np.where(place >= 0, np.abs(place - np.arange(len(mine))), self.top).sum(axis=1)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.top * len(mine)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", top: int = TOP) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Ranker(profiles, top)
        for batch in slices(batches):
            found = [judge(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")).mapInArrow(work, SCHEMA)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, predict every document."""
    return predict(docs, learn_profiles(docs.where(~held_out(doc_id)), text, lang, doc_id), doc_id, text)
