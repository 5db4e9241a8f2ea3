"""Counts of each file worked out where its text is read, and counts of lemmas combined before a shuffle.

A file's tokens stay in its row: one row of numbers leaves it. Files that share a path, or have none, are one
file in several rows; ``split_repeated`` takes these out, so that they can be grouped by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import annotate as A
from textloom.functions.forms import NOUN, TAGS, Annotator, hash64, mix64
from textloom.scratch import materialize

COUNTS = ("token_count", "unique_tokens", "content_tokens", "last_line", "snake", "camel", "pascal", "letters", *(f"n_{t}" for t in TAGS))
#: Tokens that a task holds before it combines and hands on their counts.
HELD = 8_000_000


def words_and_breaks(text: Column) -> Column:
    """The words of a text with a line feed for each of its line feeds."""
    return F.regexp_extract_all(text, F.lit(f"{A.WORD}|\\n"), F.lit(0))


def split_repeated(files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(files of one row each, the others or nothing)."""
    many = materialize(files.groupBy("file_path").agg(F.count("*").alias("n")).where("n > 1 or file_path is null").select(F.col("file_path").alias("__path")), "repeated")
    if many.isEmpty():
        return files, None
    same = F.col("file_path").eqNullSafe(F.col("__path"))
    return files.where("file_path is not null").join(many, same, "left_anti"), files.join(many, same, "left_semi")


def file_counts(files: DataFrame) -> DataFrame:
    """(file_path, language, counts...): one row for each row of ``files`` that holds a token."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = Annotator()
        for batch in batches:
            row, form, forms, table = notes.tokens(batch.column(2))
            n = batch.num_rows
            if len(form):
                breaks = np.array([f == "\n" for f in forms.to_pylist()])[form]
                first = np.searchsorted(row, np.arange(n))
                before = np.concatenate([[0], np.cumsum(breaks)])
                line = before[:-1] - before[first[row]] + 1
                keep = ~breaks
                row, form, line = row[keep], form[keep], line[keep]
                count = lambda at, by=None: np.bincount(row[at], None if by is None else by[at], n).astype(np.int64)
                lemma, tag, stop, style, length = table[form, :5].T
                content, noun = stop == 0, tag == NOUN
                last = np.zeros(n, np.int64)
                last[row[content]] = line[content]  # lines rise within a row, so the last one stays
                kinds = np.unique((row[content] << 32) | lemma[content]) >> 32
                columns = [count(slice(None)), np.bincount(kinds, minlength=n), count(content), last, *(count(noun & (style & bit > 0)) for bit in (1, 2, 4)), count(noun, length), *(count(tag == t) for t in range(len(TAGS)))]
                held = pa.array(columns[0] > 0)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(held) for i in (0, 1)] + [pa.array(c.astype(np.int64)).filter(held) for c in columns], ["file_path", "language", *COUNTS])
            if notes.full():
                notes.clear()

    schema = "file_path string, language string, " + ", ".join(f"{c} long" for c in COUNTS)
    return files.select("file_path", "language", words_and_breaks(F.col("text")).alias("w")).mapInArrow(work, schema)


def tag_entropy() -> Column:
    """Shannon entropy in bits of a row's tags."""
    n = F.col("token_count")
    parts = sum((F.when(F.col(f"n_{t}") > 0, F.col(f"n_{t}") * F.log2(F.col(f"n_{t}").cast("double"))).otherwise(0.0) for t in TAGS), F.lit(0.0))
    return F.greatest(F.log2(n.cast("double")) - parts / n, F.lit(0.0))


def n_tags() -> Column:
    return sum((F.when(F.col(f"n_{t}") > 0, 1).otherwise(0) for t in TAGS), F.lit(0))


def lemma_counts(files: DataFrame, by: str) -> DataFrame:
    """(by, lemma, is_stop, freq): tokens of each lemma, counted in the tasks first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes, groups, keys, n = Annotator(), {}, [], 0

        def combined() -> Iterator[pa.RecordBatch]:
            found, freq = np.unique(np.concatenate(keys), return_counts=True)
            names, values = list(notes.lemmas), list(groups)
            stop = np.array([x.lower() in notes.stop_words for x in names])
            names, values = pa.array(names, pa.string()), pa.array(values, pa.string())
            for k in range(0, len(found), 100_000):
                group, lemma = found[k : k + 100_000] >> 32, found[k : k + 100_000] & 0xFFFFFFFF
                yield pa.RecordBatch.from_arrays([values.take(pa.array(group)), names.take(pa.array(lemma)), pa.array(stop[lemma]), pa.array(freq[k : k + 100_000].astype(np.int64))], [by, "lemma", "is_stop", "freq"])

        for batch in batches:
            row, form, _, table = notes.tokens(batch.column(1))
            if len(form):
                group = np.array([groups.setdefault(v, len(groups)) for v in batch.column(0).to_pylist()], np.int64)
                keys.append((group[row] << 32) | table[form, 0])
                n += len(row)
            if n >= HELD or notes.full():
                if n:
                    yield from combined()
                keys, n = [], 0
                if notes.full():
                    notes.clear()
        if n:
            yield from combined()

    counted = files.select(by, A.words(F.col("text")).alias("w")).mapInArrow(work, f"`{by}` string, lemma string, is_stop boolean, freq long")
    return counted.groupBy(by, "lemma", "is_stop").agg(F.sum("freq").alias("freq"))


def scope_columns(files: DataFrame) -> DataFrame:
    """(language, scope, n, column_sum): tokens by the scope of the five lines up to theirs, and the sum of their places in the line as substrings."""
    marks = (("class", ("class ", "class_")), ("function", ("def ", "function ")), ("module", ("import ", "using ")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str | None, str], list[int]] = {}
        for batch in batches:
            for language, text, words in zip(*(batch.column(i) for i in range(3))):
                text, words = text.as_py(), words.as_py()
                if not words:
                    continue
                seen, at = [-9] * len(marks), 0
                lines = text.split("\n")
                for k, line in enumerate(lines):
                    for m, (_, texts) in enumerate(marks):
                        if texts[0] in line or texts[1] in line:
                            seen[m] = k
                    try:
                        end = words.index("\n", at)
                    except ValueError:
                        end = len(words)
                    if end > at:
                        scope = next((name for (name, _), s in zip(marks, seen) if k - s <= 4), "local")
                        total = found.setdefault((language.as_py(), scope), [0, 0])
                        total[0] += end - at
                        total[1] += sum(line.find(w) * c for w, c in Counter(words[at:end]).items())
                    at = end + 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), *(pa.array([v[i] for v in found.values()], pa.int64()) for i in (0, 1))], ["language", "scope", "n", "column_sum"])

    counted = files.select("language", "text", words_and_breaks(F.col("text")).alias("w")).mapInArrow(work, "language string, scope string, n long, column_sum long")
    return counted.groupBy("language", "scope").agg(F.sum("n").alias("n"), F.sum("column_sum").alias("column_sum"))


#: Counters of hashed n-grams; a power of two.
BUCKETS = 1 << 22
_PART = 1 << 16


def _grams(batches: Iterator[pa.RecordBatch], n: int, pattern: list[int] | None, held: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(forms, n columns of places in them, counts, buckets) of the different n-grams of a part of the input."""
    notes, cells, hashes, size = Annotator(), [], [], 0

    def combined():
        nonlocal cells, size
        columns = [np.concatenate(c) for c in zip(*cells)]
        cells, size = [], 0
        forms = notes.forms()
        hashes.extend(map(hash64, forms[len(hashes) :]))
        bits = len(forms).bit_length()
        if bits * n <= 63:
            key = columns[0]
            for c in columns[1:]:
                key = (key << bits) | c
            key, freq = np.unique(key, return_counts=True)
            columns = [(key >> (bits * (n - 1 - i))) & ((1 << bits) - 1) for i in range(n)]
        else:
            key = columns[0]
            for c in columns[1:]:
                key = (np.unique(key, return_inverse=True)[1] << 32) | c
            _, at, freq = np.unique(key, return_index=True, return_counts=True)
            columns = [c[at] for c in columns]
        known, mixed = np.array(hashes, np.uint64), np.zeros(len(freq), np.uint64)
        for c in columns:
            mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + known[c])
        return forms, columns, freq.astype(np.int64), (mixed & np.uint64(BUCKETS - 1)).astype(np.int64)

    for batch in batches:
        row, form, forms, table = notes.tokens(batch.column(0))
        if len(form) >= n:
            broken = np.array([f == "\n" for f in forms.to_pylist()])[form]
            last = len(form) - n + 1
            fits = (row[:last] == row[n - 1 :]) & (table[form[:last], 2] == 0)
            for i in range(n):
                fits &= ~broken[i : last + i]
                if pattern is not None:
                    fits &= table[form[i : last + i], 1] == pattern[i]
            at = np.flatnonzero(fits)
            if len(at):
                cells.append([table[form[at + i], 5] for i in range(n)])
                size += len(at)
        if size >= held or notes.full():
            if size:
                yield combined()
            if notes.full():
                notes.clear()
                hashes = []
    if size:
        yield combined()


def frequent_ngrams(files: DataFrame, n: int, min_freq: int, pattern: list[str] | None, k: int, held: int = HELD) -> DataFrame:
    """(ngram, freq) of at least the ``k`` most frequent n-grams, with their exact counts.

    The tasks' own most frequent n-grams, summed, give a number that the k-th count is not below. Counters of hashed
    n-grams, which no n-gram's count exceeds, then say which n-grams may reach it; only these are shuffled and counted.
    """
    codes = None if pattern is None else [TAGS.index(t) if t in TAGS else -1 for t in pattern[:n]]
    words = files.select(words_and_breaks(F.col("text")).alias("w"))

    def texts(forms: list[str], columns: list[np.ndarray], at: np.ndarray) -> pa.Array:
        return pa.array([" ".join(forms[i] for i in gram) for gram in zip(*(c[at].tolist() for c in columns))], pa.string())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(BUCKETS, np.int64)
        for forms, columns, freq, bucket in _grams(batches, n, codes, held):
            np.add.at(counters, bucket, freq)
            top = np.argpartition(freq, -k)[-k:] if len(freq) > k else np.arange(len(freq))
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(top), pa.int32()), pa.nulls(len(top), pa.binary()), texts(forms, columns, top), pa.array(freq[top])], ["part", "counters", "ngram", "freq"])
        for p in range(0, BUCKETS, _PART):
            if counters[p : p + _PART].any():
                packed = pa.compress(counters[p : p + _PART].tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], ["part", "counters", "ngram", "freq"])

    seen = materialize(words.mapInArrow(first, "part int, counters binary, ngram string, freq long"), "ngrams")
    least = [r.freq for r in seen.where("part < 0").groupBy("ngram").agg(F.sum("freq").alias("freq")).orderBy(F.desc("freq")).limit(k).collect()]
    threshold = max(min_freq, least[-1] if len(least) == k else 1)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counters = np.frombuffer(pa.decompress(packed, decompressed_size=8 * _PART, codec="zstd", asbytes=True), np.int64)
                total[p] = total[p] + counters if p in total else counters
        for p, counters in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(counters >= threshold).tobytes()], pa.binary())], ["part", "bits"])

    may = np.zeros(BUCKETS, bool)
    for r in seen.where("part >= 0").select("part", "counters").repartition("part").mapInArrow(reached, "part int, bits binary").collect():
        may[r.part : r.part + _PART] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8)).astype(bool)
    may = files.sparkSession.sparkContext.broadcast(may)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forms, columns, freq, bucket in _grams(batches, n, codes, held):
            at = np.flatnonzero(may.value[bucket])
            for i in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([texts(forms, columns, at[i : i + 50_000]), pa.array(freq[at[i : i + 50_000]])], ["ngram", "freq"])

    return words.mapInArrow(second, "ngram string, freq long").groupBy("ngram").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= min_freq)
