"""Order-preserving packing by dynamic programming.

A document's ids are its tokens and one id 0 at its end. Documents are laid end to end in the order
of the input and cut into sequences of at most ``limit`` ids. Cuts are chosen among document
and sentence ends (inside a sentence only where none is near), minimising padding plus a penalty per cut that splits a
sentence or a document. cost(sequence) is linear in its length (limit - length padding), so the best
earlier cut within a window of ``limit`` ids is a sliding minimum, kept in a monotone queue: each
candidate enters and leaves the queue once. A sequence whose length is a power of two needs no
padding; the lengths 64, 128, 256 and 512 are tried beside the queue.

Work is done per input partition in runs of about ``run_ids`` ids; an unfinished last sequence is
carried into the next run, so memory is bounded by a run plus the longest document, nothing is
shuffled, and a lost task is repeated alone. Sequences do not cross partitions: at most one
partition end each is padded. sequence_id holds the partition's number above 33 bits.

Defined results: null or empty text is the single id 0; a null doc_id is carried; repeated rows are
packed one by one; an empty table gives no rows; other columns, whatever their names, are ignored. The string of a token
added to the vocabulary, such as ``<|endoftext|>``, is that token, as ``tokenizers`` reads it.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrowtext import slices

LIMIT = 1024
#: What a cut costs, in padded ids: inside a sentence, at a sentence end inside a document.
SPLIT_SENTENCE = 24
SPLIT_DOCUMENT = 6
GAP = 64
RUN_IDS = 65_536
CACHE_ENTRIES = 400_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: White space other than space and line feed; with the pairs below, all that cannot be cut at a space.
_RARE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_PAIRS = ["  ", " \n", "\n "]


class _Pieces(dict):
    """Token ids, as little-endian bytes, of pieces of text; the first ``CACHE_ENTRIES`` met are kept."""

    def __init__(self, core) -> None:
        self.core = core

    def __missing__(self, piece: str) -> bytes:
        word = piece[1:] if piece[:1] == " " else piece
        # a word of letters is one piece for the tokenizer, so its pattern need not run
        ids = self.core.encode_single_piece(piece.encode()) if word.isalpha() else self.core.encode_ordinary(piece)
        raw = array("I", ids).tobytes()
        if len(self) < CACHE_ENTRIES and len(piece) < 64:
            self[piece] = raw
        return raw


class Encoder:
    """The ids that ``tokenizers`` gives with ``byte_bpe_50k.json``.

    Texts that hold a token added to that file are encoded by ``tokenizers``; all others by the
    same vocabulary's rank file, which gives the same ids (tests compare them) in less time. The pattern never joins what stands before a space between two non-space characters with what
    follows, so text is cut there and the pieces' ids are cached. Texts with other runs of white
    space around a space are encoded whole.
    """

    def __init__(self, vocabulary: str, ranks_path: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = _Pieces(self.core._core_bpe)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()
        if any(p in text for p in _PAIRS) or any(c in text for c in _RARE):
            return array("I", self.core.encode_ordinary(text)).tobytes()
        head, *rest = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        pieces = self.pieces
        return pieces[head] + b"".join([pieces[x] for x in rest])


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: str | None = None, ranks_path: str | None = None) -> Encoder:
    import public_tokenizers

    key = (vocabulary or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


_ends: dict[tuple, np.ndarray] = {}


def sentence_end_ids(ranks_path: str | None = None) -> np.ndarray:
    """True for ids whose bytes end in . ! ? or a line feed."""
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ends:
        with open(path, "rb") as lines:
            table = [(int(b), base64.b64decode(a)[-1:]) for a, b in map(bytes.split, lines)]
        marks = np.zeros(max(i for i, _ in table) + 2, bool)
        marks[[i for i, last in table if last in (b".", b"!", b"?", b"\n")]] = True
        _ends[path] = marks
    return _ends[path]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties): where the stream may be cut, 0 first and its length last.

    These are the ends of documents and sentences; stretches of over ``gap`` ids without any can
    also be cut inside a sentence, every ``gap`` ids.
    """
    n = len(ids)
    price = np.full(n + 1, -1, np.int64)
    price[np.flatnonzero(sentence[ids]) + 1] = SPLIT_DOCUMENT
    price[doc_ends] = 0
    price[[0, n]] = 0
    at = np.flatnonzero(price >= 0)
    wide = np.flatnonzero(np.diff(at) > gap)
    if len(wide):
        price[np.concatenate([np.arange(at[i] + gap, at[i + 1], gap) for i in wide])] = SPLIT_SENTENCE
        at = np.flatnonzero(price >= 0)
    return at, price[at]


def choose_cuts(at: np.ndarray, price: np.ndarray, limit: int = LIMIT) -> list[int]:
    """The cheapest cuts from at[0] to at[-1]: sum of (limit - length, 0 at a power of two) plus the cuts' prices."""
    pos, cost, m = at.tolist(), price.tolist(), len(at)
    place = np.full(pos[-1] + 1, -1, np.int64)
    place[at] = np.arange(m)
    short = [2**k for k in range(6, 20) if 2**k < limit]
    # for each position, the positions that lie a power of two before it
    tries: dict[int, list[int]] = {}
    for length in short:
        far = at - length
        k = np.where(far >= 0, place[np.maximum(far, 0)], -1)
        for i in np.flatnonzero(k >= 0).tolist():
            tries.setdefault(i, []).append(int(k[i]))
    best, back, value = [0] * m, [0] * m, [0] * m
    queue, head = [0], 0
    for i in range(1, m):
        here = pos[i]
        oldest = here - limit
        while pos[queue[head]] < oldest:
            head += 1
        j = queue[head]
        low = value[j] + limit - here
        if i in tries:
            for k in tries[i]:
                if best[k] < low:
                    low, j = best[k], k
        low += cost[i]
        best[i], back[i] = low, j
        value[i] = now = low + here
        while len(queue) > head and value[queue[-1]] >= now:
            queue.pop()
        queue.append(i)
    cuts, i = [], m - 1
    while i:
        cuts.append(pos[i])
        i = back[i]
    return [0, *reversed(cuts)]


class _Run:
    """Documents waiting to be packed: ids, and for each document (doc_id, ids before the run, total)."""

    def __init__(self, limit: int, marks: np.ndarray, base: int) -> None:
        self.limit, self.marks, self.sequence = limit, marks, base
        self.docs: list[tuple] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.parts.append(ids)
        self.size += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        """Rows of all sequences, but for the last one unless ``last``; what is left waits for the next run."""
        if not self.size:
            return []
        ids = np.concatenate(self.parts)
        ends = np.cumsum([n for _, _, n, _ in self.docs])
        cuts = choose_cuts(*cut_points(ids, ends, self.marks), self.limit)
        stop = len(cuts) - 1 if last else max(len(cuts) - 3, 1)
        rows, doc, done = [], 0, 0
        raw = ids.astype("<u4", copy=False).tobytes()
        for a, b in zip(cuts[:stop], cuts[1 : stop + 1]):
            offset = 0
            while a < b:
                doc_id, before, n, total = self.docs[doc]
                upto = min(b, done + n)
                rows.append((doc_id, before + a - done, upto - a, zlib.crc32(raw[4 * a : 4 * upto]), total, self.sequence, offset))
                offset += upto - a
                a = upto
                if a == done + n:
                    doc, done = doc + 1, done + n
            self.sequence += 1
        end = cuts[stop]
        if end < len(ids):
            doc_id, before, n, total = self.docs[doc]
            self.docs = [(doc_id, before + end - done, n - (end - done), total), *self.docs[doc + 1 :]]
            self.parts = [ids[end:]]
        else:
            self.docs, self.parts = [], []
        self.size = len(ids) - end
        return rows


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, vocabulary: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence. ``ranks_path``: the vocabulary's rank file."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, marks = encoder(vocabulary, ranks_path), sentence_end_ids(ranks_path)
        run = _Run(limit, marks, TaskContext.get().partitionId() << 33)
        end = b"\0\0\0\0"
        for batch in slices(batches):
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                run.add(key, np.frombuffer(encode(value or "") + end, "<u4"))
                if run.size >= RUN_IDS:
                    yield _table(run.pack(False))
        yield _table(run.pack(True))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, SCHEMA)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names=names)
