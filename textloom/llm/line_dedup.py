"""Content-defined line chunks, repeated ones removed.

A line ends at a line feed and, since paragraphs are often stored as one line, after a word that ends in
``.``, ``!`` or ``?``. A rolling hash runs over the hashes of the last two lines. A boundary stands before a line
unless the rolling hash there is greater than at both neighbouring lines; so it depends on nothing but the four lines around
it, an inserted line moves only the boundaries beside it, and of two neighbouring lines at least one begins at a boundary.
From every boundary a chunk of at least two lines runs to the first boundary behind its second line, which is two or three
lines, and the last two lines of a text are one, too; chunks overlap, and whatever run of six lines repeats holds a whole chunk. Chunks whose bytes occur more than once in the corpus
stay only at their first place (smallest doc_id, then text hash, then place in the text); so every line
stays at the first of its places. The one or two lines at a passage's start and up to three at its end whose chunks
reach into what stands around it stay.

1. Chunks' 64-bit hashes and places are written as a narrow table. They are counted, and their first places found, with
   partial aggregation before the shuffle.
2. Bytes are compared: a second scan hands on the bytes of chunks that a table of fixed size (as many cells as there are
   repeated hashes, times 16, ``2 ** CELL_BITS`` at most) may hold, and a hash's least and greatest bytes must be
   equal. Where hashes collide, chunks are counted again by their bytes.
3. Places are joined to the first place of their chunk. Chunks that hold a thousandth of all places or more, of which there are
   a thousand at most, are broadcast, so that no task gets all places of a common chunk.
4. Ranges are joined to their documents by (doc_id, text hash), the only shuffle of texts, and cut out there; they may overlap.

Defined results: null text stays null; empty text stays empty; rows that repeat both doc_id and text are
one place and get the same result; a null doc_id orders last; lines without words belong to the line before
them and white space at a chunk's end is not compared; a text of one line has no chunk; a very long text is read in one piece, by the task
that holds its row; an empty table gives an empty result; columns besides text (and n_chars, where it is asked for) pass through
unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrowtext import mix64, slices, span_hashes, utf8, words
from textloom.scratch import materialize, release

#: A chunk with this part of all places or more is joined by broadcast.
HOT = 1000
CELL_BITS = 27
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_SALT = np.uint64(0x452821E638D01377)


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start byte, end byte, hash) of each line with words, from its first word's start to its last word's end."""
    starts, ends, first = words(data, off)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), starts, ends, np.zeros(0, np.uint64)
    row = np.searchsorted(first, np.arange(n), side="right") - 1
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.ones(n, bool)
    last[:-1] = (row[1:] != row[:-1]) | (feeds[starts[1:]] > feeds[ends[:-1]])
    last |= _END[data[ends - 1]]
    to = np.flatnonzero(last)
    at = np.concatenate([[0], to[:-1] + 1])
    return row[at], starts[at], ends[to], span_hashes(data, starts[at], ends[to])


def boundaries(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Does a boundary stand before each line? One stands before every text."""
    n = len(row)
    inner = np.zeros(n, bool)
    inner[1:] = row[1:] == row[:-1]
    before = np.concatenate([[np.uint64(0)], line[:-1]]) if n else line
    rolling = mix64(mix64(before + _SALT) + line)
    peak = np.zeros(n, bool)
    # a text's first line has no rolling hash: the place after it counts as greater than its missing neighbour
    peak[1:] = ~inner[:-1] | (rolling[1:] > rolling[:-1])
    peak[:-1] &= ~inner[1:] | (rolling[:-1] >= rolling[1:])
    return ~(inner & peak)


def chunks(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, start byte, byte after the last word, start byte of what follows, lines, hash) of all chunks."""
    data, off = utf8(column)
    row, start, end, line = lines(data, off)
    n = len(row)
    stands = boundaries(row, line)
    close = np.append(stands, True)
    stands[:-1] |= np.append(row[:-2] != row[2:], True) if n > 1 else False  # the last two lines
    at = np.flatnonzero(stands)
    stop = np.searchsorted(row, row[at], side="right")
    ends = np.flatnonzero(close)
    upto = np.minimum(ends[np.searchsorted(ends, np.minimum(at + 2, n))], stop)
    keep = upto - at > 1
    at, upto, stop = at[keep], upto[keep], stop[keep]
    base, row = off[row[at]], row[at]
    follows = np.where(upto < stop, np.append(start, 0)[upto], off[row + 1])
    hashes = span_hashes(data, start[at], end[upto - 1])
    return row, start[at] - base, end[upto - 1] - base, follows - base, upto - at, hashes.view(np.int64)


def _key(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.cast("long").alias("__id"), F.xxhash64(doc_id.cast("long"), text).alias("__t")]


_PLACE = "__id long, __t long, first int, upto int, c long"


def chunk_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(document's key, place, hash) of every chunk."""
    names = [x.split()[0] for x in _PLACE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, a, _, b, _, h = chunks(batch.column(2))
            at = pa.array(row)
            places = [pa.array(x.astype(np.int32)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *places, pa.array(h)], names=names)

    named = docs.where(F.col(text).isNotNull()).select(*_key(F.col(doc_id), F.col(text)), F.col(text).alias("text"))
    return named.mapInArrow(work, _PLACE)


def chunk_bytes(docs: DataFrame, cells: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(document's key, place, hash, bytes) of the chunks whose cell is set."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(cells))
    shift, names = 64 - (len(cells).bit_length() - 1), [x.split()[0] for x in _PLACE.split(", ")] + ["bytes"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in slices(batches):
            row, a, e, b, _, h = chunks(batch.column(2))
            cell = (h.view(np.uint64) >> np.uint64(shift)).astype(np.int64)
            keep = np.flatnonzero((wanted[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1)
            data, off = utf8(batch.column(2))
            raw, base = data.tobytes(), off[row[keep]]
            found = [raw[x:y] for x, y in zip((base + a[keep]).tolist(), (base + e[keep]).tolist())]
            at = pa.array(row[keep])
            places = [pa.array(x[keep].astype(np.int32)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *places, pa.array(h[keep]), pa.array(found, pa.binary())], names=names)

    named = docs.where(F.col(text).isNotNull()).select(*_key(F.col(doc_id), F.col(text)), F.col(text).alias("text"))
    return named.mapInArrow(work, _PLACE + ", bytes binary")


def _cells(hashes: DataFrame, n: int) -> np.ndarray:
    """Which of at most ``2 ** CELL_BITS`` cells, 64 to a row, hold one of the ``n`` hashes."""
    bits = min(max((16 * n).bit_length(), 10), CELL_BITS)
    cell = hashes.select(F.shiftrightunsigned("c", 64 - bits).alias("cell"))
    rows = cell.select(F.shiftright("cell", 6).alias("place"), F.expr("shiftleft(1L, cast(cell & 63 as int))").alias("bit"))
    table = rows.groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table.column("place").to_numpy()] = table.column("bits").to_numpy()
    return np.unpackbits(out.astype("<i8").view(np.uint8), bitorder="little")


def _owners(places: DataFrame, by: str) -> DataFrame:
    """(key, number of places, first place) of the chunks that are found more than once."""
    first = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__t").alias("t"), F.col("first").alias("at")))
    return materialize(places.groupBy(by).agg(F.count("*").alias("__n"), first.alias("o")).where("__n > 1").withColumnRenamed(by, "__by"), "owners")


def _later_places(places: DataFrame, by: str, owners: DataFrame, total: int) -> DataFrame:
    """(document's key, first, upto) of all places of repeated chunks but each chunk's first one."""
    hot = F.broadcast(owners.where(F.col("__n") * HOT >= total).drop("__n"))  # at most HOT rows
    cold = owners.where(F.col("__n") * HOT < total).drop("__n")
    same = F.col(by) == F.col("__by")
    met = places.join(hot, same).unionByName(places.join(hot.select("__by"), same, "left_anti").join(cold, same))
    own = F.col("o.id").eqNullSafe(F.col("__id")) & (F.col("o.t") == F.col("__t")) & (F.col("o.at") == F.col("first"))
    return met.where(~own).select("__id", "__t", "first", "upto")


def _cut(raw: Column, ranges: Column) -> Column:
    """The text without the byte ranges, sorted by starts and so by ends, and without the white space that a cut leaves at its end."""
    ends = F.concat(F.transform(ranges, lambda r: r["first"]), F.array(F.octet_length(raw)))
    starts = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["upto"]))
    piece = lambda a, b: F.substring(raw, a + 1, F.greatest(b - a, F.lit(0))).cast("string")
    return F.regexp_replace(F.array_join(F.zip_with(starts, ends, piece), ""), r"[\x20\x09-\x0D]+\z", "")


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, cleaned, chunks_removed, bytes_removed): ``row`` is the whole input row as a struct."""
    places = materialize(chunk_table(docs, doc_id, text), "chunks")
    owners, total = _owners(places, "c"), places.count()
    bytes_of = chunk_bytes(docs, _cells(owners.select(F.col("__by").alias("c")), owners.count()), doc_id, text)
    collided = bytes_of.groupBy("c").agg(F.min("bytes").alias("x"), F.max("bytes").alias("y")).where("x <> y").select(F.col("c").alias("__c"))
    collided = materialize(collided, "collided")
    if collided.isEmpty():
        later = _later_places(places, "c", owners, total)
    else:
        meets = F.col("c") == F.col("__c")
        later = _later_places(places.join(collided, meets, "left_anti"), "c", owners, total)
        apart = materialize(bytes_of.join(collided, meets, "left_semi"), "apart")
        later = later.union(_later_places(apart, "bytes", _owners(apart, "bytes"), total))
    spots = later.groupBy(F.col("__id").alias("s0"), F.col("__t").alias("s1")).agg(F.sort_array(F.collect_set(F.struct("first", "upto"))).alias("ranges"))
    spots = materialize(spots, "ranges")
    release(places, owners, collided)  # nothing below reads them
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key(F.col(doc_id), F.col(text)))
    joined = row.join(spots, F.col("__id").eqNullSafe(F.col("s0")) & (F.col("__t") == F.col("s1")), "left").withColumn("text", F.col("row").getField(text))
    n = F.coalesce(F.when(F.col("ranges").isNotNull(), F.size("ranges")), F.lit(0)).cast("long")
    done = joined.select("row", "text", F.when(n == 0, F.col("text")).otherwise(_cut(F.col("text").cast("binary"), F.col("ranges"))).alias("cleaned"), n.alias("chunks_removed"))
    return done.select("row", "cleaned", "chunks_removed", F.coalesce(F.octet_length("text") - F.octet_length("cleaned"), F.lit(0)).cast("long").alias("bytes_removed"))


def clean_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text`` and ``length``, where it is a column, set to the new length.

    A document of which nothing but white space is left, all of it being found elsewhere, goes.
    """
    done = remove_repeated(docs, doc_id, text).where(r"chunks_removed = 0 or cleaned rlike '[^\\x20\\x09-\\x0D]'")
    names = [text] + [length] * (length in docs.columns)
    kinds = dict(docs.dtypes)
    new = {text: F.col("cleaned"), length: F.when(F.col("chunks_removed") > 0, F.length("cleaned")).otherwise(F.col("row").getField(length)) if length in docs.columns else None}
    return done.select(*[(new[c].cast(kinds[c]) if c in names else F.col("row").getField(c)).alias(c) for c in docs.columns])
