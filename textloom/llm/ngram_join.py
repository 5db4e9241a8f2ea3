"""N-gram Jaccard self-join with rare-first prefix filtering, and the components of its links.

A document is its set of distinct word shingles (64-bit hashes of n words; A-Z lower-cased). Two link
when den * |A & B| >= num * |A | B|.

1. Documents with equal sets are one class (a 128-bit sum over the set), so copies cost one row each.
2. Shingle frequencies are counted over all documents in ``2 ** BUCKET_BITS`` hashed counters, a table of
   fixed size that is broadcast. Every set is ordered rare-first: by counter, then by hash. Any fixed
   order keeps the join whole; this one keeps what many documents share out of the prefixes.
3. Sets that link share a shingle among their first n - ceil(n * num / den) + 1. These prefixes are joined
   on the shingle under the length filter, the positional filter and two suffix filters that split the sets
   into cells by hash: 128 parity bits inside the join, then the members of 64 cells, counted, for each
   pair. Both differ by at most the sets' symmetric difference, so no link is lost.
4. Links are only needed between different components. First each shingle's posting list is joined to
   one pivot, the set in which the shingle stands earliest, which is linear in the list and links a group of near
   copies without making its pairs. Then only pairs of sets in different components are still
   candidates, and all of them are tried. Every pair of texts that link ends in one component.
5. Each candidate pair is verified once, on the whole sets.

Defined results: a document with fewer than n words has its whole sequence as one shingle; without
words its set is empty and it links with nothing, equal rows included; rows that repeat a doc_id
are documents of their own; a null doc_id joins components and never names one unless all ids there are null;
a very long text is worked on in one row, as arrays of its words' hashes; an empty table gives an empty result; other columns pass through ``drop_near_copies`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrowtext import distinct_shingles, long_lists, mix64, slices
from textloom.operators.components import connected_components
from textloom.scratch import materialize, release

BUCKET_BITS = 18
BITMAP_BITS = 23
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits that don't depend on the set's order; (0, 0) is the empty set's."""
    return tuple(int(mix64(found ^ s).sum(dtype=np.uint64).view(np.int64)) for s in _SEEDS)


def parity(found: np.ndarray) -> tuple[int, int]:
    """Bit i: is the number of members in cell i odd."""
    odd = np.bincount((mix64(found ^ np.uint64(0xA4093822299F31D0)) & np.uint64(127)).astype(np.int64), minlength=128) & 1
    low, high = np.packbits(odd.astype(np.uint8)).view("<i8")
    return int(low), int(high)


def cell_counts(found: np.ndarray) -> bytes:
    """Members in each of 64 cells, 255 at most: sets differ by at least the sum of these differences."""
    n = np.bincount((mix64(found ^ np.uint64(0xC0AC29B7C97C50DD)) & np.uint64(63)).astype(np.int64), minlength=64)
    return np.minimum(n, 255).astype(np.uint8).tobytes()


def prefix_size(n: int, num: int, den: int) -> int:
    return n - (n * num + den - 1) // den + 1


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def _scan(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(one row per document with its class key, counters of all shingles)."""
    names = ["doc_id", "n_shingles", "fp1", "fp2", "bucket", "hits"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        lists = pa.list_(pa.int64())
        for batch in slices(batches):
            sets = distinct_shingles(batch.column(1), n)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((every >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
            fps = [fingerprint(s) for s in sets]
            yield _batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in fps], pa.int64()), pa.array([b for _, b in fps], pa.int64()), pa.nulls(len(sets), lists), pa.nulls(len(sets), lists)], names)
        used = np.flatnonzero(counts)
        yield _batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([used], lists), pa.array([counts[used]], lists)], names)

    scanned = materialize(docs.mapInArrow(work, "doc_id long, n_shingles long, fp1 long, fp2 long, bucket array<long>, hits array<long>"), "sets")
    rows = scanned.where("n_shingles is not null").select("doc_id", "n_shingles", "fp1", "fp2")
    merged = scanned.where("bucket is not null").select(F.explode(F.arrays_zip("bucket", "hits")).alias("z")).groupBy("z.bucket").agg(F.sum("z.hits").alias("hits"))
    table = merged.toArrow()  # at most 2 ** BUCKET_BITS rows
    counters = np.zeros(1 << BUCKET_BITS, np.int64)
    counters[table.column("bucket").to_numpy()] = table.column("hits").to_numpy()
    return rows, counters


def _classes(docs: DataFrame, counters: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """One row per distinct set: cid, fp1, fp2, n, min_doc, prefix (rare-first), parity bits."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)
    names = ["doc_id", "fp1", "fp2", "n", "prefix", "bits1", "bits2", "cells"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = shared.value
        for batch in slices(batches):
            sets = distinct_shingles(batch.column(1), n)
            keep = [i for i, s in enumerate(sets) if len(s)]
            sets = [sets[i] for i in keep]
            prefixes = []
            for s in sets:
                count, take = hits[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], prefix_size(len(s), num, den)
                if take < len(s):
                    limit = np.partition(count, take - 1)[take - 1]
                    s, count = s[count <= limit], count[count <= limit]
                prefixes.append(s[np.lexsort((s, count))][:take])
            fps, bits = [fingerprint(s) for s in sets], [parity(s) for s in sets]
            cols = [[a for a, _ in fps], [b for _, b in fps], [len(s) for s in sets]]
            yield _batch([batch.column(0).take(pa.array(keep, pa.int64())), *[pa.array(c, pa.int64()) for c in cols], long_lists(prefixes), pa.array([a for a, _ in bits], pa.int64()), pa.array([b for _, b in bits], pa.int64()), pa.array([cell_counts(s) for s in sets], pa.binary())], names)

    found = docs.mapInArrow(work, "doc_id long, fp1 long, fp2 long, n long, prefix array<long>, bits1 long, bits2 long, cells binary")
    one = found.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("min_doc"), *[F.first(c).alias(c) for c in ("n", "prefix", "bits1", "bits2", "cells")])
    return materialize(one.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Length, positional and suffix filters for two postings of one shingle."""
    col = lambda side, name: F.col(f"{side}.{name}")
    na, nb = col(a, "n"), col(b, "n")
    need = F.expr(f"({num} * ({a}.n + {b}.n) + {num + den - 1}) div {num + den}")
    length = (num * F.greatest(na, nb)) <= (den * F.least(na, nb))
    place = F.least(na - col(a, "pos"), nb - col(b, "pos")) >= need
    apart = F.bit_count(col(a, "bits1").bitwiseXOR(col(b, "bits1"))) + F.bit_count(col(a, "bits2").bitwiseXOR(col(b, "bits2")))
    return length & place & (apart <= na + nb - 2 * need)


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("a.cid", "b.cid").alias("a"), F.greatest("a.cid", "b.cid").alias("b")).distinct()


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose cells do not already show them to be too far apart."""
    side = lambda k, n, c: classes.select(F.col("cid").alias(k), F.col("n").alias(n), F.col("cells").alias(c))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, n = (batch.column(i).to_numpy() for i in range(4))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 64).astype(np.int16) for i in (4, 5))
            need = (num * (m + n) + num + den - 1) // (num + den)
            keep = np.abs(x - y).sum(axis=1) <= m + n - 2 * need
            yield _batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    joined = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")
    return materialize(joined.mapInArrow(work, "a long, b long"), "near")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    left, right = sets.select(F.col("cid").alias("a"), F.col("members").alias("x")), sets.select(F.col("cid").alias("b"), F.col("members").alias("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = []
            for i in range(batch.num_rows):
                u, v = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = np.concatenate([u, v])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(den * shared >= num * (len(u) + len(v) - shared))
            keep = pa.array(np.flatnonzero(ok))
            yield _batch([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """Which of ``2 ** BITMAP_BITS`` cells hold a wanted class: a table of fixed size, 64 cells to a row."""
    cell = F.shiftrightunsigned("fp1", 64 - BITMAP_BITS)
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    rows = wanted.select(cell.alias("cell")).select(F.shiftright("cell", 6).alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[rows.column("place").to_numpy()] = rows.column("bits").to_numpy()
    return np.unpackbits(out.astype("<i8").view(np.uint8), bitorder="little")


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, members) of the wanted classes, from one text each.

    Texts whose class misses the bitmap are not shuffled; where it is full they all are, and the join decides.
    """
    wanted = materialize(wanted, "wanted")
    cells = docs.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(wanted)))
    names = ["fp1", "fp2", "text"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.unpackbits(cells.value).astype(bool)
        for batch in slices(batches):
            fps = np.array([fingerprint(s) for s in distinct_shingles(batch.column(1), n)], np.int64).reshape(-1, 2)
            keep = pa.array(np.flatnonzero(hit[(fps[:, 0].view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]))
            yield _batch([pa.array(fps[:, 0]).take(keep), pa.array(fps[:, 1]).take(keep), batch.column(1).take(keep)], names)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _batch([batch.column(0), long_lists(distinct_shingles(batch.column(1), n))], ["cid", "members"])

    texts = docs.mapInArrow(keyed, "fp1 long, fp2 long, text string").join(wanted, ["fp1", "fp2"]).groupBy("cid").agg(F.first("text").alias("text"))
    return materialize(texts.mapInArrow(members, "cid long, members array<long>"), "members")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows as (doc_id, n_shingles, fp1, fp2), one per document; classes as (fp1, fp2, cid, min_doc, component)."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows, counters = _scan(named, n)
    classes = _classes(named, counters, n, num, den)
    postings = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    # the earliest posting, by place and then by a hash of its set
    early = F.expr(f"pos <= n - ({2 * num} * n + {num + den - 1}) div {num + den}")
    rank = F.shiftleft(F.col("pos").cast("long"), 40).bitwiseOR(F.xxhash64("cid").bitwiseAND(F.lit((1 << 40) - 1)))
    # of two linked sets, the smaller has their first shared shingle at such a place
    shared = postings.groupBy("token").agg(F.count("*").alias("__n"), F.min(rank).alias("first"), F.max(early).alias("__early")).where("__n > 1 and __early").select("token", "first")
    met = postings.join(shared, "token").select("token", "cid", "n", "pos", (rank == F.col("first")).alias("pivot"))
    met = materialize(met.join(classes.select("cid", "bits1", "bits2"), "cid"), "postings")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = _near(pairs, classes, num, den)
        ends = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        sets = _sets_of(named, classes.join(ends, "cid", "left_semi").select("fp1", "fp2", "cid"), n)
        links = materialize(_verify(pairs, sets, num, den), "links")
        release(pairs, sets)
        return links

    filters = _may_link("a", "b", num, den)
    star = met.where("pivot").alias("a").join(met.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.cid") != F.col("b.cid")) & filters)
    tried = materialize(_pairs(star), "pairs")
    links = verified(tried)
    labels = materialize(connected_components(links), "labels")
    rest = materialize(_across(met, labels, num, den).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = verified(rest)
    labels = connected_components(links.union(more))
    named_classes = classes.select("fp1", "fp2", "cid", "min_doc").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    named_classes = materialize(named_classes.withColumn("component", F.coalesce("component", "cid")), "classes")
    release(classes, met, tried, rest, links, more)  # nothing below reads them
    return rows, named_classes


def _across(met: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """All candidate pairs of sets in different components.

    Posting lists are first taken by component, with bounds that hold for all of a component's sets, so
    that a list with one large and a few small components is not crossed with itself.
    """
    by = materialize(met.drop("pivot").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")), "postings")
    mixed = by.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    by = materialize(by.join(mixed, "token", "left_semi"), "postings")
    groups = by.groupBy("token", "component").agg(
        F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("left"), F.first("bits1").alias("bits1"), F.first("bits2").alias("bits2")
    )
    groups = materialize(groups, "groups")
    g, h = groups.alias("g"), groups.alias("h")
    need = F.expr(f"({num} * (g.low + h.low) + {num + den - 1}) div {num + den}")
    alone = (F.col("g.m") == 1) & (F.col("h.m") == 1)
    apart = F.bit_count(F.col("g.bits1").bitwiseXOR(F.col("h.bits1"))) + F.bit_count(F.col("g.bits2").bitwiseXOR(F.col("h.bits2")))
    fits = (num * F.col("g.low") <= den * F.col("h.high")) & (num * F.col("h.low") <= den * F.col("g.high")) & (F.least("g.left", "h.left") >= need)
    fits &= ~alone | (apart <= F.col("g.low") + F.col("h.low") - 2 * need)
    chosen = g.join(h, (F.col("g.token") == F.col("h.token")) & (F.col("g.component") < F.col("h.component")) & fits).select("g.token", F.col("g.component").alias("c"), F.col("h.component").alias("d"))
    one = chosen.join(by.select(F.col("token").alias("t"), F.col("component").alias("k"), F.struct("cid", "n", "pos", "bits1", "bits2").alias("a")), (F.col("token") == F.col("t")) & (F.col("c") == F.col("k"))).select("token", "d", "a")
    two = by.select(F.col("token").alias("t"), F.col("component").alias("k"), F.struct("cid", "n", "pos", "bits1", "bits2").alias("b"))
    return _pairs(one.join(two, (F.col("token") == F.col("t")) & (F.col("d") == F.col("k")) & _may_link("a", "b", num, den)))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document; component_id is the smallest doc_id reachable by links."""
    rows, classes = similar(docs, doc_id, text, n, num, den)
    ids = classes.groupBy("component").agg(F.min("min_doc").alias("component_id"))
    named = classes.join(ids, "component").select("fp1", "fp2", "component_id")
    # documents without words share one empty set and link with nothing, so they need no join
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("n_shingles > 0").join(named, ["fp1", "fp2"]).select("doc_id", "n_shingles", "component_id").union(alone)


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; its columns as they were.

    Documents without words all stay, but for repeats of (doc_id, set), of which one stays. Of rows that share doc_id and set
    the one whose text has the lowest hash stays.
    """
    _, classes = similar(docs, doc_id, text, n, num, den)
    order = F.struct(F.col("min_doc").isNull(), "min_doc", "fp1", "fp2")
    keepers = classes.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.fp1").alias("f1"), F.col("k.fp2").alias("f2"), F.col("k.min_doc").alias("id"))
    keepers = materialize(keepers, "keepers")
    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(s) for s in distinct_shingles(batch.column(2), n)]
            yield _batch([batch.column(0), batch.column(1), pa.array([a for a, _ in fps], pa.int64()), pa.array([b for _, b in fps], pa.int64())], ["row", "id", "fp1", "fp2"])

    row = kind.schema["row"].dataType.simpleString()
    found = kind.mapInArrow(keyed, f"row {row}, id long, fp1 long, fp2 long")
    # rows that share id and set may differ in their text: the one whose text hashes lowest stays, in any run
    one = found.groupBy("id", "fp1", "fp2").agg(F.min_by("row", F.xxhash64(F.col("row").getField(text))).alias("row"))
    kept = one.join(keepers.withColumn("hit", F.lit(True)).withColumnRenamed("id", "kid"), (F.col("fp1") == F.col("f1")) & (F.col("fp2") == F.col("f2")) & F.col("id").eqNullSafe(F.col("kid")), "left")
    return kept.where("hit or (fp1 = 0 and fp2 = 0)").select("row.*")
