"""Mixing sources to target weights (DataFrame functions only).

Tokens are summed per source, targets follow from the weights with a cap on repetition, and every
document is taken floor(rate) times plus one more when a hash of its id and the seed, read as a
number in [0, 1), is below the rate's fraction.

Defined results: null text has size 0; null source is a source of its own, last in order; a null
doc_id hashes as the empty string; rows that repeat a doc_id share its draw; a source without words
gets target 0 and none of its documents twice; an empty table gives an empty result; other columns
are passed through by ``repeat_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.words import text_or_empty, word_count
from textloom.operators.numbering import number_rows
from textloom.scratch import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Weights repeat over the sources in code point order, null last; ``share`` times all tokens are
    shared out by weight, targets stop at ``cap`` times the source and the excess is shared again by
    weight among the others until none is above. Every round is one aggregate over the sources and
    can only add capped sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = number_rows(totals, [F.col("source").isNull(), F.col("source")], [], "__i")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    table = materialize(numbered.select("source", "source_size", weight.alias("weight")), "mix")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * cap
    rest, open_weight, level = share * total, None, 0.0
    while True:
        capped = F.lit(False) if open_weight is None else F.col("weight") * level >= limit
        row = table.agg(F.sum(F.when(capped, limit)).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        rest, now = share * total - (row.full or 0.0), row.open or 0.0
        if now == open_weight or now == 0:
            break
        open_weight, level = now, rest / now
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(level))
    return table.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """[0, 1) from the first 52 bits of an MD5, so that any engine can repeat it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    return (F.floor(rate) + F.when(draw(doc_id, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source), one row per row of ``docs``."""
    sizes = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text_or_empty(text)).alias("size")), "sizes")
    targets = source_targets(sizes)
    joined = sizes.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    n = copies(rate, F.col("doc_id"))
    return joined.select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"), "source")


def repeat_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with its columns as they were."""
    sizes = docs.select(F.col(source).alias("source"), word_count(text_or_empty(text)).alias("size"))
    rates = materialize(source_targets(sizes).select(F.col("source").alias("__source"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate")), "mix")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("__id"), F.col(source).alias("__s"))
    joined = packed.join(rates, F.col("__s").eqNullSafe(F.col("__source")))
    return joined.withColumn("__n", copies(F.col("__rate"), F.col("__id"))).where("__n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("row.*")
