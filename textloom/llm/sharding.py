"""Rendezvous hashing of stable record keys over weighted shards (DataFrame functions only).

A record goes to the shard with the highest score, and a shard's score for a record depends on
these two alone; so a further shard takes records only into itself and a removed one gives up only
its own. Score: weight / -ln(u) with u in (0, 1) from a hash of the key and the shard's name.

Defined results: a null key is one key of its own; rows that repeat a key share its shard; null text
has no bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.words import text_crc32, text_or_empty
from textloom.operators.numbering import number_rows

SHARDS = 16
SEED = "shard-1"


def uniform(key: Column, shard: int, seed: str = SEED) -> Column:
    """(0, 1) from 48 bits of an MD5 over seed, shard and key; a null key differs from any string."""
    text = F.concat(F.lit(f"{seed}:{shard}:"), F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def _best(scores: Column, n: int) -> Column:
    first = F.slice(scores, 1, n)
    return (F.array_position(first, F.array_max(first)) - 1).cast("int")


def rendezvous(df: DataFrame, key: str, shards: int | list[float] = SHARDS, grown: bool = False, seed: str = SEED) -> DataFrame:
    """Adds shard (and grown_shard, with one more shard of weight 1) to ``df``. ``shards``: their number, or their weights."""
    weights = [1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]
    n = len(weights)
    if len({*weights}) == 1:
        scores = [uniform(F.col(key), i, seed) for i in range(n + grown)]
    else:
        scores = [F.lit(w) / -F.log(uniform(F.col(key), i, seed)) for i, w in enumerate([*weights, 1.0][: n + grown])]
    out = df.withColumn("__scores", F.array(*scores))
    made = {"shard": _best(F.col("__scores"), n)} | ({"grown_shard": _best(F.col("__scores"), n + 1)} if grown else {})
    return out.select(*df.columns, *[c.alias(k) for k, c in made.items()])


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``key``.

    Slots follow doc_id within a shard; they are numbered by sorted ranges, never by one task per shard.
    """
    t = text_or_empty(text)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t).cast("long") + 1).alias("size"), text_crc32(t).alias("text_crc32"))
    dealt = rendezvous(narrow, "doc_id", shards, grown=True)
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = number_rows(dealt, order, ["shard"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
