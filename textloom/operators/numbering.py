"""Gapless numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.scratch import materialize


def number_rows(df: DataFrame, order: list, groups: list[str], name: str = "number", parts: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each combination of ``groups``, in the given order.

    Range-partitions on (groups, order, a row number of the stored table), which splits even a key
    that holds most rows, sorts each part and writes it; a row's number is its place in its file
    plus the sizes of its group's earlier files. Only (file, group) counts are ever gathered:
    ``parts`` times the groups that share a file. Rows equal in every ordering column are
    interchangeable. An empty table stays empty.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(df, "num").select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    keys = [*(F.col(g) for g in groups), *(F.col(c) if isinstance(c, str) else c for c in order), F.col("__file"), F.col("__row")]
    dealt = stored.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__file", "__row")
    placed = materialize(dealt.withColumn("__part", F.spark_partition_id()), "num")
    placed = placed.withColumn("__row", F.col("_metadata.row_index"))
    by = [*groups, "__part"]
    counts = materialize(placed.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__row").alias("__first")), "num")
    w = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, (F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__first")).alias("__offset"))
    same = [placed[c].eqNullSafe(offsets[c]) for c in by]
    return placed.join(offsets, same).select(*[placed[c] for c in df.columns], (F.col("__offset") + F.col("__row")).cast("long").alias(name))
