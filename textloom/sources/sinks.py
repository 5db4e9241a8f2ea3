"""Writers: whole tables as Parquet, JSON and CSV exports, a rename plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import annotate as A

TABLES = ("modules", "tokens", "functions", "classes", "syntagmas", "function_clones", "file_similarity", "identifier_families", "architecture_patterns", "lineage_verdicts")


def save(df: DataFrame, root: str, table: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replaces the table as a whole, so that a repeated analysis never appends."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table}")
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/{table}")


def export(frames: dict[str, DataFrame], root: str, single_file: bool = False) -> None:
    for name, df in frames.items():
        (df.coalesce(1) if single_file else df).write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def rename_plan(files: DataFrame, chars: int = 2048) -> DataFrame:
    """(file_path, extension, target, conflict): what files would be called by their content; nothing is renamed."""
    ext = A.content_language(F.substring("text", 1, chars))
    target = F.concat(F.regexp_replace("file_path", r"\.[^./]*$", ""), ext)
    plan = files.select("file_path", ext.alias("extension"), F.when(ext == ".unknown", F.col("file_path")).otherwise(target).alias("target"))
    known = files.select(F.col("file_path").alias("__p")).distinct()
    met = plan.join(known, plan["target"] == known["__p"], "left")
    return met.select("file_path", "extension", "target", (F.col("__p").isNotNull() & (F.col("target") != F.col("file_path"))).alias("conflict"))
