"""Token counts over a stream of files: the batch plan on a streaming source (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import annotate as A


def windowed_lemmas(stream: DataFrame, at: str = "ts", text: str = "text", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Non-stop lemma counts by event-time window; state is dropped once the watermark has passed."""
    words = stream.withWatermark(at, late).select(at, F.explode(A.words(F.col(text))).alias("word"))
    lemmas = words.select(at, A.lemma(F.col("word")).alias("lemma")).where(~A.is_stop(F.col("lemma")))
    return lemmas.groupBy(F.window(at, window), "lemma").agg(F.count("*").alias("freq"))
