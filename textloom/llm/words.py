"""Words as ``[^\\x20\\x09-\\x0D]+``: runs without ASCII white space, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\f\r"


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_array(text: Column) -> Column:
    """One-character split, which the JVM does without a regular expression engine."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def text_crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))
