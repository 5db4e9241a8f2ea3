"""Host-level quality rules (DataFrame functions only).

1. Every document gets its own measures in one pass over its whole text, and from them one flag per rule of ``RULES``.
2. Each rule's failures are counted per host (partial aggregation before the shuffle, so a host with a third of
   all rows costs one row per task), and each host's failure rate of each rule is shrunk towards that rule's own empirical
   beta prior, fitted to all hosts by the method of moments. A host with few documents so stays near the corpus's
   rate, whatever its few documents are like.
3. A host is rejected when the shrunk rate of any rule is above the rule's limit: half of its documents, however high the prior's mean.
   Host verdicts are joined back to the documents' narrow measures. The join carries no hint: adaptive
   execution broadcasts the host side while it is small and otherwise splits the hot host's rows.

Five-word windows are compared by a 64-bit hash first; only texts in which a hash repeats compare the words themselves.

Defined results: null text has no words and fails; null host belongs to no host, so only the
document's own rules decide; repeated rows are judged and counted one by one; an empty table gives an
empty result; columns besides those named are ignored by ``measures`` and passed through by ``keep_documents``, whatever
their names. A very long text is worked on in one row: its words as an array and one hash per window are held at once, and
the windows' words only where a hash repeats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.words import SPACES, text_or_empty, word_array
from textloom.scratch import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: (rule, does a document fail it, the share of failing documents above which a host goes)
RULES = (
    ("few_words", "n_words < 10", 0.5),
    ("repeats", "100 * n_repeat_words > 20 * n_words", 0.5),
    ("symbols", "10 * n_symbols > n_words", 0.5),
    ("lines", "10 * n_dup_lines > 3 * n_lines", 0.5),
)
#: A document that fails one of these goes, whatever its host.
BASE = ("few_words", "repeats")
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def with_base_measures(df: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """``carry`` columns plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    Steps are separate projections so that no array is built twice. Windows are built as strings, and sorted, only in
    documents in which the hash of one repeats.
    """
    t, w = F.col("__t"), F.col("__w")
    keep = [F.col(c) for c in carry]
    lines = F.array_remove(F.array_distinct(F.split(F.regexp_replace(t, r"(?md)^[ \t\x0B\f\r]+$", ""), "\n")), "")
    step = df.select(*keep, text_or_empty(text).alias("__t")).select(
        *keep,
        word_array(t).alias("__w"),
        F.length(F.translate(t, " " + SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long").alias("n_lines"),
        F.size(lines).alias("__d"),
    )
    step = step.select("*", (F.col("n_lines") - F.col("__d")).cast("long").alias("n_dup_lines"))
    keep += [F.col(c) for c in ("word_chars", "n_symbols", "n_lines", "n_dup_lines")]
    starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    long = F.size(w) >= WINDOW
    hashes = F.when(long, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(*keep, F.size(w).cast("long").alias("n_words"), w, hashes.alias("__h"))
    keep.append(F.col("n_words"))
    tagged = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("g"), i.alias("i"))))
    none = F.array().cast("array<struct<g:string,i:int>>")
    step = step.select(*keep, F.when(F.size(F.array_distinct("__h")) < F.size("__h"), tagged).otherwise(none).alias("__s"))
    s = F.col("__s")
    twice = F.filter(s, lambda x, j: (x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"]))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    step = step.select(*keep, places.alias("__p"))
    n = F.size("__p")
    gaps = F.zip_with(F.slice("__p", 1, F.greatest(n - 1, F.lit(0))), F.slice("__p", 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.least(y - x, F.lit(WINDOW)))
    covered = F.when(n == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda acc, g: acc + g))
    step = step.select(*keep, covered.alias("n_repeat_words"))
    return step.withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return reduce(Column.__or__, [F.expr(test) for name, test, _ in RULES if name in BASE])


def host_rates(scored: DataFrame, host: str = "host", rules: tuple = RULES) -> DataFrame:
    """(host, n, and for each rule its failures and its rate as <rule>_failures and <rule>_rate).

    A rate is (failures + alpha) / (n + alpha + beta); a rule's alpha and beta come from the mean and variance of the hosts'
    raw rates, their sum is held between 2 (what a uniform prior weighs) and a million, and is a million where all hosts have the same rate.
    """
    counts = [F.count_if(F.expr(test)).alias(f"{name}_failures") for name, test, _ in rules]
    hosts = scored.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *counts)
    raw = {name: F.col(f"{name}_failures") / F.col("n") for name, *_ in rules}
    prior = hosts.agg(*[F.avg(r).alias(f"{name}__m") for name, r in raw.items()], *[F.var_pop(r).alias(f"{name}__v") for name, r in raw.items()])

    def rate(name: str) -> Column:
        m, v = F.col(f"{name}__m"), F.col(f"{name}__v")
        strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(2.0)), F.lit(1e6))).otherwise(F.lit(1e6))
        return (F.col(f"{name}_failures") + m * strength) / (F.col("n") + strength)

    # one row on the other side
    return hosts.join(F.broadcast(prior)).select("host", "n", *[c for name, *_ in rules for c in (f"{name}_failures", rate(name).alias(f"{name}_rate"))])


def host_verdicts(scored: DataFrame, host: str = "host", rules: tuple = RULES) -> DataFrame:
    """(host, host_rejected, the rates), one row per host."""
    over = reduce(Column.__or__, [F.col(f"{name}_rate") > limit for name, _, limit in rules])
    rates = host_rates(scored, host, rules)
    return rates.select("host", over.alias("host_rejected"), *[f"{name}_rate" for name, *_ in rules])


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", rules: tuple = RULES) -> DataFrame:
    """(doc_id, measures, base_failed, kept, host, host_rejected, each rule's shrunk rate at the host), one row per row of ``docs``."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    scored = materialize(with_base_measures(named, "text", ["doc_id", "host"]), "quality")
    verdicts = materialize(host_verdicts(scored, "host", rules), "hosts")
    kept = ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    return scored.join(verdicts, "host", "left").select("doc_id", *_MEASURES, "base_failed", kept.alias("kept"), "host", "host_rejected", *[f"{name}_rate" for name, *_ in rules])


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source", rules: tuple = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were; texts are not shuffled while host verdicts are small.

    Measures are taken once and written with the rows that pass the document's own rules.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.col(host).alias("host"))
    scored = with_base_measures(packed, "text", ["row", "host"]).select(F.when(~F.col("base_failed"), F.col("row")).alias("row"), "host", "base_failed", *_MEASURES)
    scored = materialize(scored, "quality")
    rejected = materialize(host_verdicts(scored, "host", rules).where("host_rejected").select("host"), "hosts")
    return scored.where("not base_failed").join(rejected, "host", "left_anti").select("row.*")
