"""Stylometry, lexical diversity and change over time."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import annotate as A
from textloom.operators import corpus_queries as Q
from textloom.operators import measures as M
from textloom.scratch import materialize
from textloom.sources import corpus as C


def frequent_by_author(files: DataFrame, k: int = 50) -> DataFrame:
    counts = M.lemma_counts(files, "author").where("not is_stop").drop("is_stop")
    order = Window.partitionBy("author").orderBy(F.desc("freq"), "lemma")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_mean(column: str) -> Column:
    """Summed as decimals of 18 places, so that the mean of doubles does not depend on the rows' order."""
    return F.avg(F.col(column).cast("decimal(38,18)")).cast("double")


def author_profile(files: DataFrame) -> DataFrame:
    metrics = Q.module_metrics(files).join(files.select("file_path", "author"), "file_path")
    style = lambda s: F.count_if(F.col("identifier_style") == s)
    return metrics.groupBy("author").agg(
        F.count("*").alias("files"), F.sum("token_count").alias("tokens"), exact_mean("avg_identifier_length").alias("mean_identifier_length"), exact_mean("type_token_ratio").alias("mean_type_token_ratio"),
        style("snake_case").alias("snake_files"), style("PascalCase").alias("pascal_files"), style("camelCase").alias("camel_files"),
    )


def delta_distances(files: DataFrame, n: int = 50, burrows: bool = False) -> DataFrame:
    """Mean absolute difference of the authors' z-scored frequencies of the n most frequent lemmas, for every two authors.

    Scores are standardised within an author's vector, or with ``burrows`` across authors.
    """
    forms = materialize(M.lemma_counts(files, "author"), "lemmas")  # read three times below
    sizes = forms.groupBy("author").agg(F.sum("freq").alias("size"))
    counts = forms.where("not is_stop").drop("is_stop")
    top = counts.groupBy("lemma").agg(F.sum("freq").alias("all")).orderBy(F.desc("all"), "lemma").limit(n).select("lemma")
    grid = sizes.join(F.broadcast(top)).join(counts, ["author", "lemma"], "left")
    rel = grid.select("author", "lemma", (F.coalesce("freq", F.lit(0)) / F.col("size")).alias("f"))
    w = Window.partitionBy("lemma" if burrows else "author")
    std = F.stddev_pop("f").over(w)
    z = rel.select("author", "lemma", F.when(std > 0, (F.col("f") - F.avg("f").over(w)) / std).otherwise(0.0).alias("z"))
    pair = z.alias("x").join(z.alias("y"), (F.col("x.lemma") == F.col("y.lemma")) & (F.col("x.author") < F.col("y.author")))
    return pair.groupBy(F.col("x.author").alias("author_a"), F.col("y.author").alias("author_b")).agg(F.avg(F.abs(F.col("x.z") - F.col("y.z"))).alias("delta"))


def lexical_complexity(files: DataFrame) -> DataFrame:
    def shuffled(files: DataFrame) -> DataFrame:
        counts = Q.form_counts(files, "file_path").where("not is_stop").groupBy("file_path", "lemma").agg(F.sum("freq").alias("freq"))
        return counts.groupBy("file_path").agg(F.sum("freq").alias("total"), F.count("*").alias("types"))

    alone, repeated = M.split_repeated(files)
    found = M.file_counts(alone).where("content_tokens > 0").select("file_path", F.col("content_tokens").alias("total"), F.col("unique_tokens").alias("types"))
    found = found if repeated is None else found.union(shuffled(repeated))
    return found.withColumn("ttr", F.col("types") / F.col("total"))


def segment_count(lemmas, level: float, band: float) -> int:
    """How many segments a scan closes: one whenever the running type/token ratio comes within ``band`` of ``level``."""
    closed, seen, length = 0, set(), 0
    for word in lemmas:
        length += 1
        seen.add(word)
        if abs(len(seen) / length - level) < band:
            closed, seen, length = closed + 1, set(), 0
    return closed


def mtld_of(lemmas, level: float = 0.72, band: float = 0.05) -> float:
    """Tokens per segment, the segments of both reading directions pooled; the token count where none closes."""
    n = segment_count(lemmas, level, band) + segment_count(lemmas[::-1], level, band)
    return float(len(lemmas) / n if n else len(lemmas))


def mtld(files: DataFrame, level: float = 0.72) -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def scan(lemmas: pd.Series) -> pd.Series:
        return lemmas.map(lambda x: mtld_of(list(x), level))

    return C.file_words(files).select("file_path", C.content_lemmas(F.col("words")).alias("l")).select("file_path", F.size("l").cast("long").alias("total"), scan("l").alias("mtld"))


@F.pandas_udf(T.DoubleType())
def _packed_share(text: pd.Series) -> pd.Series:
    return text.map(lambda x: len(zlib.compress(x.encode("utf-8", "replace"), 9)) / len(x.encode("utf-8", "replace")) if x else 0.0)


def kolmogorov_proxy(functions: DataFrame) -> DataFrame:
    """Compressed over plain size of each file's function bodies, joined by a backslash and an n."""
    bodies = functions.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", "fn_id", "source_code"))).alias("b"))
    return bodies.select("file_path", F.array_join(F.transform("b", lambda b: b["source_code"]), "\\n").alias("t")).select("file_path", _packed_share("t").alias("kolmogorov_proxy"))


def information_profile(files: DataFrame) -> DataFrame:
    """Entropy, its maximum, density and packed share of each file."""
    packed = lambda files: files.select("file_path", _packed_share(F.coalesce("text", F.lit(""))).alias("kolmogorov_proxy"))

    def shuffled(files: DataFrame) -> DataFrame:
        tags = Q.tag_counts(files, "file_path")
        top = tags.groupBy("file_path").agg(F.log2(F.count("*").cast("double")).alias("max_entropy"))
        return Q.entropy(tags, "file_path").join(top, "file_path").join(Q.semantic_density(files).select("file_path", "semantic_density"), "file_path", "left").join(packed(files), "file_path").fillna(0.0, ["semantic_density"])

    alone, repeated = M.split_repeated(files)
    density = F.when(F.col("content_tokens") > 0, F.col("unique_tokens") / F.greatest("last_line", F.lit(1))).otherwise(0.0)
    found = M.file_counts(alone).select("file_path", M.tag_entropy().alias("entropy"), F.log2(M.n_tags().cast("double")).alias("max_entropy"), density.alias("semantic_density")).join(packed(alone), "file_path")
    return found if repeated is None else found.unionByName(shuffled(repeated))


def vocabulary_growth(dated: DataFrame, bucket: str = "day") -> DataFrame:
    """(bucket, new_words, vocabulary) from rows (at, text): words by the bucket they are first seen in.

    The running total is over one row per bucket.
    """
    words = dated.select(F.date_trunc(bucket, "at").alias("bucket"), F.explode(A.words(F.col("text"))).alias("word"))
    first = words.groupBy("word").agg(F.min("bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("new_words"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return first.select("bucket", "new_words", F.sum("new_words").over(w).alias("vocabulary"))


def sampled_commits(commits: DataFrame, step: int = 10) -> DataFrame:
    """Every ``step``-th commit of each author, newest first."""
    w = Window.partitionBy("author").orderBy(F.desc("committed_at"), "sha")
    return commits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") % step == 1).drop("__n")


def abstraction_trend(classes: DataFrame) -> DataFrame:
    """Share of entity and service classes by language, from (name, language)."""
    kind = A.domain(F.col("name"))
    marked = classes.select("language", kind.alias("domain"))
    return marked.groupBy("language").agg(F.count_if(F.col("domain").isin("entity", "service")).alias("abstract_classes"), F.count("*").alias("classes")).withColumn("share", F.col("abstract_classes") / F.col("classes"))
