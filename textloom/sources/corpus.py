"""Corpora as DataFrames: files, lines, tokens, and adapters for the warehouse tables.

files  (file_path, language, author, text)
tokens (file_path, language, author, line, pos_in_line, text, lemma, pos, is_stop)
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import annotate as A
from textloom.functions.lexicon import EXTENSION_LANGUAGE


def read_files(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), ignore_substring: bool = False, max_chars: int | None = None) -> DataFrame:
    """Files of known extensions under ``root``, decoded as UTF-8 with replacement.

    ``ignore`` drops paths with such a segment (or, on request, substring). ``max_chars`` keeps a prefix.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    raw = raw.where(ext.isin(*EXTENSION_LANGUAGE))
    for word in ignore:
        raw = raw.where(~F.col("path").contains(word) if ignore_substring else ~F.array_contains(F.split("path", "/"), word))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    return raw.select(F.col("path").alias("file_path"), A.language_of(F.col("path")).alias("language"), F.lit(None).cast("string").alias("author"), text.alias("text"))


#: Annotated forms, of some tens of bytes each, are broadcast up to this number.
BROADCAST_FORMS = 500_000
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Temporary views for SQL: the tables of ``sf_dir`` that exist there, and ``files``, ``lines`` and ``tokens`` over its documents."""
    made = []
    for name in TABLES:
        try:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        made.append(name)
    if "documents" in made:
        files = document_files(spark, sf_dir)
        for name, frame in {"files": files, "lines": lines(files), "tokens": tokens(files)}.items():
            frame.createOrReplaceTempView(name)
            made.append(name)
    return made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    path = F.concat(known("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), known("lang"))
    return d.select(path.alias("file_path"), F.col("lang").alias("language"), F.col("source").alias("author"), "text")


def turn_id(conv_id: Column, turn: Column) -> Column:
    """A number of its own for every (conv_id, turn), as decimal(38,0): conv_id * 1000 + turn below 1,000 turns.

    Later turns lie beyond all of these, 2^64 to a conversation. Conversations of 2^61 and more with such
    turns are past the type, which is an error, never an id given twice.
    """
    wide = lambda c: c.cast("decimal(20,0)")
    late = F.lit(str(5 * 10**37)).cast("decimal(38,0)") + (wide(conv_id) * F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(38,0)") + wide(turn)
    return F.when(turn.between(0, 999), (wide(conv_id) * 1000 + wide(turn)).cast("decimal(38,0)")).otherwise(late.cast("decimal(38,0)"))


def conversation_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as function-like units."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    source = F.col("text")
    return c.select(
        turn_id(F.col("conv_id"), F.col("turn")).alias("fn_id"), F.col("role").alias("name"), name.alias("qualified_name"), F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("start_line"),
        F.size(A.words(source)).alias("token_count"), A.complexity(source).alias("cyclomatic_complexity"), A.calls(source).alias("calls"), source.alias("source_code"),
    )


def lines(files: DataFrame) -> DataFrame:
    return files.select("file_path", "language", "author", F.posexplode(F.split("text", "\n")).alias("line", "line_text")).withColumn("line", F.col("line") + 1)


def raw_tokens(files: DataFrame) -> DataFrame:
    """Tokens without annotation: what only counts forms should annotate the distinct forms afterwards."""
    at = lines(files)
    return at.select("file_path", "language", "author", "line", F.posexplode(A.words(F.col("line_text"))).alias("pos_in_line", "text"))


def annotate_forms(forms: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    found = forms.withColumn("lemma", A.lemma(t)).withColumn("pos", A.tag(t))
    return found.withColumn("is_stop", A.is_stop(F.col("lemma")))


def tokens(files: DataFrame) -> DataFrame:
    return annotate_forms(raw_tokens(files))


def token_columns(files: DataFrame) -> DataFrame:
    """Tokens with their place in the line as a substring and the scope of the five lines up to theirs."""
    split = F.split("text", "\n")
    framed = F.transform(split, lambda line, i: F.struct(line.alias("line_text"), A.scope(F.array_join(F.slice(split, F.greatest(i - 3, F.lit(1)), F.least(i + 1, F.lit(5))), "\n")).alias("scope")))
    at = files.select("file_path", "language", "author", F.posexplode(framed).alias("line", "l"))
    found = at.select("file_path", "language", "author", (F.col("line") + 1).alias("line"), "l.*").select("*", F.posexplode(A.words(F.col("line_text"))).alias("pos_in_line", "text"))
    return annotate_forms(found.withColumn("column", F.expr("instr(line_text, text) - 1"))).drop("line_text")


def file_words(files: DataFrame) -> DataFrame:
    """One row per file with its tokens in order; the pattern never crosses a line."""
    return files.select("file_path", "language", "author", A.words(F.col("text")).alias("words"))


def content_lemmas(words: Column) -> Column:
    """Non-stop lemmas of an array of tokens, in order."""
    return F.filter(F.transform(words, A.lemma), lambda x: ~A.is_stop(x))
