import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus_queries as Q
from textloom.operators import measures as M
from textloom.operators import style as Y
from textloom.sources import corpus as C

WORDS = ["get_user", "userName", "UserName", "A", "items", "self", "running", "Élan", "x_y", "_a", "in", "inger", "import", "class", "handler_callback", "3abc", "aÉ", "data"]
SCHEMA = "file_path string, language string, author string, text string"


def files_of(spark, repeated):
    rng = random.Random(3)
    texts = ["".join(w + rng.choice([" ", " ", "\n", "\n\n", "; "]) for w in rng.choices(WORDS, k=rng.randint(0, 40))) for _ in range(30)] + [None, "", "\n\nself", "...", "class_ a\nb\nc\nd\ne\nf g\r\nh"]
    rows = [(f"a/{i}", rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), t) for i, t in enumerate(texts)]
    if repeated:
        rows += [("a/3", "en", "a", "userName again\nmore"), ("a/3", None, "b", "get_user"), (None, "en", "a", "no path"), (None, "en", "a", "at all")]
    return spark.createDataFrame(rows, SCHEMA)


def rounded(df):
    return sorted(str([round(x, 9) + 0.0 if isinstance(x, float) else x for x in r]) for r in df.collect())


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("query", [Q.semantic_density, Q.module_metrics, Q.file_entropy, Q.entropy_by_language, Y.lexical_complexity, Y.information_profile])
def test_counts_in_the_row_are_those_of_a_shuffle(spark, monkeypatch, query, repeated):
    files = files_of(spark, repeated)
    got = query(files)
    if not repeated:  # tokens used to be shuffled by file
        assert "explode" not in got._jdf.queryExecution().executedPlan().toString().lower()
    got, kinds = rounded(got), got.dtypes
    monkeypatch.setattr(M, "split_repeated", lambda files: (files.limit(0), files))
    want = query(files)
    assert got == rounded(want) and kinds == want.dtypes


def test_lemma_counts(spark, monkeypatch):
    files = files_of(spark, False)
    want = rounded(Q.form_counts(files, "author").groupBy("author", "lemma", "is_stop").agg(F.sum("freq").alias("freq")))
    assert rounded(M.lemma_counts(files, "author")) == want
    assert rounded(M.lemma_counts(files.limit(0), "author")) == []


def test_scopes_and_columns(spark):
    files = files_of(spark, True)
    want = C.token_columns(files).groupBy("language", "scope").agg(F.count("*").alias("n"), F.sum("column").alias("column_sum"))
    got = Q.scope_tokens(files)
    assert rounded(got) == rounded(want) and got.dtypes == want.dtypes
    assert "explode" not in got._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize("held", [5, 10**6])
@pytest.mark.parametrize("n,pattern", [(1, None), (2, None), (2, ["VERB", "NOUN"]), (3, None), (5, None)])
def test_frequent_ngrams(spark, monkeypatch, n, pattern, held):
    files = files_of(spark, True)
    every = Q.ngrams(files, n, 2, pattern, k=None)
    for k in (1, 4, 1000):
        want = [tuple(r) for r in every.orderBy(F.desc("freq"), "ngram").limit(k).collect()]
        got = M.frequent_ngrams(files, n, 2, pattern, k, held=held)
        assert [tuple(r) for r in got.orderBy(F.desc("freq"), "ngram").limit(k).collect()] == want
    assert Q.ngrams(files.limit(0), n).count() == 0


def test_only_frequent_ngrams_are_shuffled(spark):
    rows = [(str(i), "en", "a", " ".join(f"w{chr(97 + j)}{i}" for j in range(26)) + "\nsame three words") for i in range(40)]
    files = spark.createDataFrame(rows, SCHEMA)
    got = M.frequent_ngrams(files, 3, 2, None, 1)
    assert [tuple(r) for r in got.collect()] == [("same three words", 40)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_mean_by_author_does_not_depend_on_order(spark):
    rng = random.Random(4)
    rows = [(f"a/{i}", "en", "a", " ".join(rng.choices(["ab", "abcd", "abcdefg", "x", "yzzz"], k=rng.randint(1, 40)))) for i in range(400)]
    exact = []
    for order in (rows, rows[::-1]):
        files = spark.createDataFrame(order, SCHEMA)
        ratios = [(r.unique_tokens, r.token_count) for r in Q.module_metrics(files).collect()]
        want = float(sum(Fraction(a / b) for a, b in ratios) / len(ratios))
        exact.append(Y.author_profile(files).first().mean_type_token_ratio == want)
    assert exact == [True, True]
