import duckdb
import pytest

import __spark_entry__ as entry
from textloom.operators.components import connected_components
from textloom.operators.numbering import number_rows

SF = "/root/testdata/sf0.001"
TABLES = "nation part events documents pages conversations".split()


def rounded(rows):
    return sorted(str([round(x, 6) + 0.0 if isinstance(x, float) else str(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", ["wordlist_lemma", "vocab_profile", "ngrams_2", "collocations", "keyness_vs_rest", "conditional_entropy", "semantic_density", "role_sequences", "clone_candidates", "levenshtein_names", "content_language", "author_profile", "concordance_tagged", "jaccard_files", "source_functions", "source_classes", "source_modules", "source_lines", "source_authors", "syntagmas", "corpus_stats", "directory_groups"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert rounded(df.select(*columns).collect()) == rounded(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (9, 8), (8, 10), (10, 11)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 8, 9: 8, 10: 8, 11: 8}
    assert connected_components(df.limit(0)).count() == 0


def test_numbering(spark):
    df = spark.createDataFrame([(i % 3, 5) for i in range(100)] + [(9, None)], "g int, v int")
    rows = number_rows(df, ["v"], ["g"], "n", parts=5).collect()
    for g in (0, 1, 2, 9):
        mine = sorted(r.n for r in rows if r.g == g)
        assert mine == list(range(len(mine)))
    assert number_rows(df.limit(0), ["v"], ["g"]).count() == 0


def test_views(spark):
    from textloom.sources import corpus as C

    assert {"documents", "nation", "files", "lines", "tokens"} <= set(C.register_views(spark, SF))
    by_sql = spark.sql("SELECT lemma, count(*) AS freq FROM tokens WHERE NOT is_stop GROUP BY lemma")
    assert rounded(by_sql.collect()) == rounded(entry.queries()["wordlist_lemma"](spark, SF).select("lemma", "freq").collect())


def test_cooccurrence_without_broadcast(spark, monkeypatch):
    from textloom.operators import graph as G
    from textloom.sources import corpus as C

    files = C.document_files(spark, SF)
    want = rounded(G.cooccurrence(files).collect())
    monkeypatch.setattr(C, "BROADCAST_FORMS", 0)
    assert rounded(G.cooccurrence(files).collect()) == want


def test_reports_of_hard_files(spark):
    from textloom.operators import corpus_queries as Q

    schema = "file_path string, language string, author string, text string"
    empty = spark.createDataFrame([], schema)
    assert [tuple(r) for r in Q.corpus_stats(empty).collect()] == [(0, 0, 0, 0)]
    assert Q.directory_groups(empty).count() == Q.syntagmas(empty).count() == 0
    rows = [("a/x.en", "en", "a", "get_user Name Name\nnull from get_user"), ("a/y.fr", None, "a", None), ("z", "fr", "a", "..."), ("b/c/z", "en", "b", "Name")]
    files = spark.createDataFrame(rows, schema)
    assert [tuple(r)[:3] for r in Q.syntagmas(files).collect()] == [("a/x.en", 0, "get_user Name Name null")]
    assert [tuple(r) for r in Q.corpus_stats(files).select("files", "tokens", "languages").collect()] == [(2, 7, 1)]
    assert {tuple(r) for r in Q.directory_groups(files).collect()} == {("", 1, "z"), ("a", 2, "x.en y.fr"), ("b/c", 1, "z")}
