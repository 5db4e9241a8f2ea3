import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.functions.lexicon import STOP_WORDS
from textloom.operators import between as B
from textloom.operators import cells as K
from textloom.operators import graph as G

SF = "/root/testdata/sf0.001"
TEXTS = ["zorp blick zorp mund", "mund tarn", "solo", "krak"]


def fixture(spark, folder):
    rows = [(i, text, "en", "web", len(text)) for i, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def brute_edges():
    found = Counter()
    for text in TEXTS:
        words = [w for w in text.split() if w not in STOP_WORDS]
        found.update(tuple(sorted((x, y))) for i, x in enumerate(words) for y in words[i + 1 : i + 6] if x != y)
    return found


def test_networks_hold_rare_pairs(spark, tmp_path):
    sf, queries, edges = fixture(spark, tmp_path), entry.queries(), brute_edges()
    assert {(r.a, r.b): r.weight for r in queries["cooccurrence_edges"](spark, sf).collect()} == edges
    near = {n: {x for e in edges if n in e for x in e if x != n} for n in {x for e in edges for x in e}}
    assert {r.node: r.degree for r in queries["degree_centrality"](spark, sf).collect()} == {n: len(x) for n, x in near.items()}
    triangles = {n: sum(y in near[x] for x in near[n] for y in near[n]) // 2 for n in near}
    assert {r.node: r.triangles for r in queries["clustering"](spark, sf).collect()} == triangles
    assert {r.component for r in queries["components"](spark, sf).collect()} == {"blick"}
    for name in ("pagerank_fixed_iter", "eigenvector_fixed_iter"):
        assert {r.node for r in queries[name](spark, sf).collect()} == set(near)


def test_all_edges_are_the_oracles(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    for name in ("cooccurrence_edges", "components"):
        want = con.sql(entry.oracle_sql()[name])
        got = entry.queries()[name](spark, SF)
        assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(want.fetchall())


def brute_betweenness(edges):
    """From all pairs' distances and numbers of shortest paths."""
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    near = {n: {} for n in nodes}
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    far = {(x, y): 0 if x == y else near[x].get(y, float("inf")) for x in nodes for y in nodes}
    for k in nodes:
        for x in nodes:
            for y in nodes:
                far[x, y] = min(far[x, y], far[x, k] + far[k, y])
    paths = {}
    for x in nodes:
        for y in sorted((y for y in nodes if far[x, y] < float("inf")), key=lambda y: far[x, y]):
            paths[x, y] = 1 if x == y else sum(paths[x, v] for v, w in near[y].items() if far[x, v] + w == far[x, y])
    n = len(nodes)
    share = lambda s, t, v: paths[s, v] * paths[v, t] / paths[s, t] if far[s, v] + far[v, t] == far[s, t] else 0
    return {v: sum(share(s, t, v) for s, t in paths if len({s, t, v}) == 3 and (s, v) in paths) / ((n - 1) * (n - 2)) for v in nodes}


@pytest.mark.parametrize("batch_rows", [10**6, 70])
def test_betweenness_in_batches(spark, batch_rows):
    rng = random.Random(2)
    edges = sorted({tuple(sorted(rng.sample("abcdefghijkl", 2))) for _ in range(20)} | {("x", "y"), ("y", "z")})
    edges = [(a, b, rng.randint(1, 3)) for a, b in edges]
    got = {r.node: r.betweenness for r in G.betweenness(spark.createDataFrame(edges, "a string, b string, weight long"), batch_rows=batch_rows).collect()}
    assert got == pytest.approx(brute_betweenness(edges))


def test_key_concepts_and_betweenness_hold_rare_pairs(spark, tmp_path):
    sf, edges = fixture(spark, tmp_path), brute_edges()
    want = brute_betweenness([(a, b, w) for (a, b), w in edges.items()])
    assert {r.node: r.betweenness for r in entry.queries()["betweenness"](spark, sf).collect()} == pytest.approx(want)
    assert {r.node for r in entry.queries()["key_concepts"](spark, sf).collect()} == set(want)


def brute_on_cells(spark, seed):
    """Files of few words, so that weights differ and shortest paths tie, and the edges by their lemmas."""
    rng = random.Random(seed)
    words = ["zorp", "blick", "mund", "tarn", "quell", "vorn", "plim", "drak", "fenn", "gask"]
    texts = [" ".join(rng.choices(words[: rng.randint(2, 10)], k=rng.randint(1, 8))) for _ in range(8)] + ["krak hupp hupp krak", "lurn mopp narf", "solo"]
    files = spark.createDataFrame([(f"f{i}", "en", "web", t) for i, t in enumerate(texts)], "file_path string, language string, author string, text string")
    return files, [(r.a, r.b, r.weight) for r in G.cooccurrence(files, 2).collect()]


@pytest.mark.parametrize("seed,seen", [(1, 1 << 22), (2, 3), (3, 1)])
def test_betweenness_over_cells(spark, monkeypatch, seed, seen):
    monkeypatch.setattr(B, "SEEN", seen)
    files, edges = brute_on_cells(spark, seed)
    net = K.Network(files, 2)
    assert len({w for *_, w in edges}) > 2
    assert {r.node: r.betweenness for r in B.betweenness(net).collect()} == pytest.approx(brute_betweenness(edges))
    want = {r.node: r.concept_score for r in G.key_concepts(spark.createDataFrame(edges, "a string, b string, weight long"), 5).collect()}
    assert {r.node: r.concept_score for r in B.key_concepts(net, 5).collect()} == pytest.approx(want)
    assert not B.fits(net, len(edges) - 1) and B.fits(net, len(edges))


def test_betweenness_makes_no_row_for_source_and_node(spark, tmp_path, monkeypatch):
    """Every (source, node) was a row that was shuffled and written for each round of a distance."""
    monkeypatch.setattr(G, "_dependencies", None)
    sf = fixture(spark, tmp_path)
    assert entry.queries()["betweenness"](spark, sf).count() == entry.queries()["key_concepts"](spark, sf).count() > 3


def test_betweenness_of_no_pair(spark):
    files = brute_on_cells(spark, 1)[0].where("text = 'solo'")
    for some in (files, files.limit(0)):
        assert B.fits(K.Network(some)) and B.betweenness(K.Network(some)).count() == B.key_concepts(K.Network(some)).count() == 0
