import pytest
from pyspark.sql import functions as F

from textloom.functions import annotate as A

CASES = [
    ("fetch_user_data", ["fetch", "user", "data"], "data", "NOUN"), ("fetchUserData", ["fetch", "User", "Data"], "data", "NOUN"), ("DataProcessor", ["Data", "Processor"], "process", "NOUN"),
    ("HTTPServer", ["HTTP", "Server"], "serv", "NOUN"), ("fetching", ["fetching"], "fetch", "VERB"), ("fetched", ["fetched"], "fetch", "VERB"), ("fetches", ["fetches"], "fetche", "NOUN"),
    ("users", ["users"], "user", "NOUN"), ("process", ["process"], "proces", "NOUN"), ("__init__", ["init"], "init", "VERB"), ("is_valid", ["is", "valid"], "valid", "VERB"),
    ("self", ["self"], "self", "PRON"), ("import", ["import"], "import", "PREP"), ("_", [], "_", "VERB"),
]


def test_parts_lemma_tag(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "t string")
    rows = {r.t: r for r in df.select("t", A.parts(F.col("t")).alias("p"), A.lemma(F.col("t")).alias("l"), A.tag(F.col("t")).alias("g"), A.is_stop(A.lemma(F.col("t"))).alias("s")).collect()}
    for text, parts, lemma, tag in CASES:
        assert (rows[text].p, rows[text].l, rows[text].g) == (parts, lemma, tag)
    assert rows["__init__"].s and rows["self"].s and not rows["process"].s


@pytest.mark.parametrize("name,role", [("get_user", "accessor"), ("is_valid", "validator"), ("create_user", "factory"), ("fetch_data", "accessor")])
def test_role(spark, name, role):
    assert spark.range(1).select(A.role(F.lit(name), F.array().cast("array<string>")).alias("r")).first().r == role


def test_domain_complexity_language(spark):
    df = spark.createDataFrame([("UserService",), ("DataProcessor",), ("Builder",), ("Plain",)], "n string")
    assert [r.d for r in df.select(A.domain(F.col("n")).alias("d")).collect()] == ["service", "entity", "presentation", "domain"]
    src = spark.createDataFrame([("def f(): pass", "a/b.PY"), ("if a:\n x\nelif b:\n y\nelse:\n z", "x.unknown")], "s string, p string")
    assert [(r.c, r.l) for r in src.select(A.complexity(F.col("s")).alias("c"), A.language_of(F.col("p")).alias("l")).collect()] == [(1, "python"), (4, "unknown")]


def test_content_language(spark):
    df = spark.createDataFrame([("public class A {}",), ("#!/bin/bash\n",), ("plain words",), ("<!DOCTYPE html>",)], "t string")
    assert [r.c for r in df.select(A.content_language(F.col("t")).alias("c")).collect()] == [".java", ".sh", ".unknown", ".html"]


def test_keyness(spark):
    row = spark.range(1).select(A.keyness(F.lit(10.0), F.lit(100.0), F.lit(5.0), F.lit(200.0)).alias("g")).first()
    assert row.g == pytest.approx(6.931472, abs=1e-6)
