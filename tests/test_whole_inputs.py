from pyspark.sql import functions as F

import __spark_entry__ as entry
from textloom.sources import corpus as C


def test_content_beyond_a_prefix(spark, tmp_path):
    pages = [(1, "http://a.com", "x " * 2000 + "<?php"), (2, "http://b.com", "y " * 3000 + "#!/usr/bin/env node\n<?php"), (3, "http://c.com", "z")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.extension: r.files for r in entry.queries()["content_language"](spark, str(tmp_path)).collect()}
    assert got == {".php": 1, ".js": 1, ".unknown": 1}


def test_turn_ids_are_unique(spark):
    pairs = [(c, t) for c in (-3, 0, 1, 2, 4294967296, 2**60) for t in (-1, 0, 1, 999, 1000, 1001, 2000, 2**62)]
    got = [r.id for r in spark.createDataFrame(pairs, "c long, t long").select(C.turn_id(F.col("c"), F.col("t")).alias("id")).collect()]
    assert None not in got and len(set(got)) == len(pairs)
    assert all(i == c * 1000 + t for i, (c, t) in zip(got, pairs) if 0 <= t < 1000)


def test_long_conversation(spark, tmp_path):
    long, other = "alpha beta gamma delta one two three four five six seven eight nine", "red green blue cyan pink teal grey gold lime navy plum rust sand"
    turns = [(0, 1000, "user", long), (1, 0, "user", long), (1, 1, "model", other)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = [(r.id_a, r.id_b) for r in entry.queries()["clone_candidates"](spark, str(tmp_path)).collect()]
    assert len(pairs) == len(set(pairs)) == 3
    found = [tuple(sorted((r.qualified_name_a, r.qualified_name_b))) for r in entry.queries()["clone_matches"](spark, str(tmp_path)).where("clone_type = 'I'").collect()]
    assert found == [("0.1000", "1.0")]


def test_documents_without_source_or_lang(spark, tmp_path):
    docs = [(1, "inger runs home", "en", "web"), (2, "inger runs home", None, "web"), (3, "inger runs home", "en", None), (4, "inger runs home", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    paths = {"web/1.en", "web/2.", "/3.en", "/4."}
    for name in ("module_metrics", "information_profile", "shannon_entropy_file"):
        assert sorted(r.file_path for r in run(name)) == sorted(paths)
    assert {r.author: r.files for r in run("author_profile")} == {"web": 2, None: 2}
    assert {r.text: r.freq for r in run("collocations")} == {"runs": 4, "home": 4}
