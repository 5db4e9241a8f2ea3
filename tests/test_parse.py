from textloom.operators import parse as P
from textloom.sources import sinks

SOURCE = '''import os

def get_user(a, b=1):
    """Doc."""
    if a:
        return load(a)

class UserService(Base, Other):
    def __init__(self):
        pass
'''


def test_python(spark):
    files = spark.createDataFrame([("p/users.py", "python", SOURCE), ("p/none.txt", None, None)], "file_path string, language string, text string")
    found = {r.name: r for r in P.functions(files).collect()}
    assert set(found) == {"get_user", "__init__"}
    f = found["get_user"]
    assert (f.qualified_name, f.parameters, f.semantic_role) == ("users.get_user", ["a", "b=1"], "accessor")
    assert "load" in f.calls and f.token_count > 5 and found["__init__"].parameters == ["self"]
    c = P.classes(files).collect()
    assert [(x.name, x.base_classes, x.semantic_domain) for x in c] == [("UserService", ["Base", "Other"], "service")]


def test_braces_and_basic():
    js = "const add = (a, b) => { return { x: a } }\nfunction sub(c) { }"
    heads = list(P.function_heads(js, "javascript"))
    assert [(h["name"], h["parameters"]) for h in heads] == [("add", ["a", "b"]), ("sub", ["c"])]
    assert heads[0]["source_code"].endswith("} }")
    assert P.body_span("Sub A\nx\nEnd Sub\nrest", 0, "vbscript") == ("Sub A\nx\nEnd Sub", 3)


def test_line_counts():
    assert P.line_counts('"""one"""\nx = 1\n# c\n\n', "python") == (0, 2, 1)
    assert P.line_counts("/* a\nb */\nx();\n// y", "javascript") == (3, 3, 0)


def test_rename_plan_and_save(spark, tmp_path):
    files = spark.createDataFrame([("a/x.txt", "#!/bin/bash"), ("a/x.sh", "#!/bin/bash"), ("a/y.txt", "words")], "file_path string, text string")
    rows = {r.file_path: r for r in sinks.rename_plan(files).collect()}
    assert rows["a/x.txt"].conflict and rows["a/x.txt"].target == "a/x.sh" and not rows["a/y.txt"].conflict
    for _ in range(2):
        sinks.save(files, str(tmp_path), "modules")
    assert spark.read.parquet(f"{tmp_path}/modules").count() == 3


def test_author_words(spark):
    from textloom.plans import source_plans

    words = {r.author: r.words for r in P.author_sources(source_plans.source_files(spark)).collect()}
    assert set(words) == {"ann", "bob"} and "cache" in words["ann"] and "shape" in words["bob"] and all(len(w) <= 50 for w in words.values())
