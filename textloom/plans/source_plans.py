"""Registered queries of the source parser over a few files that are written out here; the warehouse tables hold no source code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import parse as P

_USERS = '''import os

# loads and checks users
def get_user(name, cache=None):
    if name and cache:
        return load_user(name)
    for key in cache:
        check(key)

class UserService(Base, Other):
    def __init__(self):
        pass
'''
_SHAPES = """// area of shapes
class Circle extends Shape { }
function area(r) {
  if (r > 0 && r < 9) { return square(r) }
  return 0
}

const twice = (x) => { return 2 * x }
"""
_NOTES = """# only a comment

"""
#: (path, language, author, text)
SOURCES = (("app/users.py", "python", "ann", _USERS), ("web/shapes.js", "javascript", "bob", _SHAPES), ("app/notes.py", "python", "ann", _NOTES))


def source_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "file_path string, language string, author string, text string")


def source_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.functions(source_files(spark))
    joined = lambda c: F.array_join(c, " ").alias(c)
    return found.select("file_path", "name", "qualified_name", "start_line", "end_line", joined("parameters"), joined("calls"), "semantic_role", "cyclomatic_complexity")


def source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.classes(source_files(spark)).select("file_path", "name", "start_line", "end_line", F.array_join("base_classes", " ").alias("base_classes"), "semantic_domain")


def source_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["file_path", "lines_total", "lines_code", "lines_comment", "lines_blank", "functions", "classes", "mean_complexity", "max_complexity", "comment_density"]
    return P.modules(source_files(spark)).select(*names)


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lines_of_code(source_files(spark))


def source_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.author_sources(source_files(spark))
    return found.select("author", "files", "functions", "classes", "mean_complexity", "comment_density")


QUERIES = {"source_functions": source_functions, "source_classes": source_classes, "source_modules": source_modules, "source_lines": source_lines, "source_authors": source_authors}

# counted by hand in the texts above
ORACLE_SQL = {
    "source_functions": """SELECT * FROM (VALUES
('app/users.py', 'get_user', 'users.get_user', 4, 33, 'name cache=None', 'UserService __init__ check get_user load_user', 'accessor', 4),
('app/users.py', '__init__', 'users.__init__', 11, 40, 'self', '__init__', 'coordinator', 1),
('web/shapes.js', 'area', 'shapes.area', 3, 6, 'r', 'area if square', 'coordinator', 2),
('web/shapes.js', 'twice', 'shapes.twice', 8, 8, 'x', '', 'utility', 1)
) t(file_path, name, qualified_name, start_line, end_line, parameters, calls, semantic_role, cyclomatic_complexity)""",
    "source_classes": """SELECT * FROM (VALUES ('app/users.py', 'UserService', 9, 59, 'Base Other', 'service'), ('web/shapes.js', 'Circle', 2, 52, 'Shape', 'domain')
) t(file_path, name, start_line, end_line, base_classes, semantic_domain)""",
    "source_modules": """SELECT file_path, lines_total::BIGINT AS lines_total, lines_code, lines_comment, lines_blank, functions::BIGINT AS functions, classes::BIGINT AS classes, mean_complexity::DOUBLE AS mean_complexity, max_complexity,
lines_comment / lines_total AS comment_density FROM (VALUES ('app/users.py', 13, 9, 1, 2, 2, 1, 2.5, 4), ('web/shapes.js', 9, 6, 1, 1, 2, 1, 1.5, 2), ('app/notes.py', 3, 0, 1, 1, 0, 0, 0, 0)
) t(file_path, lines_total, lines_code, lines_comment, lines_blank, functions, classes, mean_complexity, max_complexity)""",
    "source_lines": """SELECT * FROM (VALUES ('app/users.py', 'python', 9, 1, 2), ('web/shapes.js', 'javascript', 6, 1, 1), ('app/notes.py', 'python', 0, 1, 1)
) t(file_path, language, lines_code, lines_comment, lines_blank)""",
    "source_authors": """SELECT author, files::BIGINT AS files, functions::BIGINT AS functions, classes::BIGINT AS classes, mean_complexity::DOUBLE AS mean_complexity, comment_density::DOUBLE AS comment_density
FROM (VALUES ('ann', 2, 2, 1, 1.25, (1 / 13.0::DOUBLE + 1 / 3.0::DOUBLE) / 2), ('bob', 1, 2, 1, 1.5, 1 / 9.0::DOUBLE)) t(author, files, functions, classes, mean_complexity, comment_density)""",
}
