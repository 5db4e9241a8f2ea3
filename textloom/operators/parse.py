"""Functions, classes and line counts of source files.

Match offsets and brace scans need the text in order, so one Arrow pass per file finds the spans; roles,
domains, complexity, calls and variables are then columns on the JVM side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import annotate as A
from textloom.operators import corpus_queries as Q
from textloom.operators.style import frequent_by_author
from textloom.sources import corpus as C

# --- fixed values: what counts as a function or class head ---
FUNCTION_HEADS = {
    "python": r"(?m)^(\s*)(?:async\s+)?def\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)",
    "javascript": r"(?:export\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*\((?P<params>[^)]*)\)|(?:const|let|var)\s+(?P<name2>\w+)\s*=\s*(?:async\s+)?\((?P<params2>[^)]*)\)\s*=>",
    "csharp": r"(?:(?:public|private|protected|internal|static|virtual|override|async|abstract|sealed)\s+)*(?P<ret>[\w<>\[\]?,\s]+?)\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:\{|=>)",
    "powershell": r"(?i)function\s+(?P<name>[\w-]+)\s*(?:\{|\((?P<params>[^)]*)\))",
}
CLASS_HEADS = {
    "python": r"(?m)^\s*class\s+(?P<name>\w+)(?:\((?P<bases>[^)]*)\))?:",
    "javascript": r"class\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>\w+))?",
    "csharp": r"(?:public|private|protected|internal|static|abstract|sealed)?\s*class\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[\w,\s<>]+))?\s*\{",
}
BODY_LINES = 30
CLASS_LINES = 50
# --- end of fixed values ---

CONTROL_NAMES = frozenset("if while for foreach switch catch using lock return".split())


def body_span(text: str, start: int, language: str) -> tuple[str, int]:
    """(body, lines it is said to take): a balanced brace block, for Basic up to its End, else thirty lines."""
    if language in ("vbnet", "vbscript"):
        end = re.compile(r"(?i)\bEnd\s+(?:Sub|Function|Property)\b").search(text, start)
        return (text[start : end.end()], text.count("\n", start, end.end()) + 1) if end else (text[start : start + 500], 20)
    level = 0
    for brace in re.compile(r"[{}]").finditer(text, start):
        if brace[0] == "{":
            level += 1
        elif level:
            level -= 1
            if not level:
                return text[start : brace.end()], text.count("\n", start, brace.end()) + 1
    first = text.count("\n", 0, start)
    return "\n".join(text.splitlines()[first : first + BODY_LINES]), BODY_LINES


def parameter_names(params: str) -> list[str]:
    return [piece.split()[-1] for piece in params.split(",") if piece.strip()]


def function_heads(text: str, language: str, skip_control: bool = False) -> Iterator[dict]:
    head = FUNCTION_HEADS.get(language)
    for m in re.finditer(head, text) if head else ():
        got = m.groupdict()
        name = got["name"] or got.get("name2") or "anonymous"
        if skip_control and name in CONTROL_NAMES:
            continue
        before = text.count("\n", 0, m.start())
        body, lines = body_span(text, m.start(), language)
        yield {"name": name, "start_line": before + 1, "end_line": before + lines, "parameters": parameter_names(got.get("params") or got.get("params2") or ""), "source_code": body}


def class_heads(text: str, language: str) -> Iterator[dict]:
    head = CLASS_HEADS.get(language)
    for m in re.finditer(head, text) if head else ():
        line = text.count("\n", 0, m.start()) + 1
        yield {"name": m["name"], "start_line": line, "end_line": line + CLASS_LINES, "base_classes": [b.strip() for b in (m["bases"] or "").split(",") if b.strip()]}


def line_counts(text: str, language: str) -> tuple[int, int, int]:
    """(code, comment, blank) lines.

    A triple quote at a line's start switches Python's block state for code, even where it closes on the
    same line; among comments a closing triple quote counts twice.
    """
    code = comment = blank = 0
    in_code_block = in_comment_block = False
    for line in map(str.strip, text.splitlines()):
        if not line:
            blank += 1
            continue
        one_line = line.startswith(("#", "//"))
        quotes = language == "python" and line.startswith(('"""', "'''"))
        if not one_line:
            if quotes:
                in_code_block = not in_code_block
            elif not in_code_block:
                code += 1
        comment += one_line
        in_comment_block |= not one_line and line.startswith(("/*", "<#"))
        comment += in_comment_block
        in_comment_block &= not ("*/" in line or "#>" in line)
        if quotes:
            comment += 1
            if 1 in (line.count('"""'), line.count("'''")):
                in_comment_block = not in_comment_block
    return code, comment, blank


def _each(files: DataFrame, find, schema: str, columns: list[str]) -> DataFrame:
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"file_path": path, "language": lang} | row for path, lang, text in zip(part["file_path"], part["language"], part["text"]) for row in find(text or "", lang or "")]
            yield pd.DataFrame(rows, columns=["file_path", "language", *columns])

    return files.select("file_path", "language", "text").mapInPandas(work, f"file_path string, language string, {schema}")


def _stem():
    return F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"(?<=.)\.[^.]*$", "")


def functions(files: DataFrame, skip_control: bool = False) -> DataFrame:
    """One row per function with role, complexity, calls, variables and token counts."""
    found = _each(files, lambda t, lang: function_heads(t, lang, skip_control), "name string, start_line int, end_line int, parameters array<string>, source_code string", ["name", "start_line", "end_line", "parameters", "source_code"])
    source = F.col("source_code")
    found = found.withColumn("calls", A.calls(source)).select(
        "*", F.concat(_stem(), F.lit("."), "name").alias("qualified_name"), F.xxhash64("file_path", "start_line", "name").alias("fn_id"), A.role(F.col("name"), F.col("calls")).alias("semantic_role"),
        A.complexity(source).alias("cyclomatic_complexity"), A.local_variables(source, F.col("language")).alias("local_variables"),
    )
    words = C.raw_tokens(files.withColumn("author", F.lit(None).cast("string"))).groupBy("file_path", "line").agg(F.collect_list("text").alias("w"))
    spans = found.select("fn_id", "file_path", F.explode(F.sequence("start_line", "end_line")).alias("line")).join(words, ["file_path", "line"])
    forms = spans.select("fn_id", F.explode("w").alias("t")).groupBy("fn_id").agg(F.count("*").cast("int").alias("token_count"), F.countDistinct(A.lemma(F.col("t"))).cast("int").alias("unique_tokens"))
    full = found.join(forms, "fn_id", "left").fillna(0, ["token_count", "unique_tokens"])
    return full.withColumn("type_token_ratio", F.col("unique_tokens") / F.greatest("token_count", F.lit(1)))


def classes(files: DataFrame) -> DataFrame:
    found = _each(files, class_heads, "name string, start_line int, end_line int, base_classes array<string>", ["name", "start_line", "end_line", "base_classes"])
    return found.select("*", F.concat(_stem(), F.lit("."), "name").alias("qualified_name"), A.domain(F.col("name")).alias("semantic_domain"))


def lines_of_code(files: DataFrame) -> DataFrame:
    names = ["lines_code", "lines_comment", "lines_blank"]
    return _each(files, lambda t, lang: [dict(zip(names, line_counts(t, lang)))], "lines_code int, lines_comment int, lines_blank int", names)


def modules(files: DataFrame) -> DataFrame:
    """One row per file: its metrics, lines of each kind, functions with their mean and largest complexity, classes, share of comment lines.

    Files without functions have complexity 0; files without tokens have no row.
    """
    by_file = functions(files).groupBy("file_path").agg(
        F.count("*").alias("functions"), F.avg("cyclomatic_complexity").alias("mean_complexity"), F.max("cyclomatic_complexity").alias("max_complexity")
    )
    held = classes(files).groupBy("file_path").agg(F.count("*").alias("classes"))
    found = Q.module_metrics(files).drop("lines_blank").join(lines_of_code(files).drop("language"), "file_path").join(by_file, "file_path", "left").join(held, "file_path", "left")
    found = found.fillna(0, ["functions", "classes", "max_complexity"]).fillna(0.0, ["mean_complexity"])
    return found.withColumn("comment_density", F.col("lines_comment") / F.greatest("lines_total", F.lit(1)))


def author_sources(files: DataFrame) -> DataFrame:
    """An author's files, functions and classes with mean complexity, comment density and identifier length, and the 50 most frequent lemmas."""
    found = modules(files).join(files.select("file_path", "author"), "file_path")
    by = found.groupBy("author").agg(
        F.count("*").alias("files"), F.sum("functions").alias("functions"), F.sum("classes").alias("classes"),
        F.avg("mean_complexity").alias("mean_complexity"), F.avg("comment_density").alias("comment_density"), F.avg("avg_identifier_length").alias("mean_identifier_length"),
    )
    words = frequent_by_author(files, 50).groupBy("author").agg(F.sort_array(F.collect_list(F.struct("rank", "lemma"))).alias("w"))
    return by.join(words, "author", "left").select("*", F.transform("w", lambda x: x["lemma"]).alias("words")).drop("w")
