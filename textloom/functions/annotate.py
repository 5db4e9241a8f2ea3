"""Token annotation as Column expressions: parts, lemma, tag, stop flag, role, domain, complexity.

Every function takes and returns a Column, so it works on columns and inside array lambdas alike, and
stays on the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import lexicon as L

WORD = r"[a-zA-Z_][\p{L}\p{N}_]*"
_PARTS = r"[A-Z][a-z]+|[a-z]+|[A-Z]+(?![a-z])"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def parts(text: Column) -> Column:
    """Pieces of an identifier: at underscores unless it starts with one, else by case."""
    snake = F.array_remove(F.split(text, "_"), "")
    return F.when(text.contains("_") & ~text.startswith("_"), snake).otherwise(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)))


def lemma(text: Column) -> Column:
    """The last part in lower case without its first fitting suffix; the whole text where there is no part.

    One-element arrays bind the parts and the word, so that neither is worked out again for every suffix.
    """
    bound = F.transform(F.array(parts(text)), lambda p: F.struct((F.size(p) == 0).alias("whole"), F.lower(F.coalesce(F.get(p, F.size(p) - 1), text)).alias("word")))

    def cut(b: Column) -> Column:
        word, out = b["word"], F.when(b["whole"], b["word"])
        for suffix in L.LEMMA_SUFFIXES:
            n = len(suffix)
            out = out.when(word.endswith(suffix) & (F.length(word) > n + L.LEMMA_LEAST), F.substring(word, F.lit(1), F.length(word) - n))
        return out.otherwise(word)

    return F.get(F.transform(bound, cut), F.lit(0))


def tag(text: Column) -> Column:
    """First rule that fits: VERB, NOUN, PRON, PREP, DET or ADV."""
    low = F.lower(text)
    return (
        F.when(_any([text.startswith(p) for p in L.VERB_PREFIXES]), "VERB")
        .when(text.rlike(r"^\p{Lu}") & text.rlike(r"\p{Ll}"), "NOUN")
        .when(_any([text.endswith(s) for s in L.CALLBACK_SUFFIXES]), "VERB")
        .when(low.isin(*L.PRONOUNS), "PRON")
        .when(low.isin(*L.PREPOSITIONS), "PREP")
        .when(low.isin(*L.DETERMINERS), "DET")
        .when(low.isin(*L.ADVERBS), "ADV")
        .when(_any([low.endswith(s) for s in L.VERB_SUFFIXES]), "VERB")
        .otherwise("NOUN")
    )


def is_stop(lemma_: Column) -> Column:
    return F.lower(lemma_).isin(*L.STOP_WORDS)


def scope(context: Column) -> Column:
    """From the text of a line and the four before it."""
    has = context.contains
    return F.when(has("class ") | has("class_"), "class").when(has("def ") | has("function "), "function").when(has("import ") | has("using "), "module").otherwise("local")


def role(name: Column, calls: Column) -> Column:
    low = F.lower(name)
    out = None
    for label, prefixes in L.ROLE_PREFIXES.items():
        test = _any([low.startswith(p) for p in prefixes])
        out = F.when(test, label) if out is None else out.when(test, label)
    outer = F.size(F.filter(calls, lambda c: ~(c.startswith("self.") | c.startswith("this."))))
    out = out.when(_any([low.contains(w) for w in L.CALLBACK_WORDS]), "callback")
    return out.when((F.size(calls) > 0) & (outer > F.size(calls) * 0.7), "coordinator").otherwise("utility")


def domain(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for label, inside in L.DOMAIN_WORDS.items():
        test = _any([low.contains(w) for w in inside])
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("domain")


def complexity(source: Column) -> Column:
    branches = F.regexp_count(source, F.lit(r"(?i)\b(?:" + "|".join(L.BRANCH_WORDS) + r")\b"))
    return 1 + branches + F.regexp_count(source, F.lit(r"\b(?:and|or|&&|\|\|)\b"))


def calls(source: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(r"\b([A-Za-z_][\p{L}\p{N}_]*)\s*\("), F.lit(1))))


def local_variables(source: Column, language: Column) -> Column:
    by = {
        ("python",): r"\b([a-z_]\w*)\s*=[^=]",
        ("javascript", "typescript"): r"(?:const|let|var)\s+([a-z_]\w*)",
        ("csharp",): r"(?:var|[\w<>\[\]]+)\s+([a-z_]\w*)\s*=",
    }
    out = None
    for languages, pattern in by.items():
        test, found = language.isin(*languages), F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(pattern), F.lit(1))))
        out = F.when(test, found) if out is None else out.when(test, found)
    return out.otherwise(F.array().cast("array<string>"))


def language_of(path: Column) -> Column:
    """By the lower-cased extension; unknown without one that is listed."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in L.EXTENSION_LANGUAGE.items() for x in pair])
    return F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, v: k == ext)), F.lit(0)), F.lit("unknown"))


def content_language(text: Column) -> Column:
    """The first extension, in the order of the rules, with a pattern that the text holds."""
    out = None
    for ext, patterns in L.CONTENT_RULES.items():
        test = text.rlike("(?im)(?:" + "|".join(patterns) + ")")
        out = F.when(test, ext) if out is None else out.when(test, ext)
    return out.otherwise(".unknown")


def keyness(o1: Column, n1: Column, o2: Column, n2: Column) -> Column:
    """Log-likelihood G2 over the two observed cells."""
    e1, e2 = n1 * (o1 + o2) / (n1 + n2), n2 * (o1 + o2) / (n1 + n2)
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    return 2 * (cell(o1, e1) + cell(o2, e2))
