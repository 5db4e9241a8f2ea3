"""Corpus queries: concordance, collocations, n-grams, wordlists, keyness, profiles, entropy.

All take files or token frames and return DataFrames; every limit has the natural key as tie-break.
Counts of forms are aggregated first and only the distinct forms are annotated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import annotate as A
from textloom.operators import measures as M
from textloom.sources import corpus as C


def selected(files: DataFrame, ext: str | None = None, language: str | None = None, exclude_ext: str | None = None) -> DataFrame:
    """Files by extension of their path, by language, or without an extension."""
    tests = []
    if ext is not None:
        tests.append(F.col("file_path").endswith(f".{ext}"))
    if exclude_ext is not None:
        tests.append(~F.col("file_path").endswith(f".{exclude_ext}"))
    if language is not None:
        tests.append(F.col("language") == language)
    for test in tests:
        files = files.where(test)
    return files


def form_counts(files: DataFrame, *by: str) -> DataFrame:
    """(by, text, freq, lemma, pos, is_stop): one row per distinct form and group."""
    flat = files.select(*by, F.explode(A.words(F.col("text"))).alias("form"))
    counted = flat.groupBy(*by, "form").agg(F.count("*").alias("freq"))
    return C.annotate_forms(counted.withColumnRenamed("form", "text"))


def wordlist(files: DataFrame, by_lemma: bool = True, pos: str | None = None) -> DataFrame:
    forms = form_counts(files).where("not is_stop")
    if pos is not None:
        forms = forms.where(F.col("pos") == pos)
    key = "lemma" if by_lemma else "text"
    return forms.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("freq").alias("freq"))


def wordlist_cumulative(files: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent forms with rank, share and cumulative share; only these k rows are ever ordered together."""
    forms = wordlist(files, by_lemma=False)
    total = forms.agg(F.sum("freq").alias("total"))
    top = forms.orderBy(F.desc("freq"), "text").limit(k)
    w = Window.orderBy(F.desc("freq"), "text")
    ranked = top.select("text", "freq", F.row_number().over(w).alias("rank"), F.sum("freq").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__run"))
    return ranked.join(F.broadcast(total)).select("rank", "text", "freq", (F.col("freq") / F.col("total")).alias("share"), (F.col("__run") / F.col("total")).alias("cumulative"))


def vocabulary_profile(files: DataFrame) -> DataFrame:
    lemmas = form_counts(files).groupBy("lemma").agg(F.sum("freq").alias("n"), F.sum(F.when(~F.col("is_stop"), F.col("freq"))).alias("k"))
    content = lemmas.where("k > 0")
    return content.agg(
        F.sum("k").alias("total_tokens"), F.count("*").alias("lemma_groups"), F.countDistinct("lemma").alias("unique_lemmas"), F.count_if(F.col("k") == 1).alias("hapax")
    ).select("*", F.try_divide("unique_lemmas", "total_tokens").alias("type_token_ratio"), F.try_divide("hapax", "unique_lemmas").alias("hapax_ratio"))


def concordance(files: DataFrame, keyword: str, context_size: int = 5, pos_filter: str | None = None, k: int | None = None) -> DataFrame:
    """Every hit with up to ``context_size`` tokens of its line on either side; found inside the row, without a shuffle.

    ``pos_filter`` keeps hits with that tag, ``k`` the first so many by file, line and place.
    """
    at = C.lines(files).where(F.col("line_text").contains(keyword)).select("file_path", "line", A.words(F.col("line_text")).alias("w"))
    hits = at.select("file_path", "line", "w", F.posexplode("w").alias("pos_in_line", "text")).where(F.col("text") == keyword)
    if pos_filter is not None:
        hits = hits.where(A.tag(F.col("text")) == pos_filter)
    p = F.col("pos_in_line")
    start = F.greatest(p - context_size, F.lit(0))
    left = F.slice("w", start + 1, p - start)
    found = hits.select("file_path", "line", "pos_in_line", F.array_join(left, " ").alias("left_context"), "text", F.array_join(F.slice("w", p + 2, context_size), " ").alias("right_context"))
    return found if k is None else found.orderBy("file_path", "line", "pos_in_line").limit(k)


def collocations(files: DataFrame, word: str, window: int = 5, min_freq: int = 2, k: int = 50) -> DataFrame:
    """Words within ``window`` lines of ``word``, pairs counted with multiplicity, ranked by pmi.

    Lines with the word are spread over their neighbours as counts, so a frequent word adds at most
    2 * window + 1 rows a line, and the other words are counted by an equi-join.
    """
    tokens = C.raw_tokens(files).select("file_path", "line", "text")
    near = tokens.where(F.col("text") == word).groupBy("file_path", "line").agg(F.count("*").alias("hits"))
    near = near.select("file_path", F.explode(F.sequence(F.col("line") - window, F.col("line") + window)).alias("line"), "hits").groupBy("file_path", "line").agg(F.sum("hits").alias("hits"))
    joint = tokens.where(F.col("text") != word).join(near, ["file_path", "line"]).groupBy("text").agg(F.sum("hits").alias("freq")).where(F.col("freq") >= min_freq)
    every = tokens.groupBy("text").agg(F.count("*").alias("c"))
    totals = every.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("text") == word, F.col("c"))).alias("w"))
    pmi = F.log2(F.col("freq") * F.col("n").cast("double") / (F.col("w") * F.col("c")))
    found = joint.join(every, "text").join(F.broadcast(totals)).select("text", A.lemma(F.col("text")).alias("lemma"), "freq", pmi.alias("pmi"))
    band = F.when(F.col("pmi") > 5, "strong").when(F.col("pmi") > 3, "medium").otherwise("weak")
    return found.withColumn("strength", band).orderBy(F.desc(F.round("pmi", 9)), "text").limit(k)


def ngrams(files: DataFrame, n: int = 3, min_freq: int = 2, pos_pattern: list[str] | None = None, k: int | None = 100) -> DataFrame:
    """Runs of n tokens inside a line whose first token is no stop word; cut from the line's token array, no join."""
    if pos_pattern is not None and len(pos_pattern) < n:
        raise ValueError("the pattern needs a tag for each position")
    if k:
        return M.frequent_ngrams(files, n, min_freq, pos_pattern, k).orderBy(F.desc("freq"), "ngram").limit(k)
    w = F.col("w")
    at = files.select(F.explode(F.split("text", "\n")).alias("l")).select(A.words(F.col("l")).alias("w")).where(F.size("w") >= n)
    grams = at.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).alias("ngram"))
    counted = grams.groupBy("ngram").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)
    first = F.substring_index("ngram", " ", 1)
    counted = counted.where(~A.is_stop(A.lemma(first)))
    if pos_pattern is not None:
        pieces = F.split("ngram", " ")
        for i, wanted in enumerate(pos_pattern[:n]):
            counted = counted.where(A.tag(F.get(pieces, F.lit(i))) == wanted)
    return counted if k is None else counted.orderBy(F.desc("freq"), "ngram").limit(k)


def keyness(files: DataFrame, target: Column, reference: Column, min_target: int = 3, least: float = 3.84, k: int | None = 100) -> DataFrame:
    """G2 of each lemma in the target against the reference files, both counted in one pass."""
    sides = files.where(target | reference).select(target.alias("__t"), "text")
    lemmas = form_counts(sides, "__t").where("not is_stop").groupBy("lemma").agg(F.sum(F.when(F.col("__t"), F.col("freq")).otherwise(0)).alias("target"), F.sum(F.when(~F.col("__t"), F.col("freq")).otherwise(0)).alias("reference"))
    totals = lemmas.agg(F.sum("target").alias("nt"), F.sum("reference").alias("nr"))
    g2 = A.keyness(F.col("target").cast("double"), F.col("nt").cast("double"), F.col("reference").cast("double"), F.col("nr").cast("double"))
    found = lemmas.where(F.col("target") >= min_target).join(F.broadcast(totals)).select("lemma", "target", "reference", g2.alias("g2")).where(F.col("g2") > least)
    stars = F.when(F.col("g2") > 10.83, "***").when(F.col("g2") > 6.63, "**").otherwise("*")
    found = found.withColumn("significance", stars)
    return found if k is None else found.orderBy(F.desc(F.round("g2", 6)), "lemma").limit(k)


def tag_counts(files: DataFrame, *by: str) -> DataFrame:
    return form_counts(files, *by).groupBy(*by, "pos").agg(F.sum("freq").alias("n"))


def entropy(counts: DataFrame, *by: str, n: str = "n") -> DataFrame:
    """Shannon entropy in bits of the counts of each group."""
    # H = log2(N) - sum(n log2 n) / N
    return counts.groupBy(*by).agg(F.greatest(F.log2(F.sum(n)) - F.sum(F.col(n) * F.log2(n)) / F.sum(n), F.lit(0.0)).alias("entropy"))


def entropy_by_language(files: DataFrame) -> DataFrame:
    by_file = _by_file(files, lambda _, c: c.select("file_path", "language", M.tag_entropy().alias("entropy")), lambda f: entropy(tag_counts(f, "file_path", "language"), "file_path", "language"))
    mean = by_file.groupBy("language").agg(F.avg("entropy").alias("mean_entropy"), F.count("*").alias("files"))
    return mean.withColumn("band", F.when(F.col("mean_entropy") > 2.5, "high").when(F.col("mean_entropy") > 1.5, "medium").otherwise("low"))


def conditional_entropy(files: DataFrame, given: str = "VERB", target: str = "NOUN", full: bool = False) -> DataFrame:
    """Per file -p log2 p with p = count(target right after given) / count(given); ``full`` sums over all targets."""
    tags = C.file_words(files).select("file_path", F.transform("words", A.tag).alias("t"))
    follows = tags.select("file_path", F.size(F.filter("t", lambda x: x == given)).alias("g"), F.explode_outer(F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    counts = follows.where(F.col("p.a") == given).groupBy("file_path", "g", F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("g")
    term = F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    if full:
        return counts.groupBy("file_path").agg(F.sum(term).alias("conditional_entropy"))
    found = counts.where(F.col("b") == target).select("file_path", term.alias("v"))
    return files.select("file_path").join(found, "file_path", "left").select("file_path", F.coalesce("v", F.lit(0.0)).alias("conditional_entropy"))


def _by_file(files: DataFrame, measure, shuffled) -> DataFrame:
    """``measure`` of the files' counts, found in the row; ``shuffled`` of files that lie in several rows."""
    alone, repeated = M.split_repeated(files)
    found = measure(alone, M.file_counts(alone))
    return found if repeated is None else found.unionByName(shuffled(repeated))


def file_entropy(files: DataFrame) -> DataFrame:
    """Shannon entropy of each file's tags."""
    return _by_file(files, lambda _, c: c.select("file_path", M.tag_entropy().alias("entropy")), lambda f: entropy(tag_counts(f, "file_path"), "file_path"))


def semantic_density(files: DataFrame) -> DataFrame:
    """Distinct content lemmas over the last line that has one."""
    density = (F.col("lemmas") / F.greatest("last_line", F.lit(1))).alias("semantic_density")

    def shuffled(files: DataFrame) -> DataFrame:
        forms = C.raw_tokens(files).groupBy("file_path", "text").agg(F.max("line").alias("last"))
        return C.annotate_forms(forms).where("not is_stop").groupBy("file_path").agg(F.countDistinct("lemma").alias("lemmas"), F.max("last").alias("last_line")).select("file_path", "lemmas", "last_line", density)

    counted = lambda _, c: c.where("content_tokens > 0").select("file_path", F.col("unique_tokens").alias("lemmas"), F.col("last_line").cast("int").alias("last_line")).select("*", density)
    return _by_file(files, counted, shuffled)


def module_metrics(files: DataFrame) -> DataFrame:
    """One row per file: sizes, lines, tokens, tag entropy, identifier style."""
    lines = F.split("text", "\n")
    facts = [F.octet_length("text").cast("long").alias("size_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.size(lines).cast("long").alias("lines_total"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("lines_blank")]
    share = lambda c: F.try_divide(F.col(c), F.col("n_NOUN"))
    style = F.when(share("snake") > 0.5, "snake_case").when(share("pascal") > 0.5, "PascalCase").when(share("camel") > 0.3, "camelCase").otherwise("none")
    ready = lambda df: df.select(
        "file_path", "language", "size_bytes", "sha256", "lines_total", "lines_blank", "token_count", "unique_tokens", (F.col("unique_tokens") / F.greatest("token_count", F.lit(1))).alias("type_token_ratio"),
        F.col("entropy").alias("semantic_entropy"), style.alias("identifier_style"), F.try_divide("letters", "n_NOUN").alias("avg_identifier_length"),
    )

    def shuffled(files: DataFrame) -> DataFrame:
        forms = form_counts(files, "file_path", "language")
        f, t = F.col("freq"), F.col("text")
        noun = F.col("pos") == "NOUN"
        count = lambda test: F.sum(F.when(test, f).otherwise(0))
        by = forms.groupBy("file_path", "language").agg(
            F.sum("freq").alias("token_count"), F.countDistinct(F.when(~F.col("is_stop"), F.col("lemma"))).alias("unique_tokens"), count(noun).alias("n_NOUN"),
            count(noun & t.contains("_") & ~t.startswith("_")).alias("snake"), count(noun & F.substring(t, 2, 1 << 20).rlike(r"\p{Lu}")).alias("camel"), count(noun & t.rlike(r"^\p{Lu}")).alias("pascal"),
            F.sum(F.when(noun, f * F.length(t))).alias("letters"),
        )
        tags = entropy(forms.groupBy("file_path", "pos").agg(F.sum("freq").alias("n")), "file_path")
        return ready(files.select("file_path", *facts).join(by, "file_path").join(tags, "file_path"))

    def counted(files: DataFrame, counts: DataFrame) -> DataFrame:
        return ready(files.select("file_path", *facts).join(counts.withColumn("entropy", M.tag_entropy()), "file_path"))

    return _by_file(files, counted, shuffled)


def scope_tokens(files: DataFrame) -> DataFrame:
    return M.scope_columns(files)


def syntagmas(files: DataFrame) -> DataFrame:
    """A VERB and the NOUNs right after it (one or more) with their lemmas and density.

    Found inside the row, so no token is shuffled and no file is sorted. Tags become their first letters, which
    differ for VERB and NOUN; the places of a VERB before a NOUN and the matches of VN+ come in the same order.
    """
    tagged = C.file_words(files).select("file_path", "words", F.transform("words", lambda x: F.substring(A.tag(x), 1, 1)).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (F.get("t", i) == "V") & (F.get("t", i + 1) == "N"))
    found = F.arrays_zip(starts.alias("at"), F.regexp_extract_all(F.array_join("t", ""), F.lit("VN+"), F.lit(0)).alias("run"))
    # only the words of a run leave the row, not the file's words once for every run
    cut = F.transform(found, lambda z: F.struct(z["at"].alias("at"), F.slice("words", z["at"] + 1, F.length(z["run"])).alias("run")))
    runs = tagged.select("file_path", F.explode(cut).alias("s")).select("file_path", "s.at", "s.run")
    lemmas = runs.withColumn("lemmas", F.transform("run", A.lemma))
    return lemmas.select("file_path", F.col("at").cast("long").alias("start_seq"), F.array_join("run", " ").alias("text"), F.array_join("lemmas", " ").alias("lemmas"), (F.size(F.array_distinct("lemmas")) / F.size("run")).alias("semantic_density"))


def corpus_stats(files: DataFrame) -> DataFrame:
    """One row: files that hold tokens, tokens, distinct lemmas, languages of those files."""
    forms = form_counts(files).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("tokens"), F.countDistinct("lemma").alias("lemmas"))
    held = files.where(F.col("text").rlike(A.WORD)).agg(F.countDistinct("file_path").alias("files"), F.countDistinct("language").alias("languages"))
    return held.join(F.broadcast(forms)).select("files", "tokens", "lemmas", "languages")


def directory_groups(files: DataFrame, directories: int = 3, names: int = 3) -> DataFrame:
    """The first directories by name with their number of files and the first names in each; a file without a directory has ''."""
    at = files.select(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("directory"), F.substring_index("file_path", "/", -1).alias("name"))
    first = at.groupBy("directory").agg(F.count("*").alias("files")).orderBy("directory").limit(directories)
    some = at.withColumn("__n", F.row_number().over(Window.partitionBy("directory").orderBy("name"))).where(F.col("__n") <= names)
    listed = some.groupBy("directory").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("names"))
    return first.join(listed, "directory").select("directory", "files", "names")


def language_distribution(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))


def content_languages(pages: DataFrame, text: str, chars: int | None = None) -> DataFrame:
    """Counts and shares by the extension that the content looks like; ``chars`` looks at a prefix only."""
    content = F.col(text) if chars is None else F.substring(text, 1, chars)
    counted = pages.select(A.content_language(content).alias("extension")).groupBy("extension").agg(F.count("*").alias("files"))
    total = counted.agg(F.sum("files").alias("total"))
    return counted.join(F.broadcast(total)).select("extension", "files", (F.col("files") / F.col("total")).alias("share"))
