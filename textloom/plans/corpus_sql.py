"""Oracle SQL for the corpus queries (DuckDB), on the same tables."""

from textloom.functions import lexicon as L


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _ends(column: str, endings) -> str:
    return "(" + " OR ".join(f"ends_with({column}, '{e}')" for e in endings) + ")"


def _starts(column: str, starts) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{s}')" for s in starts) + ")"


WORD = r"[a-zA-Z_][\p{L}\p{N}_]*"


def lemma(t: str) -> str:
    parts = f"CASE WHEN contains({t}, '_') AND NOT starts_with({t}, '_') THEN list_filter(string_split({t}, '_'), lambda p: p <> '') ELSE regexp_extract_all(regexp_replace({t}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z][a-z]+|[a-z]+|[A-Z]+') END"
    last = f"lower(({parts})[-1])"
    cuts = " ".join(f"WHEN ends_with({last}, '{s}') AND length({last}) > {len(s) + L.LEMMA_LEAST} THEN left({last}, length({last}) - {len(s)})" for s in L.LEMMA_SUFFIXES)
    return f"CASE WHEN len({parts}) = 0 THEN lower({t}) {cuts} ELSE {last} END"


def tag(t: str) -> str:
    return (
        f"CASE WHEN {_starts(t, L.VERB_PREFIXES)} THEN 'VERB' WHEN regexp_matches({t}, '^\\p{{Lu}}') AND regexp_matches({t}, '\\p{{Ll}}') THEN 'NOUN' "
        f"WHEN {_ends(t, L.CALLBACK_SUFFIXES)} THEN 'VERB' WHEN lower({t}) IN {_in(L.PRONOUNS)} THEN 'PRON' WHEN lower({t}) IN {_in(L.PREPOSITIONS)} THEN 'PREP' "
        f"WHEN lower({t}) IN {_in(L.DETERMINERS)} THEN 'DET' WHEN lower({t}) IN {_in(L.ADVERBS)} THEN 'ADV' WHEN {_ends(f'lower({t})', L.VERB_SUFFIXES)} THEN 'VERB' ELSE 'NOUN' END"
    )


FILES = "files AS (SELECT source || '/' || doc_id || '.' || lang AS file_path, lang AS language, source AS author, text FROM documents)"
LINES = f"{FILES}, lines AS (SELECT file_path, language, author, unnest(string_split(text, chr(10))) AS line_text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM files)"
TOKENS = f"""{LINES},
raw AS (SELECT file_path, language, author, line, line_text, unnest(regexp_extract_all(line_text, '{WORD}')) AS text, unnest(range(0, len(regexp_extract_all(line_text, '{WORD}')))) AS pos_in_line FROM lines),
forms AS (SELECT text, lem AS lemma, pos, lower(lem) IN {_in(L.STOP_WORDS)} AS is_stop FROM (SELECT text, {lemma('text')} AS lem, {tag('text')} AS pos FROM (SELECT DISTINCT text FROM raw))),
tok AS (SELECT raw.*, lemma, pos, is_stop, row_number() OVER (PARTITION BY file_path ORDER BY line, pos_in_line) - 1 AS seq FROM raw JOIN forms USING (text))"""


def _entropy(by: str, where: str = "TRUE") -> str:
    return f"SELECT {by}, abs(sum(p * log2(p))) AS entropy FROM (SELECT {by}, n / sum(n) OVER (PARTITION BY {by}) AS p FROM (SELECT {by}, pos, count(*) AS n FROM tok WHERE {where} GROUP BY {by}, pos)) GROUP BY {by}"


def _ngrams(n: int, extra: str = "") -> str:
    cols = ", ".join(f"lead(text, {i}) OVER w AS t{i}, lead(pos, {i}) OVER w AS p{i}" for i in range(1, n))
    joined = "text" + "".join(f" || ' ' || t{i}" for i in range(1, n))
    return f"WITH {TOKENS}, g AS (SELECT text, pos, is_stop, {cols} FROM tok WINDOW w AS (PARTITION BY file_path, line ORDER BY pos_in_line)) SELECT {joined} AS ngram, count(*) AS freq FROM g WHERE NOT is_stop AND t{n - 1} IS NOT NULL {extra} GROUP BY 1 HAVING count(*) >= 2 ORDER BY freq DESC, ngram LIMIT 100"


def _keyness(target: str, reference: str) -> str:
    return f"""WITH {TOKENS}, c AS (SELECT lemma, count(*) FILTER (WHERE {target}) AS target, count(*) FILTER (WHERE {reference}) AS reference FROM tok WHERE NOT is_stop AND ({target} OR {reference}) GROUP BY lemma),
n AS (SELECT sum(target)::DOUBLE AS nt, sum(reference)::DOUBLE AS nr FROM c),
g AS (SELECT lemma, target, reference, 2 * (CASE WHEN target > 0 THEN target * ln(target / (nt * (target + reference) / (nt + nr))) ELSE 0 END
   + CASE WHEN reference > 0 THEN reference * ln(reference / (nr * (target + reference) / (nt + nr))) ELSE 0 END) AS g2 FROM c, n WHERE target >= 3)
SELECT *, CASE WHEN g2 > 10.83 THEN '***' WHEN g2 > 6.63 THEN '**' ELSE '*' END AS significance FROM g WHERE g2 > 3.84 ORDER BY round(g2, 6) DESC, lemma LIMIT 100"""


ORACLE = {
    "wordlist_lemma": f"WITH {TOKENS} SELECT lemma, count(*)::BIGINT AS freq FROM tok WHERE NOT is_stop GROUP BY lemma",
    "wordlist_text_cumulative": f"""WITH {TOKENS}, c AS (SELECT text, count(*) AS freq FROM tok WHERE NOT is_stop GROUP BY text),
r AS (SELECT text, freq, row_number() OVER w AS rank, sum(freq) OVER w / sum(freq) OVER () AS cumulative, freq / sum(freq) OVER () AS share FROM c WINDOW w AS (ORDER BY freq DESC, text ROWS UNBOUNDED PRECEDING))
SELECT rank, text, freq, share, cumulative FROM r WHERE rank <= 50""",
    "vocab_profile": f"""WITH {TOKENS}, c AS (SELECT lemma, count(*) AS k FROM tok WHERE NOT is_stop GROUP BY lemma)
SELECT sum(k)::BIGINT AS total_tokens, count(*) AS lemma_groups, count(DISTINCT lemma) AS unique_lemmas, count(*) FILTER (WHERE k = 1) AS hapax,
count(DISTINCT lemma) / sum(k) AS type_token_ratio, count(*) FILTER (WHERE k = 1) / count(DISTINCT lemma) AS hapax_ratio FROM c""",
    "concordance": f"""WITH {TOKENS}, l AS (SELECT file_path, line, list(text ORDER BY pos_in_line) AS w FROM tok GROUP BY file_path, line)
SELECT t.file_path, t.line, t.pos_in_line, coalesce(array_to_string(w[greatest(t.pos_in_line - 5, 0) + 1 : t.pos_in_line], ' '), '') AS left_context, t.text, coalesce(array_to_string(w[t.pos_in_line + 2 : t.pos_in_line + 6], ' '), '') AS right_context
FROM tok t JOIN l USING (file_path, line) WHERE t.text = 'inger'""",
    "concordance_tagged": f"""WITH {TOKENS}, l AS (SELECT file_path, line, list(text ORDER BY pos_in_line) AS w FROM tok GROUP BY file_path, line)
SELECT t.file_path, t.line, t.pos_in_line, coalesce(array_to_string(w[greatest(t.pos_in_line - 5, 0) + 1 : t.pos_in_line], ' '), '') AS left_context, t.text, coalesce(array_to_string(w[t.pos_in_line + 2 : t.pos_in_line + 6], ' '), '') AS right_context
FROM tok t JOIN l USING (file_path, line) WHERE t.text = 'inger' AND pos = 'NOUN' ORDER BY t.file_path, t.line, t.pos_in_line LIMIT 20""",
    "collocations": f"""WITH {TOKENS}, j AS (SELECT b.text, count(*) AS freq FROM raw a JOIN raw b ON a.file_path = b.file_path AND abs(a.line - b.line) <= 5 WHERE a.text = 'inger' AND b.text <> 'inger' GROUP BY b.text HAVING count(*) >= 2),
e AS (SELECT text, count(*) AS c FROM raw GROUP BY text), n AS (SELECT sum(c)::DOUBLE AS n, sum(c) FILTER (WHERE text = 'inger') AS w FROM e)
SELECT *, CASE WHEN pmi > 5 THEN 'strong' WHEN pmi > 3 THEN 'medium' ELSE 'weak' END AS strength FROM (SELECT j.text, lemma, freq, log2(freq * n / (w * c)) AS pmi FROM j JOIN e USING (text) JOIN forms USING (text), n) ORDER BY round(pmi, 9) DESC, text LIMIT 50""",
    "ngrams_2": _ngrams(2),
    "ngrams_3": _ngrams(3),
    "ngrams_pos_pattern": _ngrams(2, "AND pos = 'VERB' AND p1 = 'NOUN'"),
    "keyness_lang": _keyness("ends_with(file_path, '.fr')", "ends_with(file_path, '.en')"),
    "keyness_vs_rest": _keyness("language = 'en'", "language <> 'en'"),
    "pos_distribution": f"WITH {TOKENS} SELECT language, pos, count(*) AS n FROM tok GROUP BY ALL",
    "shannon_entropy_file": f"WITH {TOKENS} {_entropy('file_path')}",
    "entropy_by_language": f"""WITH {TOKENS}, e AS ({_entropy('file_path, language')})
SELECT language, avg(entropy) AS mean_entropy, count(*) AS files, CASE WHEN avg(entropy) > 2.5 THEN 'high' WHEN avg(entropy) > 1.5 THEN 'medium' ELSE 'low' END AS band FROM e GROUP BY language""",
    "conditional_entropy": f"""WITH {TOKENS}, n AS (SELECT file_path, pos, lead(pos) OVER (PARTITION BY file_path ORDER BY seq) AS nxt FROM tok),
p AS (SELECT file_path, count(*) FILTER (WHERE nxt = 'NOUN') / count(*) AS p FROM n WHERE pos = 'VERB' GROUP BY file_path)
SELECT file_path, coalesce(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END, 0)::DOUBLE AS conditional_entropy FROM files LEFT JOIN p USING (file_path)""",
    "semantic_density": f"WITH {TOKENS} SELECT file_path, count(DISTINCT lemma) AS lemmas, max(line) AS last_line, count(DISTINCT lemma) / max(line) AS semantic_density FROM tok WHERE NOT is_stop GROUP BY file_path",
    "module_metrics": f"""WITH {TOKENS}, e AS ({_entropy('file_path')}),
m AS (SELECT file_path, count(*) AS token_count, count(DISTINCT lemma) FILTER (WHERE NOT is_stop) AS unique_tokens, count(*) FILTER (WHERE pos = 'NOUN') AS nouns,
 count(*) FILTER (WHERE pos = 'NOUN' AND contains(text, '_') AND NOT starts_with(text, '_')) AS snake, count(*) FILTER (WHERE pos = 'NOUN' AND regexp_matches(substr(text, 2), '\\p{{Lu}}')) AS camel,
 count(*) FILTER (WHERE pos = 'NOUN' AND regexp_matches(text, '^\\p{{Lu}}')) AS pascal, sum(length(text)) FILTER (WHERE pos = 'NOUN') AS letters FROM tok GROUP BY file_path),
l AS (SELECT file_path, count(*) AS lines_total, count(*) FILTER (WHERE trim(line_text, ' ') = '') AS lines_blank FROM lines GROUP BY file_path)
SELECT file_path, language, strlen(f.text)::BIGINT AS size_bytes, sha256(f.text) AS sha256, lines_total, lines_blank, token_count, unique_tokens, unique_tokens / greatest(token_count, 1) AS type_token_ratio, entropy AS semantic_entropy,
CASE WHEN snake / nouns > 0.5 THEN 'snake_case' WHEN pascal / nouns > 0.5 THEN 'PascalCase' WHEN camel / nouns > 0.3 THEN 'camelCase' ELSE 'none' END AS identifier_style, letters / nouns AS avg_identifier_length
FROM files f JOIN m USING (file_path) JOIN e USING (file_path) JOIN l USING (file_path)""",
    "scope_tokens": f"""WITH {TOKENS}, s AS (SELECT file_path, line, CASE WHEN contains(c, 'class ') OR contains(c, 'class_') THEN 'class' WHEN contains(c, 'def ') OR contains(c, 'function ') THEN 'function' WHEN contains(c, 'import ') OR contains(c, 'using ') THEN 'module' ELSE 'local' END AS scope
FROM (SELECT file_path, line, string_agg(line_text, chr(10)) OVER (PARTITION BY file_path ORDER BY line ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM lines))
SELECT language, scope, count(*) AS n, sum(instr(line_text, text) - 1)::BIGINT AS column_sum FROM tok JOIN s USING (file_path, line) GROUP BY ALL""",
    "syntagmas": f"""WITH {TOKENS}, i AS (SELECT file_path, seq, text, lemma, pos, sum((pos <> 'NOUN')::INT) OVER (PARTITION BY file_path ORDER BY seq) AS island FROM tok)
SELECT file_path, min(seq) AS start_seq, string_agg(text, ' ' ORDER BY seq) AS text, string_agg(lemma, ' ' ORDER BY seq) AS lemmas, count(DISTINCT lemma) / count(*) AS semantic_density FROM i GROUP BY file_path, island HAVING count(*) > 1 AND arg_min(pos, seq) = 'VERB'""",
    "corpus_stats": f"WITH {TOKENS} SELECT count(DISTINCT file_path) AS files, count(*) AS tokens, count(DISTINCT lemma) AS lemmas, count(DISTINCT language) AS languages FROM tok",
    "directory_groups": """WITH f AS (SELECT source AS directory, doc_id || '.' || lang AS name FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY name) AS i, count(*) OVER (PARTITION BY directory) AS files FROM f)
SELECT directory, files, string_agg(name, ' ' ORDER BY i) AS names FROM n WHERE i <= 3 GROUP BY directory, files ORDER BY directory LIMIT 3""",
    "language_distribution": f"WITH {FILES} SELECT language, count(*) AS files FROM files GROUP BY language",
    "content_language": "SELECT extension, count(*) AS files, count(*) / sum(count(*)) OVER () AS share FROM (SELECT CASE " + " ".join("WHEN " + f"regexp_matches(html, '(?im)(?:{'|'.join(p).replace(chr(39), chr(39) * 2)})')" + f" THEN '{e}'" for e, p in L.CONTENT_RULES.items()) + " ELSE '.unknown' END AS extension FROM pages) GROUP BY extension",
}
