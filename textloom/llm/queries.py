"""Registered queries of the training-data operators, each over its whole table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import language_id, line_dedup, media, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.measures(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies", "source")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_repeated(_table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "chunks_removed", "bytes_removed", F.col("cleaned").alias("text"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents")).withColumn("tile", F.hex("tile"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_media_columns": op2_media_columns,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_url_filters": op8_url_filters,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
}

_WS = r"[ \t\n\x0b\f\r]"

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
k AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS gram FROM g),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM k) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY rid),
l AS (SELECT rid, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]') GROUP BY rid),
b AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0b\f\r]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(l.lines, 0)::BIGINT AS n_lines
      FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
q AS (SELECT source, unnest([{'rule': 'few_words', 'bad': n_words < 10}, {'rule': 'repeats', 'bad': 100 * n_repeat_words > 20 * n_words},
        {'rule': 'symbols', 'bad': 10 * n_symbols > n_words}, {'rule': 'lines', 'bad': 10 * n_dup_lines > 3 * n_lines}]) AS x FROM f WHERE source IS NOT NULL),
h AS (SELECT source, x.rule AS rule, count(*) AS n, sum(x.bad::INT) AS k FROM q GROUP BY source, rule),
p AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM h GROUP BY rule),
c AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1e6) ELSE 1e6 END AS s FROM p),
r AS (SELECT source, rule, (k + m * s) / (n + s) AS rate FROM h JOIN c USING (rule)),
e AS (SELECT source, max(rate) FILTER (WHERE rule = 'few_words') AS few_words_rate, max(rate) FILTER (WHERE rule = 'repeats') AS repeats_rate,
        max(rate) FILTER (WHERE rule = 'symbols') AS symbols_rate, max(rate) FILTER (WHERE rule = 'lines') AS lines_rate FROM r GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(greatest(few_words_rate, repeats_rate, symbols_rate, lines_rate) > 0.5, false) AS kept, n_lines
FROM f LEFT JOIN e USING (source)
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+'))::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
s AS (SELECT source, source_size, CASE i % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM t),
a AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS total FROM s),
o AS (SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0) AS full_before,
        sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
      FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - full_before) / open_weight, source_size / weight) FILTER (WHERE weight * ((total - full_before) / open_weight) < 2.0 * source_size) AS level FROM o, a),
x AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(2.0 * source_size, weight * coalesce(level, 1e300)) END::DOUBLE AS target FROM s, l),
y AS (SELECT d.doc_id, d.size, x.source_size, x.target, CASE WHEN x.source_size > 0 THEN x.target / x.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM y
"""

def _after_scheme(u: str) -> str:
    return f"CASE WHEN instr(coalesce({u}, ''), '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"


def _host(u: str) -> str:
    return f"translate(regexp_extract({_after_scheme(u)}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(u: str) -> str:
    return f"regexp_extract({_after_scheme(u)}, '^[^/?#]*([^?#]*)', 1)"


_RULED = """CASE WHEN {h} = 'example.net' AND starts_with({p}, '/en/') OR ends_with({h}, '.example.net') AND starts_with({p}, '/en/') THEN 'example.net/en/'
 WHEN ({h} = 'example.com' OR ends_with({h}, '.example.com')) AND starts_with({p}, '/de/') THEN 'example.com/de/'
 WHEN ({h} = 'org' OR ends_with({h}, '.org')) AND starts_with({p}, '/fr/') THEN 'org/fr/'
 WHEN ({h} = 'net' OR ends_with({h}, '.net')) AND starts_with({p}, '/') THEN 'net/' END"""
_VERDICT = "CASE WHEN {r} IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN {r} IS NOT NULL THEN 'block' END"

# decodes the references &amp; &lt; &gt; &quot; only; the operator decodes all
OP8_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {_host('url')} AS host, {_path('url')} AS path FROM pages),
c AS (SELECT page_id, url, host, path, {_RULED.format(h='host', p='path')} AS rule FROM p),
tags AS (SELECT url, host, path, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*')) AS tag FROM p WHERE url IS NOT NULL),
named AS (SELECT url, host, path, scheme, CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag || ' ', '(?i)\brel\s*=\s*("([^">]*\s)?canonical[\s"]|''([^''>]*\s)?canonical[\s'']|canonical[\s>/])')
      THEN regexp_extract(tag, '(?is)^.*\bhref\s*=\s*["'']?([^"''>\s]+)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')
      THEN regexp_extract(tag, '(?is)^.*\burl\s*=\s*["'']?([^"''>\s]+)', 1) ELSE '' END AS raw FROM tags),
target AS (SELECT url, host, path, scheme, replace(replace(replace(replace(raw, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM named WHERE raw <> ''),
whole AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN scheme || '://' || host || t WHEN starts_with(t, '#') THEN url
    WHEN starts_with(t, '?') THEN scheme || '://' || host || path || t
    ELSE scheme || '://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || t END AS t FROM target),
urls AS (SELECT url AS u FROM p WHERE url IS NOT NULL UNION SELECT t FROM whole WHERE t IS NOT NULL),
parts AS (SELECT u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {_host('u')} AS site, {_host('u')} AS host, {_path('u')} AS path,
    regexp_extract(u, '^[^?#]*(\?[^#]*)?', 1) AS query FROM urls),
dots AS (SELECT *, list_reduce(list_transform(string_split(path, '/')[2:], lambda x: [x]), lambda acc, x: CASE WHEN x[1] = '..' THEN acc[:-2] WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END, []::VARCHAR[]) AS kept FROM parts),
nodes AS (SELECT u, host, site || CASE WHEN regexp_matches(path, '/\.\.?(/|$)') THEN '/' || array_to_string(CASE WHEN regexp_matches(path, '/\.\.?$') THEN list_append(kept, '') ELSE kept END, '/') ELSE path END || query AS node FROM dots WHERE host <> ''),
edges AS (SELECT DISTINCT x.node AS a, y.node AS b FROM whole w JOIN nodes x ON x.u = w.url JOIN nodes y ON y.u = w.t WHERE x.node <> y.node),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
ends AS (SELECT DISTINCT a AS node, {_host('a')} AS host, {_path('a')} AS path FROM both_ways),
ruled AS (SELECT node, {_RULED.format(h='host', p='path')} AS rule FROM ends),
reach AS (SELECT node, {_VERDICT.format(r='rule')} AS verdict FROM ruled WHERE rule IS NOT NULL UNION SELECT e.b, r.verdict FROM reach r JOIN both_ways e ON e.a = r.node),
shared AS (SELECT node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM reach GROUP BY node)
SELECT c.page_id, c.host, c.path, c.rule, coalesce({_VERDICT.format(r='c.rule')}, s.verdict, 'allow') AS verdict
FROM c LEFT JOIN nodes n ON n.u = c.url LEFT JOIN shared s ON s.node = n.node
"""

OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS grams FROM d),
g AS (SELECT rid, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (SELECT x.rid AS a, y.rid AS b FROM g x JOIN g y ON x.gram = y.gram AND x.rid < y.rid GROUP BY x.rid, y.rid, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rid AS node, rid AS far FROM s UNION SELECT r.node, e.b FROM reach r JOIN ends e ON e.a = r.far)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT node, min(t.doc_id) AS component_id FROM reach JOIN s t ON t.rid = far GROUP BY node) c ON c.node = s.rid
"""

# CRC-32 by its table of 256 entries, made from the reversed polynomial
OP6_SQL = """
WITH crc AS (SELECT list(c ORDER BY i) AS entry FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda s: ('0x' || s)::UBIGINT) AS bytes,
    list_transform(range(17), lambda i: ('0x' || substr(md5('shard-1:' || i || ':' || coalesce('=' || doc_id, '')), 1, 12))::BIGINT) AS scores FROM documents),
k AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, x: xor(a >> 8, entry[((xor(a, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32,
    list_position(scores[1:16], list_max(scores[1:16]))::INT - 1 AS shard, list_position(scores, list_max(scores))::INT - 1 AS grown_shard FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM k
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op6_sharding": OP6_SQL,
    "op8_url_filters": OP8_SQL,
}
