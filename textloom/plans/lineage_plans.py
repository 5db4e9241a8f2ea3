"""Registered style, network and lineage queries, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import lexicon as L
from textloom.functions import similarity as S
from textloom.operators import between as B
from textloom.operators import cells as K
from textloom.operators import corpus_queries as Q
from textloom.operators import graph as G
from textloom.operators import lineage as N
from textloom.operators import measures as M
from textloom.operators import style as Y
from textloom.plans.corpus_sql import ORACLE, TOKENS, WORD
from textloom.scratch import materialize
from textloom.sources import corpus as C

EVENT_ROLES = {"view": "accessor", "click": "mutator", "error": "validator", "signup": "factory", "purchase": "dispatcher"}


def _documents(query):
    return lambda spark, sf_dir: query(C.document_files(spark, sf_dir))


def _network(query):
    """Over all pairs that occur together. The edges are written once, as the measures read them several times."""
    return lambda spark, sf_dir: query(materialize(G.cooccurrence(C.document_files(spark, sf_dir), 5), "network"))


def _numbered(query, by_edges, fits=lambda net: net.fits):
    """Over the same pairs as numbers in cells; by joins of edges for more nodes than a vector in memory should have, or where ``fits`` says no."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        net = K.Network(C.document_files(spark, sf_dir), 5)
        return query(net) if fits(net) else _network(by_edges)(spark, sf_dir)

    return run


def _functions(query):
    return lambda spark, sf_dir: query(C.conversation_functions(spark, sf_dir))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events")
    role = None
    for kind, name in EVENT_ROLES.items():
        role = F.when(F.col("event_type") == kind, name) if role is None else role.when(F.col("event_type") == kind, name)
    return N.role_sequences(e.select("user_id", "ts", "event_id", role.alias("role")), "user_id", ["ts", "event_id"])


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.concat_ws(" ", "event_type", "props").alias("text"))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("language"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct lower-cased ASCII words of over two letters, as identifiers."""
    words = C.table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name"))
    return words.where(F.col("name").rlike("^[a-z]{3,}$")).distinct()


def levenshtein_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names, 25 of them."""
    n = C.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    p = n.alias("a").join(n.alias("b"), F.col("a.name") < F.col("b.name")).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
    return p.select("*", F.levenshtein("name_a", "name_b").alias("distance"), S.edit_ratio_short(F.col("name_a"), F.col("name_b")).alias("ratio"))


def _source_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lemma_counts(C.document_files(spark, sf_dir), "author").where("not is_stop").select("author", "lemma", F.col("freq").alias("n"))


def _source_pairs(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    """Sources as files: shared lemmas are found by an equi-join, never source by source."""
    bags = materialize(_source_bags(spark, sf_dir), "bags")  # read four times below
    sizes = bags.groupBy("author").agg(F.count("*").alias("size"), F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    met = bags.alias("x").join(bags.alias("y"), (F.col("x.lemma") == F.col("y.lemma")) & (F.col("x.author") < F.col("y.author")))
    by = met.groupBy(F.col("x.author").alias("author_a"), F.col("y.author").alias("author_b")).agg(F.count("*").alias("shared"), F.sum(F.col("x.n") * F.col("y.n")).cast("double").alias("dot"))
    p = by.join(sizes.toDF("author_a", "size_a", "norm_a"), "author_a").join(sizes.toDF("author_b", "size_b", "norm_b"), "author_b")
    if measure == "jaccard":
        return p.select("author_a", "author_b", (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("jaccard"))
    return p.select("author_a", "author_b", S.cosine(F.col("dot"), F.col("norm_a"), F.col("norm_b")).alias("cosine"))


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conversation_functions(spark, sf_dir).select("qualified_name", N.normalize_type1(F.col("source_code")).alias("normalized"))


def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir).select("qualified_name", N.alpha_rename("normalized").alias("renamed"))


QUERIES = {
    "mfw_author": _documents(Y.frequent_by_author),
    "author_profile": _documents(Y.author_profile),
    "delta_pairs": _documents(Y.delta_distances),
    "lexical_complexity": _documents(Y.lexical_complexity),
    "mtld": _documents(Y.mtld),
    "information_profile": _documents(Y.information_profile),
    "kolmogorov_files": _functions(Y.kolmogorov_proxy),
    "vocabulary_growth": lambda spark, sf_dir: Y.vocabulary_growth(_dated(spark, sf_dir)),
    "abstraction_trend": lambda spark, sf_dir: Y.abstraction_trend(_classes(spark, sf_dir)),
    "cooccurrence_edges": _documents(lambda f: G.cooccurrence(f, 5)),
    "degree_centrality": _numbered(K.degree, G.degree),
    "clustering": _numbered(K.clustering, G.clustering),
    "components": _numbered(K.components, G.communities),
    "pagerank_fixed_iter": _numbered(lambda net: K.pagerank(net, 5), lambda e: G.pagerank(e, 5)),
    "eigenvector_fixed_iter": _numbered(lambda net: K.eigenvector(net, 5), lambda e: G.eigenvector(e, 5)),
    "betweenness": _numbered(B.betweenness, G.betweenness, B.fits),
    "key_concepts": _numbered(B.key_concepts, G.key_concepts, B.fits),
    "call_edges": _functions(G.call_edges),
    "levenshtein_names": levenshtein_names,
    "jaccard_files": lambda spark, sf_dir: _source_pairs(spark, sf_dir, "jaccard"),
    "cosine_files": lambda spark, sf_dir: _source_pairs(spark, sf_dir, "cosine"),
    "role_sequences": lambda spark, sf_dir: _sequences(spark, sf_dir).select("user_id", F.array_join("roles", " ").alias("roles")),
    "lcs_roles": lambda spark, sf_dir: N.pipeline_scores(_sequences(spark, sf_dir), "user_id"),
    "canonical_patterns": lambda spark, sf_dir: N.canonical_patterns(_sequences(spark, sf_dir), "user_id"),
    "normalize_type1": _normalised,
    "alpha_rename": _renamed,
    "clone_candidates": _functions(N.clone_candidates),
    "clone_matches": _functions(N.clone_matches),
    "file_similarity_pairs": _functions(N.file_similarity),
    "pdg_signature": _functions(N.pdg_signatures),
    "identifier_families": lambda spark, sf_dir: N.identifier_families(_names(spark, sf_dir)),
    "lineage_verdicts": _functions(N.lineage_verdicts),
}

_COOC = f"""{TOKENS}, c AS (SELECT file_path, lemma, row_number() OVER (PARTITION BY file_path ORDER BY seq) AS i FROM tok WHERE NOT is_stop),
edges AS (SELECT least(x.lemma, y.lemma) AS a, greatest(x.lemma, y.lemma) AS b, count(*) AS weight FROM c x JOIN c y ON x.file_path = y.file_path AND y.i BETWEEN x.i + 1 AND x.i + 5 AND x.lemma <> y.lemma GROUP BY ALL),
two AS (SELECT a, b, weight FROM edges UNION ALL SELECT b, a, weight FROM edges)"""
_ROLES = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_ROLES.items()) + " END"
_SEQ = f"""s AS (SELECT user_id, ts, event_id, {_ROLES} AS role FROM events), w AS (SELECT *, lag(role) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM s WHERE role IS NOT NULL)"""
_BAGS = f"{TOKENS}, bag AS (SELECT author, lemma, count(*) AS n FROM tok WHERE NOT is_stop GROUP BY author, lemma), sz AS (SELECT author, count(*) AS size, sqrt(sum(n * n)::DOUBLE) AS norm FROM bag GROUP BY author)"
_PAIRS = "p AS (SELECT x.author AS author_a, y.author AS author_b, count(*) AS shared, sum(x.n * y.n)::DOUBLE AS dot FROM bag x JOIN bag y ON x.lemma = y.lemma AND x.author < y.author GROUP BY ALL)"


def _domain_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({t}), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{d}'" for d, ws in L.DOMAIN_WORDS.items()) + " ELSE 'domain' END"


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT a AS node, 1.0::DOUBLE / (SELECT count(*) FROM o) AS rank FROM o)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS (SELECT sh.b AS node, 0.15 / (SELECT count(*) FROM o) + 0.85 * sum(r{i}.rank * sh.share) AS rank FROM sh JOIN r{i} ON sh.a = r{i}.node GROUP BY sh.b)")
    return f"WITH {_COOC}, o AS (SELECT a, sum(weight) AS total FROM two GROUP BY a), sh AS (SELECT two.a, two.b, weight / total AS share FROM two JOIN o ON two.a = o.a), {', '.join(steps)} SELECT node, rank FROM r{rounds}"


ORACLE_SQL = {
    "author_profile": f"""SELECT source AS author, count(*) AS files, sum(token_count)::BIGINT AS tokens, avg(avg_identifier_length) AS mean_identifier_length, avg(type_token_ratio) AS mean_type_token_ratio,
count(*) FILTER (WHERE identifier_style = 'snake_case') AS snake_files, count(*) FILTER (WHERE identifier_style = 'PascalCase') AS pascal_files, count(*) FILTER (WHERE identifier_style = 'camelCase') AS camel_files
FROM ({ORACLE['module_metrics']}) m JOIN documents ON file_path = source || '/' || doc_id || '.' || lang GROUP BY source""",
    "mfw_author": f"WITH {TOKENS} SELECT author, lemma, freq, rank FROM (SELECT author, lemma, count(*) AS freq, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, lemma) AS rank FROM tok WHERE NOT is_stop GROUP BY author, lemma) WHERE rank <= 50",
    "delta_pairs": f"""WITH {TOKENS}, top AS (SELECT lemma FROM tok WHERE NOT is_stop GROUP BY lemma ORDER BY count(*) DESC, lemma LIMIT 50), sz AS (SELECT author, count(*) AS size FROM tok GROUP BY author),
f AS (SELECT sz.author, top.lemma, (SELECT count(*) FROM tok t WHERE NOT t.is_stop AND t.author = sz.author AND t.lemma = top.lemma) / size AS f FROM sz, top),
z AS (SELECT author, lemma, CASE WHEN stddev_pop(f) OVER w > 0 THEN (f - avg(f) OVER w) / stddev_pop(f) OVER w ELSE 0 END AS z FROM f WINDOW w AS (PARTITION BY author))
SELECT x.author AS author_a, y.author AS author_b, avg(abs(x.z - y.z)) AS delta FROM z x JOIN z y ON x.lemma = y.lemma AND x.author < y.author GROUP BY ALL""",
    "lexical_complexity": f"WITH {TOKENS} SELECT file_path, count(*) AS total, count(DISTINCT lemma) AS types, count(DISTINCT lemma) / count(*) AS ttr FROM tok WHERE NOT is_stop GROUP BY file_path",
    "vocabulary_growth": f"""WITH w AS (SELECT date_trunc('day', ts) AS bucket, unnest(regexp_extract_all(concat_ws(' ', event_type, props), '{WORD}')) AS word FROM events), f AS (SELECT word, min(bucket)::TIMESTAMP AS bucket FROM w GROUP BY word)
SELECT bucket, count(*) AS new_words, sum(count(*)) OVER (ORDER BY bucket)::BIGINT AS vocabulary FROM f GROUP BY bucket""",
    "abstraction_trend": f"SELECT p_brand AS language, count(*) FILTER (WHERE d IN ('entity', 'service')) AS abstract_classes, count(*) AS classes, count(*) FILTER (WHERE d IN ('entity', 'service')) / count(*) AS share FROM (SELECT p_brand, {_domain_sql('p_name')} AS d FROM part) GROUP BY p_brand",
    "cooccurrence_edges": f"WITH {_COOC} SELECT * FROM edges",
    "degree_centrality": f"WITH {_COOC}, d AS (SELECT a AS node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM two GROUP BY a) SELECT *, degree / (count(*) OVER () - 1) AS degree_centrality FROM d",
    "clustering": f"""WITH {_COOC}, d AS (SELECT a AS node, count(*) AS degree FROM two GROUP BY a),
t AS (SELECT x.a AS node, count(*) AS triangles FROM two x JOIN two y ON x.a = y.a AND x.b < y.b JOIN edges e ON e.a = x.b AND e.b = y.b GROUP BY x.a)
SELECT node, degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END::DOUBLE AS clustering FROM d LEFT JOIN t USING (node)""",
    "components": f"""WITH RECURSIVE {_COOC}, r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM two UNION
SELECT two.b, min(r.component) FROM r JOIN two ON two.a = r.node JOIN recurring.r known ON known.node = two.b WHERE r.component < known.component GROUP BY two.b) SELECT node, component FROM r""",
    "pagerank_fixed_iter": _pagerank_sql(5),
    "levenshtein_names": "SELECT a.n_name AS name_a, b.n_name AS name_b, levenshtein(a.n_name, b.n_name)::INT AS distance, 1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)) AS ratio FROM nation a JOIN nation b ON a.n_name < b.n_name",
    "jaccard_files": f"WITH {_BAGS}, {_PAIRS} SELECT author_a, author_b, shared / (x.size + y.size - shared) AS jaccard FROM p JOIN sz x ON author_a = x.author JOIN sz y ON author_b = y.author",
    "cosine_files": f"WITH {_BAGS}, {_PAIRS} SELECT author_a, author_b, dot / (x.norm * y.norm) AS cosine FROM p JOIN sz x ON author_a = x.author JOIN sz y ON author_b = y.author",
    "role_sequences": f"WITH {_SEQ} SELECT user_id, string_agg(role, ' ' ORDER BY ts, event_id) AS roles FROM w WHERE was IS NULL OR was <> role GROUP BY user_id",
    "clone_candidates": f"""WITH f AS (SELECT conv_id * 1000 + turn AS id, floor(4 * ln(1 + len(regexp_extract_all(text, '{WORD}'))))::INT AS k FROM conversations WHERE len(regexp_extract_all(text, '{WORD}')) >= 12)
SELECT x.id AS id_a, y.id AS id_b FROM f x JOIN f y ON x.id < y.id AND abs(x.k - y.k) <= 2""",
    "call_edges": r"""WITH f AS (SELECT conv_id, role AS name, conv_id || '.' || turn AS q, turn, unnest(list_distinct(regexp_extract_all(text, '\b([A-Za-z_][\p{L}\p{N}_]*)\s*\(', 1))) AS called FROM conversations),
n AS (SELECT conv_id, role AS called, arg_min(conv_id || '.' || turn, turn) AS callee FROM conversations GROUP BY ALL)
SELECT DISTINCT q AS caller, callee FROM f JOIN n USING (conv_id, called)""",
}
