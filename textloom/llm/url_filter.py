"""URL rules with redirect equivalence.

A rule fits its host and all subdomains where the path starts with the rule's path; the longest rule
wins. Redirects (meta refresh) and canonical links make urls aliases: connected components over these
edges are found on the cluster, and a url without a rule of its own takes its component's verdict,
where an explicit allow goes before any block. Without either it is allowed.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, is no alias
of anything and is allowed; null html has no edges; every canonical and refresh tag of a page counts; entities
in targets are decoded; relative targets are resolved as RFC 3986 says, with dot segments removed, but other
schemes without ``://`` are no edges; repeated urls are one node, each row is judged; an empty table gives an empty
result; other columns are ignored. Rules are a fixed, short list.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.components import connected_components
from textloom.scratch import materialize

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ``rel`` holds canonical among its words, quoted or not.
_CANONICAL = r"\brel\s*=\s*(?:\"(?:[^\">]*\s)?canonical[\s\"]|'(?:[^'>]*\s)?canonical[\s']|canonical(?![^\s>/]))"
_LINK = rf"(?i)<link\b(?=[^>]*{_CANONICAL})[^>]*\bhref\s*=\s*[\"']?([^\"'>\s]+)"
_REFRESH = r"(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*['\"]?([^\"'>\s]+)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def decoded(text: Column) -> Column:
    """With character references that end in a semicolon replaced, decimal, hexadecimal and named ones."""
    named = F.from_json(F.lit(json.dumps({f"&{k}": v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")
    pieces = F.regexp_extract_all(text, F.lit(r"&#?[A-Za-z0-9]+;|[^&]+|&"), F.lit(0))

    def one(x: Column) -> Column:
        code = F.regexp_extract(x, r"^&#0*([0-9]{1,7});$", 1)
        digits = F.when(code != "", F.conv(code, 10, 16)).otherwise(F.upper(F.regexp_extract(x, r"^&#[xX]0*([0-9A-Fa-f]{1,6});$", 1)))
        fits = digits.rlike("^([0-9A-F]{1,3}|[0-9A-CE-F][0-9A-F]{3}|D[0-7][0-9A-F]{2}|[1-9A-F][0-9A-F]{4}|10[0-9A-F]{4})$")
        return F.when(~x.startswith("&"), x).when(fits, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")).otherwise(F.coalesce(F.try_element_at(named, x), x))

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path that starts with a slash (or is empty) without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    closed = F.when(path.rlike(r"/\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """Urls that differ only in the case of the host, in dot segments or in the fragment are one node; null without a host."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), without_dots(path_of(url)), query))


def resolved(to: Column, page: Column) -> Column:
    """A target as a whole url; null for one with a scheme but without ``://``. Dot segments stay, ``node_of`` removes them."""
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(page))
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(page), r"^(.*/)", 1), F.lit("")), F.lit("/"))
    full = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
    full = full.when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(to.startswith("/"), F.concat(site, to))
    return full.when(to.startswith("#"), page).when(to.startswith("?"), F.concat(site, path_of(page), to)).otherwise(F.concat(site, folder, to))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's node and the nodes its canonical links and refreshes name."""
    page = F.col(url)
    targets = F.concat(*[F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(1)) for tag in (_LINK, _REFRESH)])
    # one transform a step, so that no step's expression is repeated inside the next
    full = F.transform(F.transform(targets, decoded), lambda to: resolved(to, page))
    raw = pages.where(page.isNotNull() & F.col(html).isNotNull()).select(page.alias("page"), F.explode(full).alias("full"))
    return raw.select(node_of(F.col("page")).alias("a"), node_of(F.col("full")).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict). ``redirects``: further edges as (from_url, to_url)."""
    edges = page_edges(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))))
    edges = materialize(edges.distinct(), "alias")
    u = F.col(url)
    narrow = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node"))
    judged = narrow.withColumn("__own", rule_of(F.col("host"), F.col("path"), rules))
    groups = connected_components(edges)
    # every url of a component counts, whether it is a page or only a target
    own = groups.select("node", "component", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules).alias("__rule"))
    verdicts = own.groupBy("component").agg(F.max(F.when(F.col("__rule.verdict") == "allow", 2).when(F.col("__rule.verdict") == "block", 1).otherwise(0)).alias("__v"))
    alias = materialize(own.join(verdicts, "component").select("node", "__v"), "alias")
    out = judged.join(alias, "node", "left")
    verdict = F.coalesce(F.col("__own.verdict"), F.when(F.col("__v") == 1, F.lit("block")).otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("__own.rule").alias("rule"), verdict.alias("verdict"))
