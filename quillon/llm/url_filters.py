"""URL filters: rules on host and path, spread to aliases over redirect and canonical-link edges.

Everything is DataFrame expressions. A rule decides the pages it fits. Other pages take the decision of
their alias group: the connected component, over edges that pages declare by <link rel="canonical"> and
<meta http-equiv="refresh">, as pages write them, but for fragments and the case of schemes and hosts. No other addresses are taken as the same. A group with a blocked address and no
explicitly allowed one is blocked; an explicit allow anywhere in the group takes precedence; a group
without any decision is allowed. Links are seen from a page's <base href>, where that is absolute, else from its address.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is allowed;
a null or empty html declares no edges; repeated rows give repeated results; an empty table gives an empty
table; columns of the input other than page_id, url and html are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bind
from quillon.llm.components import connected_components
from quillon.session import checkpointed

#: The rules of the registered query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: An address that a page names as the base of its links; one that is not absolute is left out.
BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'>\s]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def compile_rules(rules, host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of two as long, allow goes first.

    The rules are configuration, not data: they become one expression, longest first.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def address(url: Column) -> Column:
    """An address as it is, but for the case of its scheme and host and its fragment; null where there is no host."""
    scheme = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(.*?)://", 1), _UPPER, _LOWER)
    host, rest = host_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def _resolved(link: Column, base: Column) -> Column:
    """link as an absolute address, seen from base."""
    return bind(F.trim(F.regexp_replace(link, "&amp;", "&")), lambda l: bind(base, lambda b: _absolute(l, b)))


def _absolute(link: Column, base: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, r"://([^/?#]*)", 1))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(link == "", F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(left, right): a page's address and each address it names as the same page."""
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)(<(?:link|meta)\b[^>]*\b(?:canonical|refresh)\b[^>]*>)"), F.lit(1))
    tag = F.col("tag")
    href = F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'>\s]+)""", 1)
    refresh = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'>\s;]+)""", 1)
    target = F.when(tag.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"), href).when(tag.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), refresh)
    return (
        pages.filter(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh"))
        .select("url", F.regexp_extract("html", BASE, 1).alias("base"), F.explode(tags).alias("tag"))
        .select("url", F.when(F.col("base").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("base")).otherwise(F.col("url")).alias("base"), target.alias("link"))
        .filter(F.coalesce(F.col("link"), F.lit("")) != "")
        .select("url", _resolved(F.col("link"), F.col("base")).alias("target"))
    )


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    host, path = F.col("host"), F.col("path")
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = parsed.withColumn("own", compile_rules(rules, host, path))

    # html is read once; the written edges also keep the parsing out of the plans below
    named = checkpointed(alias_edges(pages.select("url", "html")))
    groups = connected_components(named.select(address(F.col("url")).alias("left"), address(F.col("target")).alias("right")), "left", "right")
    # decisions of addresses that take part in an edge: pages, and targets that are no pages themselves
    sites = named.select("url").unionAll(named.select(F.col("target").alias("url")))
    decided = sites.unionAll(parsed.select("url")).filter(F.col("url").isNotNull()).select(
        address(F.col("url")).alias("node"), compile_rules(rules, host_of(F.col("url")), path_of(F.col("url")))["verdict"].alias("verdict")
    )
    decided = decided.filter("node IS NOT NULL AND verdict IS NOT NULL").groupBy("node").agg(
        F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"), F.max((F.col("verdict") == "block").cast("int")).alias("blocked")
    )
    spread = (
        groups.join(decided, "node")
        .groupBy("component")
        .agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
        .filter("blocked = 1 AND allowed = 0")
        .select("component")
    )
    blocked = groups.join(spread, "component").select("node", F.lit(True).alias("by_alias"))
    return (
        own.withColumn("node", address(F.col("url")))
        .join(blocked, "node", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("own")["rule"].alias("rule"),
            F.coalesce(F.col("own")["verdict"], F.when(F.col("by_alias"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        )
    )


def _sql() -> str:
    host = lambda c: f"translate(regexp_extract(coalesce({c}, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    path = lambda c: f"regexp_extract(coalesce({c}, ''), '://[^/?#]*([^?#]*)', 1)"
    scheme_of = lambda c: f"translate(regexp_extract(coalesce({c}, ''), '^(.*?)://', 1), '{_UPPER}', '{_LOWER}')"
    rest = lambda c: f"regexp_extract(coalesce({c}, ''), '://[^/?#]*([^#]*)', 1)"

    def form(c: str) -> str:
        return f"CASE WHEN {host(c)} <> '' THEN {scheme_of(c)} || '://' || {host(c)} || CASE WHEN starts_with({rest(c)}, '/') THEN {rest(c)} ELSE '/' || {rest(c)} END END"

    def rule(c: str, want: int) -> str:
        whens = " ".join(
            f"WHEN ({host(c)} = '{h}' OR ends_with({host(c)}, '.{h}')) AND starts_with({path(c)}, '{p}') THEN '{(h + p, v)[want]}'"
            for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
        )
        return f"CASE {whens} END"

    scheme = "regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"
    root = f"{scheme} || '://' || regexp_extract(base, '://([^/?#]*)', 1)"
    folder = f"regexp_replace({path('base')}, '[^/]*$', '')"
    quoted = BASE.replace("'", "''")
    return f"""
WITH RECURSIVE tags AS (
  SELECT url, regexp_extract(html, '{quoted}', 1) AS own_base,
         unnest(regexp_extract_all(html, '(?is)(<(?:link|meta)\\b[^>]*\\b(?:canonical|refresh)\\b[^>]*>)', 1)) AS tag
  FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
links AS (SELECT url, CASE WHEN regexp_matches(own_base, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN own_base ELSE url END AS base, trim(replace(
  CASE WHEN regexp_matches(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b')
            THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''>\\s]+)', 1)
       WHEN regexp_matches(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
            THEN regexp_extract(tag, '(?is)\\bcontent\\s*=\\s*["'']?[^"''>]*?\\burl\\s*=\\s*["'']?([^"''>\\s;]+)', 1) END, '&amp;', '&')) AS link FROM tags),
named AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN {scheme} || ':' || link
    WHEN starts_with(link, '/') THEN {root} || link
    ELSE {root} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || link END AS target
  FROM links WHERE coalesce(link, '') <> ''),
e AS (SELECT DISTINCT {form('url')} AS a, {form('target')} AS b FROM named),
both_ways AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
reach(node, other) AS (SELECT a, b FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a),
sites AS (SELECT url FROM named UNION SELECT target FROM named UNION SELECT url FROM pages),
decided AS (SELECT {form('url')} AS node, {rule('url', 1)} AS verdict FROM sites WHERE url IS NOT NULL),
blocked AS (SELECT r.node FROM reach r JOIN decided d ON d.node = r.other WHERE d.verdict IS NOT NULL
            GROUP BY r.node HAVING bool_or(d.verdict = 'block') AND NOT bool_or(d.verdict = 'allow'))
SELECT page_id, {host('url')} AS host, {path('url')} AS path, {rule('url', 0)} AS rule,
       coalesce({rule('url', 1)}, CASE WHEN {form('url')} IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages"""


SQL = _sql()
