"""URL filter with redirect equivalence: block decisions spread over connected pages, an explicit allow goes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import components, lower_ascii

#: The rules of the registered query: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without a host's ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Ties go to the rule that sorts first.

    The rules are configuration that the driver holds; they become one expression of the plan.
    """
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules: join them as a table instead")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _node(url: Column) -> Column:
    """An address as a vertex: host lower-cased, without its fragment; null where it has no ://."""
    scheme = F.substring_index(url, "://", 1)
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(lower_ascii(scheme), F.lit("://"), host(url), tail))


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) from each page's address to its canonical address and to those it refreshes to, as its html states them."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), 0)
    canonical = F.filter(tags, lambda t: t.rlike(r"(?i)^<link") & t.rlike(r"""(?i)[\s"']rel\s*=\s*["']?canonical["'\s>/]"""))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?i)^<meta") & t.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh["'\s>/]"""))
    to = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?i)[\s"']href\s*=\s*["']?([^"'\s>]+)""", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?i)url\s*=\s*["']?([^"'\s>]+)""", 1)),
    )
    has = F.col("html").rlike("(?i)canonical|refresh") & F.col("url").contains("://")
    rows = pages.where(has).select("url", F.explode(to).alias("to")).where("to <> ''")
    scheme, base = F.substring_index("url", "://", 1), F.concat(F.substring_index("url", "://", 1), F.lit("://"), host(F.col("url")))
    t = F.col("to")
    absolute = (
        F.when(t.contains("://"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(base, t))
        .otherwise(F.concat(base, F.regexp_replace(path(F.col("url")), r"[^/]*$", ""), F.when(path(F.col("url")) == "", "/").otherwise(""), t))
    )
    return rows.select(_node(F.col("url")).alias("a"), _node(absolute).alias("b"))


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """A verdict for each row of pages (page_id, url, html).

    A page's own longest rule decides; else, over all addresses that redirects and canonical links connect with it, an
    allow goes before a block; else the page is allowed. edges (a, b: addresses) adds known redirects to those in html.
    Null or broken urls have empty host and path and are allowed; null html has no links; repeated rows are judged each;
    an empty table gives none. Other columns of pages are ignored.

    The component search runs over addresses that have links only, natively and in logarithmically many rounds.
    """
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), _node(F.col("url")).alias("address"))
    found = link_edges(pages)
    if edges is not None:
        found = found.unionByName(edges.select(_node(F.col("a")).alias("a"), _node(F.col("b")).alias("b")))
    member = components(found)
    own = matching_rule(host(F.col("id")), path(F.col("id")), rules)["verdict"]
    root = member.groupBy("root").agg(F.max(F.coalesce(own == "allow", F.lit(False))).alias("has_allow"), F.max(F.coalesce(own == "block", F.lit(False))).alias("has_block"))
    spread = member.join(root, "root").select(F.col("id").alias("address"), F.col("root").alias("alias_of"), "has_allow", "has_block")
    rows = rows.join(spread, "address", "left").withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    return rows.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(F.col("has_allow"), "allow").when(F.col("has_block"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("alias_of", "address").alias("alias_of"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, html, rest,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    CASE WHEN instr(url, '://') > 0 THEN translate(split_part(url, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://'
      || translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS address FROM p),
t AS (SELECT address AS a, url, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM h WHERE url LIKE '%://%'),
l AS (SELECT a, url, host, path, CASE WHEN regexp_matches(tag, '(?i)^<link') THEN regexp_extract(tag, '(?i)[\s"'']href\s*=\s*["'']?([^"''\s>]+)', 1)
    ELSE regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1) END AS target FROM t
  WHERE (regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)[\s"'']rel\s*=\s*["'']?canonical["''\s>/]'))
     OR (regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh["''\s>/]'))),
f AS (SELECT a, CASE WHEN target LIKE '%://%' THEN target WHEN target LIKE '//%' THEN split_part(url, '://', 1) || ':' || target
    WHEN target LIKE '/%' THEN split_part(url, '://', 1) || '://' || host || target
    ELSE split_part(url, '://', 1) || '://' || host || regexp_replace(path, '[^/]*$', '') || CASE WHEN path = '' THEN '/' ELSE '' END || target END AS u FROM l WHERE target <> ''),
e0 AS (SELECT a, translate(split_part(u, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://'
    || translate(regexp_extract(substr(u, instr(u, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(substr(u, instr(u, '://') + 3), '^[^/?#]*([^#]*)', 1) AS b FROM f),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
reach AS (SELECT a AS x, a AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
addr AS (SELECT DISTINCT y, translate(regexp_extract(substr(y, instr(y, '://') + 3), '^[^/?#]*'), 'A', 'a') AS host, regexp_extract(substr(y, instr(y, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
ar AS (SELECT y, arg_max(verdict, length(h || p)) AS verdict FROM addr JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY y),
g AS (SELECT x, min(y) AS alias_of, bool_or(coalesce(verdict = 'allow', false)) AS has_allow, bool_or(coalesce(verdict = 'block', false)) AS has_block FROM reach LEFT JOIN ar USING (y) GROUP BY x),
r AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS own FROM h JOIN rules ON (host = rules.h OR host LIKE '%.' || rules.h) AND starts_with(path, p) GROUP BY page_id)
SELECT h.page_id, h.host, h.path, r.rule, coalesce(own, CASE WHEN has_allow THEN 'allow' WHEN has_block THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(alias_of, address) AS alias_of
FROM h LEFT JOIN r USING (page_id) LEFT JOIN g ON h.address = g.x
"""
