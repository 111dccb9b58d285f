"""Operator 5, URL filters with redirect equivalence.

A URL is judged by the longest rule that fits its host (or a parent domain) and path.  URLs
without a rule take the decision of their aliases: canonical links and refresh redirects in the
pages (and any further redirect table) are edges between URLs, whose connected components are
found by distributed star rewrites.  In a component an explicit allow rule of any member outweighs
block rules; a URL's own rule always stands.  Without a rule anywhere the verdict is allow.

Defined cases: NULL URLs, and URLs without ``://``, have an empty host and path, no rule and no
aliases; NULL html has no links; repeated pages and links change nothing; an empty input gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import components, table, written

# fixed values: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def after_scheme(url):
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url):
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url):
    """Identity of a URL: its host, path and query; scheme and fragment do not matter."""
    key = F.concat(host_of(url), F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1))
    return F.when(F.length(host_of(url)) > 0, key)


def best_rule(host, path, rules=RULES):
    """The longest fitting rule as ``struct<size, rule, verdict>`` (a short list, so no join)."""
    fits = []
    for h, p, verdict in rules:
        ok = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        fits.append(F.when(ok, F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"),
                                        F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def resolved(link, host, path):
    """An absolute URL for a link found on a page."""
    return (F.when(F.locate("://", link) > 0, link)
            .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(F.lit("http://"), host, link))
            .otherwise(F.concat(F.lit("http://"), host, F.coalesce(
                F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/")), link)))


def page_links(pages: DataFrame) -> DataFrame:
    """Canonical and refresh links of the pages: ``source, target`` (URLs)."""
    low = F.lower("html")
    tags = (pages.where(F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("http-equiv")))
            .select("url", F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag")))
    link = (F.when(F.regexp_like("tag", F.lit(CANONICAL)), F.regexp_extract("tag", HREF, 1))
            .when(F.regexp_like("tag", F.lit(REFRESH)), F.regexp_extract("tag", TARGET, 1)))
    found = tags.select("url", link.alias("link")).where(F.length("link") > 0)
    return found.select(F.col("url").alias("source"),
                        resolved(F.col("link"), host_of(F.col("url")), path_of(F.col("url"))).alias("target"))


def alias_verdicts(links: DataFrame, rules=RULES) -> DataFrame:
    """``node, verdict`` of URLs in components with a rule; allow outweighs block."""
    edges = written(links.select(*[f(F.col(c)).alias(n) for c in ("source", "target") for f, n in (
        (node_of, c), (host_of, c + "_host"), (path_of, c + "_path"))])
        .where("source is not null and target is not null").distinct(), "alias-edges")
    roots = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    nodes = None
    for c in ("source", "target"):
        one = edges.select(F.col(c).alias("node"), F.col(c + "_host").alias("host"), F.col(c + "_path").alias("path"))
        nodes = one if nodes is None else nodes.unionByName(one)
    ruled = nodes.distinct().withColumn("own", best_rule(F.col("host"), F.col("path"), rules)["verdict"])
    member = roots.join(ruled.select("node", "own"), "node")
    said = member.groupBy("root").agg(F.min("own").alias("verdict"))  # 'allow' sorts before 'block'
    return roots.join(said.where("verdict is not null"), "root").select("node", "verdict")


def url_filter(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``redirects`` may add edges (``source, target`` URLs).  Only URLs' identities are shuffled; html
    is read once for its link tags.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    aliases = alias_verdicts(links, rules).withColumnsRenamed({"node": "_node", "verdict": "_alias"})
    url = F.col("url")
    judged = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"),
                          F.coalesce(path_of(url), F.lit("")).alias("path"), node_of(url).alias("_key"))
    judged = judged.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    # a page without a node gets a key of its own, so that such pages do not meet in one task
    key = F.coalesce("_key", F.concat(F.lit("\x00"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    out = judged.withColumn("_key", key).join(aliases, F.col("_key") == F.col("_node"), "left")
    return out.select("page_id", "host", "path", F.col("_best.rule").alias("rule"),
                      F.coalesce("_best.verdict", "_alias", F.lit("allow")).alias("verdict"))


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter(table(spark, sf_dir, "pages"))


def _sql_fit(alias: str) -> str:
    """The longest fitting rule of a row with host and path, as SQL."""
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return (f"SELECT arg_max(struct_pack(rule := h || p, verdict := v), length(h || p)) AS best FROM "
            f"(VALUES {rows}) r(h, p, v) WHERE ({alias}.host = h OR ends_with({alias}.host, '.' || h)) "
            f"AND starts_with({alias}.path, p)")


def _sql_parts(url: str) -> str:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    return (f"coalesce({host}, '') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path, "
            f"CASE WHEN length({host}) > 0 THEN {host} || regexp_extract({rest}, '^[^/?#]*([^#]*)', 1) END AS node")


ORACLE = rf"""
WITH RECURSIVE u AS (SELECT page_id, url, html, {_sql_parts('url')} FROM pages),
tags AS (SELECT host, path, node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM u),
links AS (SELECT host, path, node, CASE
    WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
    END AS link FROM tags),
absolute AS (SELECT node AS source, CASE WHEN strpos(link, '://') > 0 THEN link
    WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '/') THEN 'http://' || host || link
    ELSE 'http://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || link END AS url
    FROM links WHERE length(link) > 0),
ends AS (SELECT source, {_sql_parts('url')} FROM absolute),
edges AS (SELECT source AS a, node AS b FROM ends WHERE source IS NOT NULL AND node IS NOT NULL
    UNION SELECT node, source FROM ends WHERE source IS NOT NULL AND node IS NOT NULL),
reach AS (SELECT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
nodes AS (SELECT DISTINCT node, host, path FROM (SELECT node, host, path FROM u UNION ALL SELECT node, host, path FROM ends) x),
ruled AS (SELECT n.node, n.host, n.path, s.best FROM nodes n, LATERAL ({_sql_fit('n')}) s),
said AS (SELECT r.a AS node, min(d.best.verdict) AS verdict FROM reach r JOIN ruled d ON r.b = d.node GROUP BY r.a)
SELECT u.page_id, u.host, u.path, s.best.rule AS rule,
       coalesce(s.best.verdict, said.verdict, 'allow') AS verdict
FROM u LEFT JOIN said ON u.node = said.node, LATERAL ({_sql_fit('u')}) s
"""
