"""URL filter with redirect equivalence.

A url's own rule is the longest that fits its host (or a parent domain) and the start of its path. A url without a rule
takes the decision of its aliases: urls are nodes, and edges lead from a page to the targets of its canonical links, to
those of its refresh redirects, to the targets in a table of redirects if one is given, and to its plain form (without
fragment and tracking parameters). Distributed connected components make the groups of aliases (tasks contract the edges they
hold in Python, see components); a group in which any url is explicitly allowed is allowed, else a group in which any is
blocked is blocked, else it is allowed.

Defined cases: null urls and urls without `://` have empty host and path, no rule and no aliases, and are allowed; a null
html has no links; `&amp;` in a target is `&`, relative targets are resolved against the page's url (dot segments stay as they
are), and targets of other schemes (`mailto:`) or within the page (`#x`) are left out; A-Z of scheme and host are folded; equal
urls of several pages are one node; rows repeat as they are; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import LOWER, UPPER, table
from plumbline.llm.components import components

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Up to so many rules are one expression; more of them become a table that is joined by the parent domains of a host.
INLINE_RULES = 200
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and own (its verdict) to a table with host and path; both are null where no rule fits. Of equally long rules the first in order stands."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    if len(ranked) <= INLINE_RULES:
        rule = own = F.lit(None).cast("string")
        for r in reversed(ranked):
            fits = _fits(F.col("host"), F.col("path"), r)
            rule, own = F.when(fits, F.lit(r[0] + r[1])).otherwise(rule), F.when(fits, F.lit(r[2])).otherwise(own)
        return urls.withColumns({"rule": rule, "own": own})
    spark = urls.sparkSession
    known = spark.createDataFrame([(h, p, v, i) for i, (h, p, v) in enumerate(ranked)], "r_host string, r_path string, r_verdict string, r_rank int")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = urls.select("host", "path").distinct()
    best = places.withColumn("r_host", F.explode(parents)).join(known, "r_host").where("startswith(path, r_path)").groupBy("host", "path").agg(F.min_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("own")), "r_rank").alias("r"))
    return urls.join(best, ["host", "path"], "left").select(*[urls[c] for c in urls.columns], "r.rule", "r.own")


def plain_form(url: Column) -> Column:
    """Without fragment and tracking parameters."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?<=[?&])(utm_[a-z]+|gclid|fbclid)=[^&]*(&|$)", ""), r"[?&]$", "")


def node_of(url: Column) -> Column:
    """The url with A-Z of its scheme and host folded."""
    start = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(start, UPPER, LOWER), F.substring(url, F.length(start) + 1, F.length(url)))


def resolved(target: Column, url: Column) -> Column:
    """The absolute url of a target on a page; null where it names none."""
    site, place = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.when(F.length(place) > F.length(site), F.regexp_extract(place, r"(?s)^(.*/)", 1)).otherwise(F.concat(site, F.lit("/")))
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None).cast("string"))
        .when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(place, target))
        .otherwise(F.concat(folder, target))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """a, b: from each url to its canonical links, its refresh redirects and its plain form, as nodes."""
    html = F.coalesce("html", F.lit(""))
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    target = lambda tag, name: F.replace(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("&amp;"), F.lit("&"))
    canonical = F.transform(tags(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), lambda t: target(t, "href"))
    refresh = F.transform(tags(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), lambda t: target(t, "url"))
    some = pages.where("contains(url, '://')").select("url", F.explode(F.concat(canonical, refresh, F.array(plain_form(F.col("url"))))).alias("to"))
    return some.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("to"), F.col("url"))).alias("b")).where("contains(b, '://')")


def judged(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url, html). redirects: a, b urls, if known."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.where("contains(a, '://') and contains(b, '://')").select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    member = components(edges)
    known = with_rules(member.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    said = known.where("own is not null").groupBy("component").agg(F.max(F.when(F.col("own") == "allow", 2).when(F.col("own") == "block", 1)).alias("says"))
    blocked = member.join(said.where("says = 1"), "component", "left_semi").select("node").distinct().withColumn("alias_blocked", F.lit(True))
    own = with_rules(pages.select("page_id", node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    return own.join(blocked, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow")).alias("verdict")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


OP3_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, coalesce(html, '') AS html FROM pages
), l AS (
  SELECT DISTINCT url AS a, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '([?&])(?:utm_[a-z]+|gclid|fbclid)=[^&]*$', '\1'), '([?&])(?:(?:utm_[a-z]+|gclid|fbclid)=[^&]*&)+', '\1', 'g'), '[?&]$', '')
  ]) AS b FROM p WHERE contains(url, '://')
), e AS (
  SELECT a, b FROM l WHERE contains(b, '://') AND a <> b UNION SELECT b, a FROM l WHERE contains(b, '://') AND a <> b
), r AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(h, q, verdict)
), reach(a, b) AS (
  SELECT DISTINCT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), n AS (
  SELECT b, translate(regexp_extract(b, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(b, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM (SELECT DISTINCT b FROM reach)
), s AS (
  SELECT b, arg_max(verdict, length(h || q)) AS verdict FROM n JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY b
), g AS (
  SELECT a, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict FROM reach JOIN s USING (b) GROUP BY a
), o AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(o.verdict, g.verdict, 'allow') AS verdict
FROM p LEFT JOIN o USING (page_id) LEFT JOIN g ON g.a = p.url
"""
