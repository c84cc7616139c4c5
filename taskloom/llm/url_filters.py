"""Operator 3: URL filters with redirect equivalence (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, connected_components, table, written

#: The default rules: (verdict, host, start of the path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
#: Scheme and host, path and query of an address without fragment.
SITE = r"(?s)^([^:/?]*://[^/?]*)([^?]*)(.*)$"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
#: Not read as HTML: comments and scripts, to their end or that of the page.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
GOES_TO = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// (A-Z lower-cased) and path up to ? or #; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls with host, path, rule (host and path of the longest rule that fits) and rule_verdict."""
    host, path = host_and_path(F.col("url"))
    d = urls.withColumn("host", host).withColumn("path", path)
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(start)
        chosen = F.when(fits, F.struct(F.lit(h + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return d.withColumn("_r", chosen).withColumn("rule", F.col("_r.rule")).withColumn("rule_verdict", F.col("_r.verdict")).drop("_r")


def node_of(url: Column) -> Column:
    """What an address is known by in the graph: all before #, with scheme and host in lower case (A-Z) and the path without `.` and `..`."""
    u = F.regexp_extract(url, r"^[^#]*", 0)
    site, path, rest = F.regexp_extract(u, SITE, 1), F.regexp_extract(u, SITE, 2), F.regexp_extract(u, SITE, 3)
    climb = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).otherwise(F.concat(acc, F.lit("/"), x))
    steps = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    plain = F.when(F.contains(path, F.lit("/.")), F.aggregate(steps, F.lit(""), climb)).when(path == "", F.lit("/")).otherwise(path)
    return F.when(u.rlike(SITE), F.concat(ascii_lower(site), plain, rest)).otherwise(u)


def resolved(link: Column, base: Column) -> Column:
    """An absolute address of a link found on the page at base."""
    link = F.regexp_replace(link, "&amp;", "&")
    scheme, site = F.regexp_extract(base, r"^[^:/?#]*:", 0), F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(folder, link))


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): a page's address and what each of its canonical links and refresh redirects names; those in comments and scripts do not count."""
    some = pages.where(F.col("url").isNotNull() & (F.col("html").rlike(CANONICAL) | F.col("html").rlike(REFRESH))).select("url", F.regexp_replace("html", HIDDEN, " ").alias("html"))
    named = lambda tag, at: F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, at, 1))
    found = some.select("url", F.explode(F.concat(named(CANONICAL, HREF), named(REFRESH, GOES_TO))).alias("link")).where("link <> ''")
    return found.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("link"), F.col("url"))).alias("b")).where("a <> b")


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, component): the verdict on every page.

    An address that a rule fits has that rule's verdict. Any other takes part in its
    equivalence class: the connected component over canonical links and refresh redirects
    found in the pages' HTML, and over `redirects` (from_url, to_url). In a class with an
    address that a rule allows it is allowed, else in a class with a blocked address it is
    blocked; else, and without any link, it is allowed. Addresses that are linked to but are
    no pages count in their classes. Addresses are the same that differ in the fragment, in
    the case of scheme and host, or in `.` and `..` in the path; an empty path is `/`.

    pages: page_id, url, html; other columns are ignored. A null url has an empty host and
    path, no rule and no class; null html has no links. Repeated rows each get a row. No
    rows give no rows.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    links = written(links.distinct())
    member = connected_components(links)
    member = member.unionByName(member.select(F.col("component").alias("node"), "component").distinct())
    state = ruled(member.withColumnRenamed("node", "url"), rules)
    per = state.groupBy("component").agg(F.max((F.col("rule_verdict") == "allow").cast("int")).alias("allowed"), F.max((F.col("rule_verdict") == "block").cast("int")).alias("blocked"))
    spread = F.when(F.coalesce("allowed", F.lit(0)) == 1, "allow").when(F.coalesce("blocked", F.lit(0)) == 1, "block").otherwise("allow")
    per = member.join(per.select("component", spread.alias("spread")), "component").select("node", "component", "spread")
    judged = ruled(pages.select("page_id", "url"), rules).withColumn("node", node_of(F.col("url"))).join(per, "node", "left")
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", "spread", F.lit("allow")).alias("verdict"), "component")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
p AS (SELECT page_id, url, html, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
link AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(h, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(h, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS l
  FROM (SELECT url, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)', ' ', 'g') AS h FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)),
r AS (SELECT DISTINCT url, CASE WHEN contains(l, '://') THEN l
        WHEN starts_with(l, '//') THEN regexp_extract(url, '^[^:/?#]*:') || l
        WHEN starts_with(l, '/') THEN regexp_extract(url, '^[^:/?#]*://[^/?#]*') || l
        ELSE regexp_replace(regexp_extract(url, '^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)', 1), '([^/])$', '\1/') || l END AS b FROM (SELECT url, replace(l, '&amp;', '&') AS l FROM link WHERE l <> '')),
-- known by: no fragment, lower-case scheme and host, no dot steps in the path
part AS (SELECT raw, u, regexp_extract(u, '(?s)^([^:/?]*://[^/?]*)([^?]*)(.*)$', 1) AS s, regexp_extract(u, '(?s)^([^:/?]*://[^/?]*)([^?]*)(.*)$', 2) AS pa, regexp_extract(u, '(?s)^([^:/?]*://[^/?]*)([^?]*)(.*)$', 3) AS re
         FROM (SELECT raw, regexp_extract(raw, '^[^#]*') AS u FROM (SELECT url AS raw FROM pages WHERE url IS NOT NULL UNION SELECT b FROM r))),
node AS (SELECT raw, CASE WHEN s = '' THEN u ELSE translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
           || CASE WHEN contains(pa, '/.') THEN list_reduce(string_split(regexp_replace(regexp_replace(pa, '^/', ''), '(^|/)(\.\.?)$', '\1\2/'), '/'),
                lambda acc, x: CASE WHEN x = '.' THEN acc WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END, '')
              WHEN pa = '' THEN '/' ELSE pa END || re END AS n FROM part),
e AS (SELECT DISTINCT x.n AS a, y.n AS b FROM r JOIN node x ON x.raw = r.url JOIN node y ON y.raw = r.b),
sym AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
known AS (SELECT b AS url, translate(regexp_extract(substr(b, instr(b, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(b, instr(b, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT b FROM reach)),
state AS (SELECT k.url, arg_max(verdict, length(rh || rp)) AS v FROM known k JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k.url),
spread AS (SELECT r.a AS node, CASE WHEN bool_or(coalesce(v = 'allow', false)) THEN 'allow' WHEN bool_or(coalesce(v = 'block', false)) THEN 'block' ELSE 'allow' END AS v
           FROM reach r LEFT JOIN state s ON r.b = s.url GROUP BY r.a),
j AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
b AS (SELECT *, (SELECT arg_max({'rule': rh || rp, 'verdict': verdict}, length(rh || rp)) FROM rules
                 WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS r FROM j)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, s.v, 'allow') AS verdict
FROM b LEFT JOIN node n ON n.raw = b.url LEFT JOIN spread s ON s.node = n.n
"""
