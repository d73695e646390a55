"""URL filter with redirect equivalence, in DataFrame functions only.

Rules name a host and a path prefix; a rule fits its host, all subdomains, and paths that start with
its path; the longest that fits decides. What no rule decides, the method does: redirects and canonical
links make urls aliases of each other, aliases form connected components (joins and aggregations), and
a component with a blocked member is blocked, unless a member is allowed explicitly. An explicit rule of
a url itself always holds. Everything else is allowed.

Edges come from pages (canonical links, ``og:url``, refresh redirects), from url variants that servers
redirect to one form (scheme, ``www.`` and ``m.`` hosts, a final slash or index file, tracking
parameters), and from a table of observed redirects, if given.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.llm.components import connected_components
from priorline.llm.rows import sized
from priorline.sources.durable import durable

# The rules of the query (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel=["']?canonical\b)[^>]*\bhref=["']?([^"'\s>]+)"""
OPEN_GRAPH = r"""(?i)<meta\b(?=[^>]*\bproperty=["']?og:url\b)[^>]*\bcontent=["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv=["']?refresh\b)[^>]*\bcontent=["']?[^"'>]*?\burl=\s*["']?([^"'\s>]+)"""
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def ascii_lower(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Host, path and query: what a server is asked for, whatever the scheme. Null without ``://``."""
    query = F.regexp_extract(after_scheme(url), r"^[^#]*?(\?[^#]*)", 1)
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path_of(url), query))


def canonical_node(node: Column) -> Column:
    """The form that variants of a node are redirected to."""
    host = F.regexp_replace(F.regexp_extract(node, r"^[^/?]*", 0), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(node, r"^[^/?]*([^?]*)", 1), r"/(?:index\.html?)?$", "")
    query = F.regexp_replace(F.regexp_extract(node, r"\?(.*)$", 1), rf"(?:^|&){TRACKING}", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def resolved(link: Column, url: Column) -> Column:
    """An absolute form of a link on a page; null for an empty one."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = F.substring_index(url, "://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))
    folder = F.concat(root, F.regexp_replace(path_of(url), r"[^/]*$", ""))
    return (
        F.when(F.coalesce(link, F.lit("")) == "", None)
        .when(F.contains(link, F.lit("://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes that are aliases of each other; pages: (url, html)."""
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    declared = F.when(
        F.instr(html, "canonical") + F.instr(html, "og:url") + F.instr(F.lower(html), "refresh") > 0,
        F.array(*[resolved(F.regexp_extract(html, p, 1), url) for p in (CANONICAL, OPEN_GRAPH, REFRESH)]),
    ).otherwise(F.array().cast("array<string>"))
    targets = F.array_append(F.transform(F.filter(declared, lambda t: t.isNotNull()), node_of), canonical_node(node_of(url)))
    return (
        pages.where(F.instr("url", "://") > 0)
        .select(node_of(url).alias("a"), F.explode(targets).alias("b"))
        .where("b IS NOT NULL AND a <> b")
        .distinct()
    )


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_host, rule_path, rule, rule_verdict) for each distinct (host, path) that a rule fits.

    Joined by equality: each suffix of the host at a label, and each prefix of the path at a slash, with
    the rule's host and its path up to the last slash.
    """
    keyed = rules.select(
        F.col("host").alias("of_host"), F.regexp_extract("path", r"^(.*/)?", 0).alias("of_folder"),
        F.col("path").alias("prefix"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"),
    )
    labels, steps = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    folders = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda k: F.when(k == 1, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, k - 1), "/"), F.lit("/"))),
    )
    tried = (
        places.select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"), folders.alias("folders"))
        .select("host", "path", "suffix", F.explode("folders").alias("folder"))
    )
    fits = tried.join(
        sized(keyed), (F.col("suffix") == F.col("of_host")) & (F.col("folder") == F.col("of_folder"))
    ).where(F.startswith("path", F.col("prefix")))
    # Of rules of equal text an allowing one holds.
    strength = F.struct(F.length("rule"), (F.col("rule_verdict") == "allow").alias("allows"), F.col("rule"))
    return fits.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(
        F.max_by(F.struct("rule", "rule_verdict"), strength).alias("best")
    ).select("rule_host", "rule_path", "best.rule", "best.rule_verdict")


def alias_verdicts(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(alias, alias_verdict, component) of each node on an edge whose component has a ruled member."""
    nodes = connected_components(edges)
    placed = nodes.select(
        "node", "component", F.regexp_extract("node", r"^[^/?]*", 0).alias("host"),
        F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("path"),
    )
    placed = durable(placed)
    decided = ruled(placed, rules)
    explicit = placed.join(decided, (F.col("host") == F.col("rule_host")) & (F.col("path") == F.col("rule_path")))
    of_component = explicit.groupBy(F.col("component").alias("c")).agg(
        F.when(F.bool_or(F.col("rule_verdict") == "allow"), "allow").otherwise("block").alias("alias_verdict")
    )
    return placed.join(of_component, F.col("component") == F.col("c")).select(
        F.col("node").alias("alias"), "alias_verdict", "component"
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None
) -> DataFrame:
    """One line per row: page_id, host, path, rule (null without one), verdict, component (null without).

    redirects: optional (source, target) urls. A null url, or one without ``://``, has an empty host and
    path, fits no rule and is allowed. Repeated rows give one line each.
    """
    rules = durable(rules if rules is not None else rules_table(pages.sparkSession))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    edges = alias_edges(rows)
    if redirects is not None:
        edges = edges.union(
            redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b"))
        )
    aliases = alias_verdicts(edges, rules)
    placed = rows.select(
        "page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), node_of(F.col("url")).alias("node"),
    )
    decided = ruled(placed, rules)
    return (
        placed.join(decided, (F.col("host") == F.col("rule_host")) & (F.col("path") == F.col("rule_path")), "left")
        .join(aliases, F.col("node") == F.col("alias"), "left")
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"), "component",
        )
    )


#: The same for pages without declared links, where a component is what has one canonical form.
JUDGE_SQL = """
WITH cut AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest,
         coalesce(instr(url, '://') > 0, false) AS has
  FROM pages),
placed AS (
  SELECT page_id, has,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS query
  FROM cut),
rules(rule_verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
urls AS (SELECT *, row_number() OVER () AS n,
                regexp_replace(host, ':(80|443)$', '') AS bare FROM placed),
fitted AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n),
formed AS (
  SELECT urls.*, rule, rule_verdict,
         regexp_replace(bare, '^(www|m)\\.', '') AS form_host, regexp_replace(path, '/(index\\.html?)?$', '') AS form_path,
         regexp_replace(regexp_replace(substr(query, 2), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS form_query
  FROM urls LEFT JOIN fitted USING (n)),
members AS (
  SELECT form_host, form_path, form_query, rule_verdict FROM formed WHERE has
  UNION ALL
  SELECT DISTINCT form_host, form_path, form_query,
         arg_max(r.rule_verdict, length(r.rule_host || r.rule_path))
           OVER (PARTITION BY form_host, form_path, form_query
                 ORDER BY length(r.rule_host || r.rule_path) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  FROM (SELECT DISTINCT form_host, form_path, form_query FROM formed WHERE has) f
  JOIN rules r ON (form_host = r.rule_host OR ends_with(form_host, '.' || r.rule_host)) AND starts_with(form_path, r.rule_path)),
components AS (
  SELECT form_host, form_path, form_query, bool_or(rule_verdict = 'allow') AS allows, bool_or(rule_verdict = 'block') AS blocks
  FROM members GROUP BY ALL)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' END, 'allow') AS verdict
FROM formed LEFT JOIN components USING (form_host, form_path, form_query)
"""
