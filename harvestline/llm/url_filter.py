"""URL filters with redirect equivalence, in DataFrame functions only.

A url is judged by the longest rule that fits its host and path. Redirects and canonical
links make urls aliases of one another; a url no rule judges is blocked when any alias is.
An explicit allow of the url itself always wins, however its aliases are judged.

Defined cases: a null url or one without `://` has empty host and path, no aliases, and is
allowed unless a rule fits. Null html names no alias. Repeated urls are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline.llm.support import Scratch, ascii_lower, connected_components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
         Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

_CANONICAL = (r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?"
              r"([^\"'\s>]+)")
_REFRESH = (r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*"
            r"[\"']?[^\"'>]*?url\s*=\s*[\"']?([^\"'\s>]+)")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Lower-cased text between `://` and the next `/`, `?` or `#`; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?` or `#`; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """What two urls of one resource share: host, path and query, without scheme and fragment."""
    rest = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def absolute(link: Column, base: Column) -> Column:
    """A link of a page as an absolute url."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"^(.*?)://", 1)
    host = F.regexp_extract(_rest(base), r"^[^/?#]*", 0)
    folder = F.regexp_extract(path_of(base), r"^(.*/)?", 0)
    root = F.concat(scheme, F.lit("://"), host)
    return (F.when(link.contains("://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link)))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null.

    `rules` is a short list that becomes one CASE; equal lengths prefer allow.
    """
    choice = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        choice = F.when(fits, value) if choice is None else choice.when(fits, value)
    return choice if choice is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b) alias keys joined by canonical links, refresh redirects or observed redirects.

    `redirects` has columns from_url and to_url.
    """
    named = pages.where("html IS NOT NULL AND instr(url, '://') > 0").where(
        F.col("html").rlike(r"(?i)canonical|http-equiv"))
    links = named.select("url", F.explode(F.array(
        F.regexp_extract("html", _CANONICAL, 1), F.regexp_extract("html", _REFRESH, 1))).alias("link"))
    edges = links.where("link <> ''").select(
        alias_key(F.col("url")).alias("a"), alias_key(absolute(F.col("link"), F.col("url"))).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(alias_key(F.col("from_url")), alias_key(F.col("to_url"))))
    return edges.where("a <> b")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES,
                redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and `by` (rule, alias or default) of every page.

    The html is read once, for the links; only alias keys and their component are shuffled.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    edges = scratch.write(alias_edges(pages, redirects), "edges")
    parts = connected_components(edges, scratch, "parts")
    url = F.concat(F.lit("x://"), F.col("node"))
    judged = parts.withColumn("_rule", rule_of(host_of(url), path_of(url), rules))
    blocked = (judged.where("_rule.verdict = 'block'").select("component").distinct()
               .join(parts, "component").select("node", F.lit(True).alias("_alias")))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       alias_key(F.col("url")).alias("node"))
    own = own.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return own.join(blocked, "node", "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("_alias"), "block"), F.lit("allow")).alias("verdict"),
        F.when(F.col("_rule").isNotNull(), "rule").when(F.col("_alias"), "alias")
        .otherwise("default").alias("by"))


def query(spark, sf_dir):
    from harvestline.llm.support import table
    return filter_urls(table(spark, sf_dir, "pages"))


SQL = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, url, html, instr(url, '://') AS sep,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail, sep
  FROM cut
), nodes AS (
  SELECT *, CASE WHEN sep > 0 THEN host || tail END AS node FROM parts
), links AS (
  SELECT node AS a, replace(unnest([
    regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
    regexp_extract(html, '<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1, 'is'),
    regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is')
  ]), '&amp;', '&') AS link FROM nodes WHERE sep > 0
), edges AS (
  SELECT a, translate(regexp_extract(link, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz') || regexp_extract(link, '://[^/?#]*([^#]*)', 1) AS b
  FROM links WHERE instr(link, '://') > 0
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
  SELECT DISTINCT a AS node, a AS other FROM both_ways
  UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
         ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), blocked AS (
  SELECT DISTINCT r.node FROM reach r
  WHERE (SELECT arg_max(u.verdict, length(u.host || u.path)) FROM rules u
         WHERE (regexp_extract(r.other, '^[^/?#]*', 0) = u.host
                OR ends_with(regexp_extract(r.other, '^[^/?#]*', 0), '.' || u.host))
           AND starts_with(regexp_extract(r.other, '^[^/?#]*([^?#]*)', 1), u.path)) = 'block'
), own AS (
  SELECT n.page_id, n.host, n.path, n.node,
         (SELECT arg_max(u.host || u.path, length(u.host || u.path)) FROM rules u
          WHERE (n.host = u.host OR ends_with(n.host, '.' || u.host)) AND starts_with(n.path, u.path)) AS rule,
         (SELECT arg_max(u.verdict, length(u.host || u.path)) FROM rules u
          WHERE (n.host = u.host OR ends_with(n.host, '.' || u.host)) AND starts_with(n.path, u.path)) AS said
  FROM nodes n
)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN b.node IS NOT NULL THEN 'block' END, 'allow') AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN b.node IS NOT NULL THEN 'alias' ELSE 'default' END AS "by"
FROM own LEFT JOIN blocked b ON own.node = b.node
"""
