"""URL rules with redirect equivalence.

A rule is a host and a path prefix with a verdict; it fits its host and all subdomains when
the url's path starts with its path.  The longest fitting rule wins and decides.

Urls that no rule fits follow their aliases: pages that redirect to each other or name a
canonical address form a component of a graph over urls, found by distributed connected
components.  A component with a blocked url blocks all its members, except those that a rule
of their own allows: an explicit allow always takes precedence.  Everything else is allowed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted
from .components import connected_components

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What holds no tags of the page: comments and scripts.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
TAG = r"""(?is)<(?:link|meta|base)\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
ATTRIBUTE = r"""(?s)[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
#: The target in a refresh's content.
TARGET = r"""(?is)\burl\s*=\s*['"]?\s*([^'"]*)"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    rest = after_scheme(url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """The winning rule as struct(verdict, rule), null if none fits.

    Longest first by host and path together, ties to the longer host, then to ``allow``.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def node(url: Column) -> Column:
    """A url's name in the graph: without scheme and fragment, its host lower-cased, an empty path as ``/``; null without ``://``."""
    rest = lambda u: F.regexp_extract(after_scheme(u), r"^[^/?#]*([^#]*)", 1)
    slashed = lambda r: F.when(r.startswith("/"), r).otherwise(F.concat(F.lit("/"), r))
    return let(url, lambda u: F.when(after_scheme(u).isNotNull(), F.concat(host(u), let(rest(u), slashed))))


def _undotted(url: Column) -> Column:
    def step(stack: Column, part: Column) -> Column:
        pushed = F.concat(stack, F.array(part))
        return F.when(part == ".", stack).when(part == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(pushed)

    def joined(kept: Column, parts: Column) -> Column:
        slash = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.array_join(kept, "/"), slash)

    split = lambda i: F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)([^?#]*)(.*)$", i)
    kept = lambda parts: F.aggregate(parts, F.array().cast("array<string>"), step)
    path = let(F.split(F.substr(split(2), F.lit(2)), "/"), lambda parts: let(kept(parts), lambda k: joined(k, parts)))
    return F.concat(split(1), F.lit("/"), path, split(3))


def without_dots(url: Column) -> Column:
    """``url`` with the ``.`` and ``..`` segments of its path undone."""
    return let(url, lambda u: F.when(u.rlike(r"^[^:/?#]*://[^/?#]*[^?#]*/\."), _undotted(u)).otherwise(u))


def resolved(url: Column, target: Column) -> Column:
    """The absolute form of a link's target on the page ``url``; null if it names no other page."""

    def full(clean: Column) -> Column:
        base = F.regexp_extract(url, r"^[^?#]*", 0)
        origin = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*", 0)
        folder = F.regexp_extract(base, r"^([^:/?#]*://[^/]*/(?:.*/)?)", 1)
        return (
            F.when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), clean)
            .when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (clean == "") | clean.startswith("#"), F.lit(None))
            .when(clean.startswith("//"), F.concat(F.regexp_extract(url, r"^[^:/?#]*:", 0), clean))
            .when(clean.startswith("/"), F.concat(origin, clean))
            .when(clean.startswith("?"), F.concat(base, clean))
            .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), clean))
        )

    return without_dots(let(F.trim(F.regexp_replace(target, "(?i)&(amp|#38|#x26);", "&")), full))


def _attribute(attributes: Column, name: str) -> Column:
    """The value of the first attribute called ``name``, without quotes; null without one."""
    found = F.filter(attributes, lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name)
    value = F.regexp_extract(F.get(found, F.lit(0)), r"(?s)=\s*(.*)$", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a``, ``b``: distinct graph nodes that a redirect or canonical link joins.

    All refresh and canonical tags of a page count, whatever the order and quoting of
    their attributes; relative targets follow the page's url, or its ``base`` tag.  Comments and
    scripts hold no tags.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    hint = page.rlike("(?i)canonical|refresh")  # a cheap test before the search for tags
    tags = pages.where(hint & F.col(url).isNotNull()).select(F.col(url).alias("u"), F.regexp_extract_all(F.regexp_replace(page, HIDDEN, ""), F.lit(TAG), F.lit(0)).alias("tags"))
    read = tags.select("u", F.transform("tags", lambda t: F.struct(F.lower(F.regexp_extract(t, r"^<(\w+)", 1)).alias("kind"), F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(0)).alias("at"))).alias("tags"))
    bases = F.filter(F.transform(F.filter("tags", lambda t: t.kind == "base"), lambda t: _attribute(t["at"], "href")), lambda v: v.isNotNull())
    each = read.select("u", F.coalesce(resolved(F.col("u"), F.get(bases, F.lit(0))), F.col("u")).alias("base"), F.explode("tags").alias("t"))
    at = F.col("t.at")
    canonical = (F.col("t.kind") == "link") & F.array_contains(F.split(F.lower(_attribute(at, "rel")), r"\s+"), "canonical")
    refresh = (F.col("t.kind") == "meta") & (F.lower(F.trim(_attribute(at, "http-equiv"))) == "refresh")
    target = F.when(canonical, _attribute(at, "href")).when(refresh, F.regexp_extract(_attribute(at, "content"), TARGET, 1))
    links = each.select("u", "base", target.alias("t")).where("t <> ''")
    return links.select(node(F.col("u")).alias("a"), node(resolved(F.col("base"), F.col("t"))).alias("b")).where("a is not null and b is not null and a <> b").distinct()


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is
    allowed.  Null html has no links; html is read whole, of any length.  Repeated rows and urls
    are judged alike.  Kept columns called like results are replaced by them.  No pages give no rows.
    """
    rules, results = tuple(rules), ("host", "path", "rule", "verdict")
    own = [c for c in keep if c.lower() not in results]
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(own)]
    base = pages.select(*[pages[quoted(c)].alias(f"c{i}") for i, c in enumerate(own)], pages[url].alias("url"), host(pages[url]).alias("host"), path(pages[url]).alias("path"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    comp = connected_components(alias_edges(pages, url, html))
    # blocked urls that take part in a component; link targets count, crawled or not
    member = comp.withColumn("host", host(F.concat(F.lit("x://"), F.col("node")))).withColumn("path", path(F.concat(F.lit("x://"), F.col("node"))))
    blocked = member.where(rule_of(F.col("host"), F.col("path"), rules)["verdict"] == "block").select("component").distinct()
    tainted = comp.join(blocked, "component").select("node").withColumn("tainted", F.lit(True))
    # only pages without a rule of their own, and with a url, ask their component
    asks = F.col("rule").isNull() & F.col("url").contains("://")
    met = base.where(asks).withColumn("node", node(F.col("url"))).join(tainted, "node", "left").drop("node")
    rest = base.where(~F.coalesce(asks, F.lit(False))).withColumn("tainted", F.lit(None).cast("boolean"))
    verdict = F.coalesce(F.col("rule")["verdict"], F.when(F.col("tainted"), "block").otherwise("allow"))
    return met.unionByName(rest).select(*names, "host", "path", F.col("rule")["rule"].alias("rule"), verdict.alias("verdict"))


ORACLE_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '^([^/]|$)', '/\1') AS node
  FROM p
), tags AS (
  SELECT url, node, lower(regexp_extract(tag, '^<(\w+)', 1)) AS kind, regexp_extract_all(tag, '(?s)[^\s"''<>/=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)') AS attributes
  FROM (SELECT url, node, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?is)<(?:link|meta|base)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag
    FROM (SELECT DISTINCT url, node, html FROM q) WHERE node IS NOT NULL AND html IS NOT NULL)
), named AS (
  SELECT *, VALUE_rel AS rel, VALUE_href AS href, VALUE_http-equiv AS equiv, VALUE_content AS content FROM tags
), first_base AS (
  SELECT url, first(href) AS href FROM named WHERE kind = 'base' AND href IS NOT NULL GROUP BY url
), t AS (
  SELECT url, node, url AS page, href AS target, TRUE AS is_base FROM first_base JOIN (SELECT DISTINCT url, node FROM tags) USING (url)
), base_of AS (
  SELECT url, RESOLVED AS base FROM t
), links AS (
  SELECT n.url, node, coalesce(base, n.url) AS page,
    CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN href
      WHEN kind = 'meta' AND lower(trim(equiv)) = 'refresh' THEN regexp_extract(content, '(?is)\burl\s*=\s*[''"]?\s*([^''"]*)', 1) END AS target
  FROM named n LEFT JOIN base_of USING (url)
), b AS (
  SELECT a, substr(b, strpos(b, '://') + 3) AS rest FROM (SELECT node AS a, RESOLVED AS b FROM links WHERE target <> '') WHERE strpos(b, '://') > 0
), edge AS (
  SELECT DISTINCT a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '^([^/]|$)', '/\1') AS b FROM b
), joined AS (
  SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b
), rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
linked AS (
  SELECT node, regexp_extract(node, '^[^/?#]*') AS host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT a AS node FROM joined)
), reach AS (
  SELECT node FROM (SELECT node, arg_max(r.verdict, length(r.h) + length(r.p)) AS verdict FROM linked
    JOIN rules r ON (host = r.h OR host LIKE '%.' || r.h) AND starts_with(path, r.p) GROUP BY node) WHERE verdict = 'block'
  UNION SELECT joined.b FROM reach JOIN joined ON reach.node = joined.a
), ruled AS (
  SELECT q.url, arg_max(r.verdict, length(r.h) + length(r.p)) AS verdict, arg_max(r.h || r.p, length(r.h) + length(r.p)) AS rule
  FROM (SELECT DISTINCT url, host, path FROM q) q JOIN rules r ON (host = r.h OR host LIKE '%.' || r.h) AND starts_with(path, r.p) GROUP BY q.url
)
SELECT page_id, host, path, rule, coalesce(ruled.verdict, CASE WHEN reach.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN ruled ON q.url = ruled.url LEFT JOIN reach ON q.node = reach.node
"""


def _sql() -> str:
    """``ORACLE_SQL`` with its repeated parts written out."""
    value = r"""regexp_replace(regexp_extract(list_filter(attributes, lambda x: lower(regexp_extract(x, '^[^\s=]+')) = 'NAME')[1], '(?s)=\s*(.*)$', 1), '^["'']|["'']$', '', 'g')"""
    clean = "trim(regexp_replace(target, '(?i)&(amp|#38|#x26);', '&', 'g'))"
    folder = r"regexp_extract(regexp_extract(page, '^[^?#]*'), '^([^:/?#]*://[^/]*/(?:.*/)?)', 1)"
    origin = r"regexp_extract(page, '^[^:/?#]*://[^/?#]*')"
    full = rf"""CASE WHEN regexp_matches({clean}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {clean}
      WHEN regexp_matches({clean}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR {clean} = '' OR {clean} LIKE '#%' THEN NULL
      WHEN {clean} LIKE '//%' THEN regexp_extract(page, '^[^:/?#]*:') || {clean}
      WHEN {clean} LIKE '/%' THEN {origin} || {clean}
      WHEN {clean} LIKE '?%' THEN regexp_extract(page, '^[^?#]*') || {clean}
      ELSE CASE WHEN {folder} = '' THEN {origin} || '/' ELSE {folder} END || {clean} END"""
    part = lambda i: rf"regexp_extract(u, '(?s)^([^:/?#]*://[^/?#]*)([^?#]*)(.*)$', {i})"
    parts = f"string_split(substr({part(2)}, 2), '/')"
    kept = f"(list_reduce(list_prepend([''], list_transform({parts}, lambda x: [x])), lambda x, y: CASE WHEN y[1] = '.' THEN x WHEN y[1] = '..' THEN x[1:greatest(len(x) - 1, 1)] ELSE list_concat(x, y) END))[2:]"
    undone = f"CASE WHEN contains({part(2)}, '/.') THEN {part(1)} || '/' || array_to_string({kept}, '/') || CASE WHEN {parts}[-1] IN ('.', '..') AND len({kept}) > 0 THEN '/' ELSE '' END || {part(3)} ELSE u END"
    sql = ORACLE_SQL.replace("RESOLVED", f"(SELECT {undone} FROM (SELECT {full} AS u))")
    for name in ("rel", "href", "http-equiv", "content"):
        sql = sql.replace(f"VALUE_{name}", value.replace("NAME", name))
    return sql


ORACLE_SQL = _sql()
