"""URL filters over redirect equivalence: block decisions reach every alias of a page.

URLs joined by redirects or canonical links are one resource. Rules of host and
path decide single URLs, the longest that fits; connected components over the
links carry the blocks on to the aliases that no rule decides. DataFrame
operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, frozen, table
from .components import components

#: (verdict, host and path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Rules that are compiled into one expression; longer lists are joined by host.
MAX_INLINE = 200
_LINK = r"(?is)<link\b[^>]*>"
_META = r"(?is)<meta\b[^>]*>"
#: Character references decoded in attribute values; that of the ampersand comes last, so that nothing is decoded twice.
_ENTITIES = ((r"&lt;|&#0*60;|&#x0*3c;", "<"), (r"&gt;|&#0*62;|&#x0*3e;", ">"), (r"&quot;|&#0*34;|&#x0*22;", '"'), (r"&apos;|&#0*39;|&#x0*27;", "'"),
             (r"&#0*47;|&#x0*2f;", "/"), (r"&#0*61;|&#x0*3d;", "="), (r"&amp;|&#0*38;|&#x0*26;", "&"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def _parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def judged(urls: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """urls with ``host``, ``path``, ``rule`` and ``by_rule``: the longest rule that fits (ties: the first by code point), and its verdict; null if none.

    A rule fits its host and all subdomains whose path starts with the rule's.
    Short lists become one expression; long ones are joined by host suffix (a
    URL has one for each label of its host), the longest fitting rule being picked before
    the rows meet again, by host and path.
    """
    out = urls.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    if len(rules) <= MAX_INLINE:
        chosen = F.lit(None).cast("struct<rule:string,by_rule:string>")
        for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]), reverse=True):
            host, path = _parts(rule)
            hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("by_rule"))
            chosen = F.when(_fits(F.col("host"), F.col("path"), F.lit(host), F.lit(path)), hit).otherwise(chosen)
        return out.withColumn("_chosen", chosen).select(*out.columns, F.col("_chosen.rule").alias("rule"), F.col("_chosen.by_rule").alias("by_rule"))
    listed = out.sparkSession.createDataFrame([(*_parts(r), r, v) for v, r in rules], "rule_host string, rule_path string, rule string, by_rule string")
    pairs = out.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    found = pairs.withColumn("rule_host", F.explode(suffixes)).join(listed, "rule_host").filter(F.startswith("path", "rule_path"))
    best = found.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "by_rule")).alias("b"))
    best = best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.by_rule").alias("by_rule"))
    return out.join(best, ["host", "path"], "left").select(*out.columns, "rule", "by_rule")


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    value = F.regexp_replace(value, r"""^["']|["']$""", "")
    for pattern, char in _ENTITIES:
        value = F.regexp_replace(value, f"(?i){pattern}", char)
    return F.trim(value)


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/``, its ``.`` and ``..`` segments resolved."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))),
    )
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(walked, end), "/"))


def absolute(base: Column, target: Column) -> Column:
    """The target of a link, absolute: whole URLs stay, others take what they lack from the base (host, directory, or path of a query), dot segments resolved. Bare fragments and other schemes (mailto:) are dropped (null)."""
    scheme, site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    bare = F.regexp_replace(F.trim(target), r"(?s)#.*$", "")
    own = F.regexp_replace(bare, r"(?s)\?.*$", "")
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    path = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own))
    return (
        F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), bare)
        .when(F.startswith(bare, F.lit("//")) & (scheme != ""), F.concat(scheme, F.lit(":"), bare))
        .when((bare == "") | bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (site == ""), None)
        .when(F.startswith(bare, F.lit("?")), F.concat(site, path_of(base), bare))
        .otherwise(F.concat(site, _without_dots(path), F.regexp_extract(bare, r"(?s)(\?.*)$", 1)))
    )


def node(url: Column) -> Column:
    """A URL as a node: without its fragment, host A-Z lower-cased."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(ascii_lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def links(pages: DataFrame) -> DataFrame:
    """(u, v): the canonical link and the refresh redirects of each page's html, as pairs of nodes."""
    tags = F.concat(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)), F.regexp_extract_all("html", F.lit(_META), F.lit(0)))
    # a page without either word costs a search and no tag is taken from it
    likely = pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    rows = likely.select(F.col("url").cast("string").alias("url"), F.explode(tags).alias("tag"))
    canonical = F.when(F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1))
    # each step is exploded as an array of one, so that the next reads its value and doesn't repeat its expressions
    rows = rows.select("url", F.explode(F.array(F.coalesce(canonical, refresh))).alias("target")).filter("target <> ''")
    rows = rows.select("url", F.explode(F.array(absolute(F.col("url"), F.col("target")))).alias("whole")).filter("whole <> ''")
    return rows.select(node(F.col("url")).alias("u"), node(F.col("whole")).alias("v"))


def filter_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, alias_of) for each row of pages.

    The verdict is that of the longest fitting rule. Where no rule fits, a page
    is blocked if any URL of its component (of canonical links, refreshes and
    the ``redirects`` (source, target) given) is blocked by a rule; so an explicit
    allow always stands, also within a blocked component, and else a page is
    allowed. ``alias_of`` is the smallest URL of the component (null: without
    links). URLs that are link targets only count with the rules they meet. A null url has no
    host and no links and is allowed; repeated rows stay; empty tables give none.
    """
    every = links(pages)
    if redirects is not None:
        every = every.union(redirects.select(node(F.col("source").cast("string")), node(F.col("target").cast("string"))))
    parts = frozen(components(every))
    own = judged(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), rules)
    if parts.isEmpty():
        return own.select("page_id", "url", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_of"))
    blocked = judged(parts, rules, "node").groupBy("root").agg(F.max(F.col("by_rule").eqNullSafe("block")).alias("tainted"))
    known = parts.join(blocked, "root").select(F.col("node").alias("_node"), F.col("root").alias("alias_of"), "tainted")
    joined = own.withColumn("_node", node(F.col("url"))).join(known, "_node", "left")
    verdict = F.coalesce("by_rule", F.when(F.col("tainted"), F.lit("block")), F.lit("allow"))
    return joined.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "alias_of")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: host, path, rule and verdict of every page."""
    return filter_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_CASES = "\n".join(
    f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'"
    for v, (h, p) in ((v, _parts(r)) for v, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])))
)
#: The tables hold neither canonical links nor refreshes, so no verdict is carried on; the tests check that part by brute force.
ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?:.|\\n)*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?:.|\\n)*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), j AS (
  SELECT *, CASE
{_CASES}
    END AS hit FROM p
)
SELECT page_id, host, path, split_part(hit, '|', 2) AS rule, coalesce(split_part(hit, '|', 1), 'allow') AS verdict FROM j
"""
