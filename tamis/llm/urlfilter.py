"""URL filters with redirect equivalence, in DataFrame operations only.

A page's own verdict is the longest rule that fits its URL. Pages also name other addresses of themselves: a
canonical link or an immediate refresh in their HTML. These edges tie URLs into groups (connected components).
A page without a rule of its own takes its group's decision: allow if any address of the group is explicitly
allowed, else block if any is blocked, else allow. A rule that fits the page itself always wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, staged

#: (verdict, host, path): a rule fits its host and all subdomains, if the URL's path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scheme, host, path and query of a URL.
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']\s*[0-9.]+\s*[;,]\s*url\s*=\s*["']?([^"'>\s]+)"""


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, k)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z lower-cased; empty without ://."""
    return F.translate(_part(url, 2), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty without ://."""
    return _part(url, 3)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))


def own_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does; of equal lengths, allow comes first."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*(F.when(_fits(host, path, r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in ordered), none)


def _absolute(base: Column, ref: Column) -> Column:
    """A reference resolved against its page: absolute, scheme-relative, host-relative and plain relative ones."""
    ref = F.trim(ref)
    scheme = _part(base, 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when(ref.isNull() | (ref == ""), None)
        .when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(root, ref))
        .when(F.startswith(ref, F.lit("#")) | F.startswith(ref, F.lit("?")), None)
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), ref))
    )


def address(url: Column) -> Column:
    """A URL as a node of the redirect graph: host lower-cased, fragment cut, empty path as /; null without ://."""
    path = path_of(url)
    node = F.concat(F.lower(_part(url, 1)), F.lit("://"), host_of(url), F.when(path == "", F.lit("/")).otherwise(path), _part(url, 4))
    return F.when(F.instr(url, "://") > 0, node)


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges (u, v) between a page's address and those that its HTML names as its own."""
    html = F.coalesce(F.col("html"), F.lit(""))
    href = F.concat(*(F.regexp_extract(html, _CANONICAL, k) for k in (1, 2, 3)))
    low = F.lower(html)
    # The patterns run only where their word occurs at all.
    canonical = F.when(F.contains(low, F.lit("canonical")), href)
    refresh = F.when(F.contains(low, F.lit("http-equiv")), F.regexp_extract(html, _REFRESH, 1))
    named = pages.select(F.col("url"), F.explode(F.array(canonical, refresh)).alias("ref")).where("ref IS NOT NULL AND ref <> ''")
    # Staged here, the HTML is read once, and the addresses' expressions stay small enough to be compiled.
    named = staged(named.select("url", F.replace("ref", F.lit("&amp;"), F.lit("&")).alias("ref")), "refs")
    edges = named.select(address(F.col("url")).alias("u"), _absolute(F.col("url"), F.col("ref")).alias("to")).select("u", address(F.col("to")).alias("v"))
    return edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict.

    pages needs page_id, url and html; other columns are ignored. A null URL, or one without ://, has an empty
    host and path, no rule, and is no one's alias: allow. A null html names no other address. Pages of the same
    address are one node, and every row gets its answer. An empty table gives an empty result.
    """
    pages = pages.select("page_id", "url", "html")
    edges = staged(alias_edges(pages), "aliases")
    url = F.col("url")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("node"))
    base = base.withColumn("own", own_rule(F.col("host"), F.col("path"), rules))
    if not edges.n_rows:
        return base.select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", F.lit("allow")).alias("verdict"))
    groups = staged(components(edges), "groups")
    # Every address of a group may carry a rule, whether or not its page is in the table.
    judged = groups.select("root", own_rule(host_of(F.col("node")), path_of(F.col("node")), rules).alias("own"))
    flags = judged.groupBy("root").agg(
        F.max(F.coalesce(F.col("own.verdict") == "allow", F.lit(False))).alias("any_allow"),
        F.max(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("any_block"),
    )
    shared = flags.select("root", F.when(F.col("any_block") & ~F.col("any_allow"), "block").otherwise("allow").alias("by_group"))
    shared = staged(groups.join(staged(shared, "verdicts"), "root").select("node", "by_group"), "groups")
    return base.join(shared, "node", "left").select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", "by_group", F.lit("allow")).alias("verdict"))
