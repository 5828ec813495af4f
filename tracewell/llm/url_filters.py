"""URL filters with redirect equivalence.

A rule names a host and a path, and fits urls of that host and its subdomains whose path starts
with the rule's; of several the one with the longest host wins, then the longest path. Pages
without a fitting rule take their verdict from their aliases: urls that redirects and canonical
links join, directly or through others, are one class. If an allowed url is in the class its
pages are allowed; else, if a blocked one is, they are blocked; else they are allowed. A page's
own rule always stands. Aliases are compared without scheme, fragment, and the case of hosts.

Edges come from the pages' html (all links whose ``rel`` lists canonical, and all refresh redirects;
relative targets are resolved against the page's url, dot segments included, and ``&amp;`` is read
as ``&``) and from a table of redirects where there is one.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, no
aliases, and is allowed. Repeated rows are judged each for itself. Null html has no links.
Links to other pages need not be to urls in the table: they join classes all the same. Targets of
schemes without ``://`` and of fragments only say nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"^.*?://"
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_LINK = r"""(?is)<link\b[^>]*>"""
_META = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_VALUE = r"""(?is)[\s"'/]{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TARGET = r"""(?is)\burl\s*=\s*['"]?([^'">\s]+)"""
_SCHEME = r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:"


def host(url):
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), _UPPER, _LOWER)


def path(url):
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def address(url):
    """Host and the rest up to the fragment; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host(url), F.when(rest == "", "/").otherwise(rest)))


def _matches(rule, host, path):
    name, start, _ = rule
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(start)


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls' columns with ``host``, ``path``, ``rule`` and ``ruled`` (the rule's verdict)."""
    df = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    best = sorted(rules, key=lambda r: (-len(r[0]), -len(r[1]), r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(best):
        fits = _matches(rule, F.col("host"), F.col("path"))
        name = F.when(fits, f"{rule[0]}{rule[1]}").otherwise(name)
        verdict = F.when(fits, rule[2]).otherwise(verdict)
    return df.withColumns({"rule": name, "ruled": verdict})


def _plain_path(path):
    """A path without its segments of dots."""
    parts = F.slice(F.split(path, "/"), 2, F.lit(1 << 30))
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x))
    kept = F.aggregate(parts, F.lit(""), step)
    return F.when(path.rlike(r"(?s)/\.\.?$"), F.concat(kept, F.lit("/"))).otherwise(kept)


def _absolute(target, url):
    """A link's target as an absolute url, resolved against its page's (RFC 3986)."""
    scheme, base = F.regexp_extract(url, r"(?s)^(.*?)://", 1), path(url)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(url, _HOST, 1))
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(base.contains("/"), F.regexp_extract(base, r"(?s)^(.*/)", 1)).otherwise("/")
    return (
        F.when(~url.contains("://"), F.when(target.contains("://"), target))
        .when(target.rlike(_SCHEME), F.when(target.contains("://"), target))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, _plain_path(own), rest))
        .when(target.startswith("?"), F.concat(site, base, target))
        .when(own != "", F.concat(site, _plain_path(F.concat(folder, own)), rest))
    )


def _attribute(tag, name: str):
    return F.concat(*(F.regexp_extract(tag, _VALUE.format(name), k) for k in (1, 2, 3)))


def html_links(pages: DataFrame) -> DataFrame:
    """``source``, ``target``: a page's url and those its html calls canonical or redirects to."""
    canonical = F.filter(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)), lambda tag: _attribute(tag, "rel").rlike(r"(?is)(^|\s)canonical(\s|$)"))
    hrefs = F.transform(canonical, lambda tag: _attribute(tag, "href"))
    moved = F.transform(F.regexp_extract_all("html", F.lit(_META), F.lit(0)), lambda tag: F.regexp_extract(tag, _TARGET, 1))
    found = pages.filter("url is not null and html is not null").select("url", F.explode(F.concat(hrefs, moved)).alias("raw"))
    raw = F.regexp_replace(F.trim("raw"), r"(?i)&(amp|#38|#x26);", "&")
    return found.filter("raw <> ''").select(F.col("url").alias("source"), _absolute(raw, F.col("url")).alias("target")).filter("target is not null")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of each page."""
    links = html_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    ends = links.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")).filter("a <> b")
    # Nodes are 64-bit hashes of addresses. Of addresses with one hash only the least has it; others
    # are numbered by further hashes, so that each address is a node of its own.
    both = ends.select(F.col("a").alias("address")).unionByName(ends.select(F.col("b").alias("address"))).distinct()
    groups = both.groupBy(F.xxhash64("address").alias("hash")).agg(F.sort_array(F.collect_list("address")).alias("own"))  # one, but for collisions
    again = F.transform("own", lambda x, i: F.struct(x.alias("address"), F.when(i == 0, F.col("hash")).otherwise(F.xxhash64(x, i, F.lit("again"))).alias("node"), (i > 0).alias("met")))
    nodes = common.cut(groups.select(F.inline(again)))
    if nodes.isEmpty():
        return _verdicts(with_rule(pages.select("page_id", "url"), rules).withColumn("spread", F.lit(None).cast("string")))
    named = ends.select("a", "b", F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y"))
    if not (met := nodes.filter("met")).isEmpty():
        named = named.join(met.select(F.col("address").alias("a"), F.col("node").alias("x2")), "a", "left").join(met.select(F.col("address").alias("b"), F.col("node").alias("y2")), "b", "left")
        named = named.select(F.coalesce("x2", "x").alias("x"), F.coalesce("y2", "y").alias("y"))
    label = common.cut(connected_components(named, "x", "y"))
    # A decision is the class's: 2 if it holds an allowed address, else 1 if a blocked one.
    ranked = with_rule(nodes.withColumn("url", F.concat(F.lit("x://"), "address")), rules)
    rank = F.when(F.col("ruled") == "allow", 2).when(F.col("ruled") == "block", 1).otherwise(0)
    classed = ranked.select("node", "address", rank.alias("rank")).join(label, "node")
    decision = classed.groupBy("root").agg(F.max("rank").alias("rank"), F.count("*").alias("members"))
    decided = common.lookup(classed.select("node", "address", "root"), decision, ["root"], ["rank"], "members", label.count(), ["node"])
    judged = with_rule(pages.select("page_id", "url"), rules)
    # Urls without an address meet nothing, and are spread by their ids.
    judged = judged.withColumns({"address": address(F.col("url")), "row": F.monotonically_increasing_id()})
    judged = judged.withColumn("address", F.coalesce("address", F.concat(F.lit(" "), F.col("row").cast("string"))))
    often = judged.groupBy("address").agg(F.count("*").alias("n"))
    blocked = decided.filter("rank = 1").select("address", F.lit("block").alias("spread")).join(often, "address")
    return _verdicts(common.lookup(judged, blocked, ["address"], ["spread"], "n", pages.count(), ["row"]))


def _verdicts(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))
