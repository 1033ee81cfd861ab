"""URL filters by rules and redirect equivalence, with built-in functions only.

A rule fits a host, its subdomains and a path prefix; the longest fitting rule decides. Redirects,
canonical links and resource-equal forms of an address are edges; a URL without a rule takes the
decision of the addresses in its connected component, where an explicit allow comes before a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.staging import stage
from quire.llm.graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path
#: Query parameters that name a campaign and not a resource (fixed values).
CAMPAIGN = r"(?:utm_[a-z]+|gclid|fbclid|ref)"
#: Character references, decimal, hexadecimal and by name.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"
NAMED = {"apos": 39, **name2codepoint}
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """Path up to ``?`` or ``#``; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def resource(url: Column) -> Column:
    """The address without fragment and campaign parameters: what a server is asked for."""
    bare = F.regexp_replace(url, r"#[\s\S]*$", "")
    kept = F.regexp_replace(bare, rf"(?<=[?&]){CAMPAIGN}=[^&]*(?:&|$)", "")
    return F.regexp_replace(kept, r"[?&]+$", "")


def decoded(text: Column) -> Column:
    """``text`` with its character references replaced by their characters, once; unknown ones stay."""
    names = F.create_map(*[x for name, code in NAMED.items() for x in (F.lit(name), F.lit(chr(code)))])

    def character(r):
        body = F.substring(r, F.lit(2), F.length(r) - 2)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).otherwise(F.substring(body, F.lit(2), F.length(body))).cast("int")
        fine = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        written = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(F.startswith(body, F.lit("#")), F.when(fine, written).otherwise(r)).otherwise(F.coalesce(F.try_element_at(names, body), r))
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), character), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.split(text, REFERENCE, -1), found, lambda gap, c: F.concat(gap, c)), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _without_dots(path_: Column) -> Column:
    """A path that begins with a slash, its ``.`` and ``..`` segments resolved."""
    parts = F.split(path_, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
                       lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(p == ".", out).otherwise(F.concat(out, F.array(p))))
    folder = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path_.rlike(r"/\.{1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), folder)).otherwise(path_)


def resolved(target: Column, base: Column) -> Column:
    """The address that ``target`` names on a page at ``base``; null without ``://`` in the end, as for mail or script."""
    site = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    here = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.when(here == "", F.lit("/")).otherwise(F.regexp_extract(here, r"^([\s\S]*/)[^/]*$", 1))
    named = F.regexp_extract(target, r"^([^?#]*)", 1)
    rest = F.substring(target, F.length(named) + 1, F.length(target))
    inside = (F.when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)//", 1), target))
              .when(F.startswith(target, F.lit("/")), F.concat(site, _without_dots(named), rest))
              .when(F.startswith(target, F.lit("?")), F.concat(site, here, target))
              .when(F.startswith(target, F.lit("#")), F.concat(F.regexp_replace(base, r"#[\s\S]*$", ""), target))
              .otherwise(F.concat(site, _without_dots(F.concat(folder, named)), rest)))
    return F.when(target.rlike(SCHEME), F.when(F.contains(target, F.lit("://")), target)).when((site != "") & (target != ""), inside)


def page_links(html: Column, url: Column) -> Column:
    """Addresses that a page names as its own: canonical link, ``og:url`` and an immediate refresh; null-free array.

    References are decoded and relative addresses resolved against the page's ``base`` or its own ``url``.
    """
    value = r"""[^>]{0,2000}?%s\s*=\s*["']?([^"'\s>]+)"""
    tag = r"(?is)<%s\b(?=[^>]{0,2000}?%s)" + value
    refresh = r"""(?is)<meta\b(?=[^>]{0,2000}?http-equiv\s*=\s*["']?refresh)[^>]{0,2000}?content\s*=\s*["']?\s*[0-9]+\s*;\s*url\s*=\s*["']?([^"'\s>]+)"""
    text = F.coalesce(html, F.lit(""))
    found = F.concat(
        F.regexp_extract_all(text, F.lit(tag % ("link", r"""rel\s*=\s*["']?canonical\b""", "href")), 1),
        F.regexp_extract_all(text, F.lit(tag % ("meta", r"""property\s*=\s*["']?og:url\b""", "content")), 1),
        F.regexp_extract_all(text, F.lit(refresh), 1))
    stated = F.regexp_extract(text, r"(?is)<base\b" + value % r"\bhref", 1)
    # arrays bind what they hold, so that the base and each decoded target are found once
    page = F.transform(F.transform(F.array(stated), decoded), lambda b: F.struct(found.alias("f"), F.coalesce(resolved(b, url), url).alias("b")))
    based = F.transform(page, lambda x: F.transform(F.transform(x["f"], decoded), lambda u: resolved(u, x["b"])))
    return F.filter(F.flatten(based), lambda u: u.isNotNull())


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between addresses: page to canonical or redirect target, and to the resource asked for."""
    linked = F.when(F.col("html").rlike(r"(?i)canonical|og:url|http-equiv"), page_links(F.col("html"), F.coalesce("url", F.lit("")))).otherwise(F.array().cast("array<string>"))
    source = stage(pages.where("url IS NOT NULL").select("url", "html"), _linked=linked)
    targets = F.concat("_linked", F.array(resource(F.col("url"))))
    first = source.select(F.col("url").alias("a"), F.explode(targets).alias("b"))
    second = first.select(F.col("b").alias("a"), resource(F.col("b")).alias("b"))
    return first.unionByName(second).where("a <> b").distinct()


def rule_of(rules: Sequence[Rule], host_col: Column, path_col: Column) -> Column:
    """The longest rule that fits, as struct ``rule``, ``verdict``; null if none does.

    ``rules`` is a configured list and becomes part of the plan (a few thousand at most). Of equal
    rules with different verdicts the allow wins. Fits are looked up by host suffix, so the work
    for a row follows its number of labels and the rules of those hosts.
    """
    for verdict, _, _ in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict}")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list[Rule]] = {}
    for r in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r)):
        by_host.setdefault(r[1], []).append(r)
    table = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*[
        F.struct(F.lit(len(h + p)).alias("size"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, _, p in own]))])
    labels = F.split(host_col, r"\.")
    # suffixes from the whole host downwards: the first that has a fitting rule need not be the longest rule, so all are kept
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.flatten(F.transform(suffixes, lambda s: F.filter(
        F.coalesce(F.try_element_at(table, s), F.array().cast("array<struct<size:int,path:string,rule:string,verdict:string>>")),
        lambda r: F.startswith(path_col, r["path"]))))
    best = F.array_sort(fits, lambda x, y: F.when(x["size"] != y["size"], y["size"] - x["size"]).when(x["verdict"] == "allow", -1).otherwise(1))
    first = F.get(best, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None) -> DataFrame:
    """Judge every page: its columns plus ``host``, ``path``, ``rule``, ``verdict`` and ``via``.

    ``edges(a, b)`` are redirects known otherwise; those found in the pages are added. ``via`` says
    what decided: ``rule``, ``alias`` (an address of the component has a rule) or ``default``.
    Null URLs and URLs without ``://`` have an empty host and path, no rule and no alias, and are
    allowed. Repeated rows are all returned; columns of the pages with the names of the result
    are replaced. An empty table gives an empty result.
    """
    fresh = ("host", "path", "rule", "verdict", "via", "url_decision")
    base = pages.drop(*[c for c in pages.columns if c.lower() in fresh])
    own = base.select("*", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    own = own.withColumn("url_decision", rule_of(rules, F.col("host"), F.col("path")))
    found = page_edges(pages.select("url", "html"))
    links = found if edges is None else found.unionByName(edges.select(F.col("a").cast("string"), F.col("b").cast("string")))
    parts = connected_components(links)
    judged = parts.select("node", "component", rule_of(rules, host(F.col("node")), path(F.col("node"))).alias("d"))
    decided = judged.groupBy("component").agg(
        F.max(F.when(F.col("d.verdict") == "allow", 1)).alias("allowed"), F.max(F.when(F.col("d.verdict") == "block", 1)).alias("blocked"))
    alias = (judged.where("d IS NULL").join(decided.where("allowed = 1 OR blocked = 1"), "component")
             .select(F.col("node").alias("url"), F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("alias_verdict")))
    # only undecided addresses meet the components
    ruled, open_ = own.where("url_decision IS NOT NULL"), own.where("url_decision IS NULL")
    met = open_.join(alias, "url", "left")
    done = ruled.withColumn("alias_verdict", F.lit(None).cast("string")).unionByName(met)
    verdict = F.coalesce(F.col("url_decision.verdict"), F.col("alias_verdict"), F.lit("allow"))
    via = F.when(F.col("url_decision").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default")
    return done.select(*base.columns, "host", "path", F.col("url_decision.rule").alias("rule"), verdict.alias("verdict"), via.alias("via"))


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as a table, for reports."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")
