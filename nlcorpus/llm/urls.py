"""URL filters over redirect and canonical-link equivalence, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlcorpus.llm.common import components, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that track a visit, host labels of the same site, names of a folder's own page.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*"
ALIAS_LABELS = r"^(www|m)\."
INDEX_PAGES = r"/(index\.html?)?$"

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(_part(url, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty for null or without ``://``."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def canonical(url: Column) -> Column:
    """The form that spellings of one address share: no scheme, ``www.`` or ``m.``, fragment, tracking parameters or
    closing slash. Null stays null."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.trim(F.lit("&"), F.regexp_replace(F.regexp_replace(query, f"(^|&){TRACKING}", ""), "&&+", "&"))
    return F.when(url.isNotNull(), F.concat(
        F.regexp_replace(host(url), ALIAS_LABELS, ""), F.regexp_replace(path(url), INDEX_PAGES, ""),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _without_dots(where: Column) -> Column:
    """A path without ``.`` and ``..`` segments; ``..`` at the top stays there."""
    parts = F.split(F.regexp_replace(where, r"/(\.{1,2})$", "/$1/"), "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
    step = lambda done, part: F.when(part == "..", up(done)).when(part == ".", done).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolved(target: Column, base: Column) -> Column:
    """The address that a link on page ``base`` means; null for one that is none (empty, a fragment, ``mailto:``).

    Ampersands may be written as entities. Targets without a host (``/a``, ``a``, ``../a``, ``?q``) and without a scheme
    (``//host/a``) take what they lack from the page; on a page that is no address itself they are null.
    """
    target = F.trim(F.regexp_replace(target, "(?i)&(amp|#38|#x26);", "&"))
    origin, scheme = (F.regexp_extract(base, p, 1) for p in (r"(?s)^(.*?://[^/?#]*)", r"(?s)^(.*?)://"))
    here, local = path(base), F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.when(here == "", "/").otherwise(F.regexp_replace(here, r"[^/]*$", ""))
    where = F.when(local == "", here).when(local.startswith("/"), _without_dots(local)).otherwise(
        _without_dots(F.concat(folder, local)))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when((target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
                  | (F.coalesce(origin, F.lit("")) == ""), F.lit(None).cast("string"))
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .otherwise(F.concat(origin, where, F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1))))


def declared_links(html: Column, base: Column) -> Column:
    """Addresses a page names as its own: ``rel=canonical`` links and ``refresh`` redirects. An array, maybe empty."""
    quoted = r"[\"']?([^\"'\s>]+)"
    patterns = [rf"(?i)<link\b[^>]*\brel=[\"']?canonical\b[^>]*\bhref={quoted}",
                rf"(?i)<link\b[^>]*\bhref={quoted}[^>]*\brel=[\"']?canonical\b",
                rf"(?i)<meta\b[^>]*\bhttp-equiv=[\"']?refresh\b[^>]*\burl={quoted}"]
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), 1) for p in patterns])
    whole = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: resolved(x, base))
    return F.filter(whole, lambda x: x.isNotNull())


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``(a, b)``: each address to its canonical form and to the addresses its page declares.

    Declared targets are tied to their own canonical form too. Rows with a null address give none.
    """
    page = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("a"),
                                                      declared_links(F.col(html), F.col(url)).alias("to"))
    declared = page.select("a", F.explode("to").alias("b"))
    known = page.select("a").unionByName(declared.select(F.col("b").alias("a"))).distinct()
    return known.select("a", canonical(F.col("a")).alias("b")).unionByName(declared)


def rule_matches(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule ``(verdict, host, path)`` that fits, else null.

    The rules are part of the expression: a list a person maintains, not a table that grows with the pages.
    """
    site, where = F.concat(F.lit("."), host(url)), path(url)
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = site.endswith(f".{name}") & where.startswith(prefix)
        best = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None, key: str = "page_id",
          url: str = "url", html: str = "html") -> DataFrame:
    """``(key, host, path, rule, verdict)`` for every row of ``pages``.

    A page with a rule keeps the rule's verdict. A page without one takes the decision of its equivalence class, the
    connected component over ``edges(a, b)`` (default: ``links``): allowed if an address of the class is allowed by
    a rule, else blocked if one is blocked by a rule, else allowed. Addresses that no page has but that an edge names
    count too. Null addresses have no rule and no class and are allowed; repeated rows are judged alike.
    """
    named = components(links(pages, url, html) if edges is None else edges, "aliases")
    # A flag per class, combined before the shuffle: a class with most of the pages stays a row per task. Written, so
    # that the join below meets two plain tables: it broadcasts a small one, else it can split a class that is hot.
    decided = saved(named.withColumn("m", rule_matches(F.col("node"), rules)).where(F.col("m").isNotNull())
                    .groupBy("component").agg(F.bool_or(F.col("m.verdict") == "allow").alias("allowed")), "decided")
    decision = named.join(decided, "component").select(
        F.col("node").alias("__u"), F.when(F.col("allowed"), "allow").otherwise("block").alias("__class"))
    page = pages.select(F.col(key), F.col(url).alias("__url")).withColumn("__m", rule_matches(F.col("__url"), rules))
    return page.join(decision, F.col("__url") == F.col("__u"), "left").select(
        key, host(F.col("__url")).alias("host"), path(F.col("__url")).alias("path"), F.col("__m.rule").alias("rule"),
        F.coalesce("__m.verdict", "__class", F.lit("allow")).alias("verdict"))
