"""Operator 7, URL filters by redirect equivalence, DataFrame functions only.

A page's url is judged by the longest rule whose host is the url's or a parent domain of it and whose path the url's
path starts with. Pages without a rule of their own follow their aliases: urls joined by redirects (a meta refresh) or
canonical links, resolved against the page's own url, found over any distance by connected components. One explicitly allowed alias allows, else one
blocked alias blocks, else the page is allowed. Urls that differ by scheme, fragment or tracking parameters alone are
one node.

Edge cases: a null url, or one without "://", has an empty host and path, fits no rule and has no aliases; null or
empty html has no links; repeated rows are judged alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraspark.llm.common import components, saved, small, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
TAG = r"""(?is)<(?:link|meta)\b[^>]*>"""
CANONICAL = r"""(?is)\brel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """What aliases share: host, path and query, without scheme, fragment and tracking parameters; null if no url."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)=")), "&")
    whole = F.concat(host(url), F.regexp_replace(path(url), "/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), whole)


def resolved(to: Column, base: Column) -> Column:
    """The target of a link on the page at base, an absolute url; "" of none, or of another scheme without a host."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    whole = F.concat(origin, path(base))
    folder = F.concat(origin, F.when(path(base) == "", "/").otherwise(F.regexp_replace(path(base), "[^/]*$", "")))
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    full = (
        F.when(to == "", "").when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "")
        .when(F.startswith(to, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), to))
        .when(F.startswith(to, F.lit("/")), F.concat(origin, to))
        .when(F.startswith(to, F.lit("?")), F.concat(whole, to))
        .when(F.startswith(to, F.lit("#")), F.concat(whole, query, to))
        .otherwise(F.concat(folder, to))
    )
    # Steps "." and ".." of the path, one after the other.
    at = F.regexp_extract(full, r"(?s)^.*?://[^/?#]*", 0)
    rest = F.regexp_extract(full, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    steps = F.split(path(full), "/")
    last = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    step = lambda done, x: (
        F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.lit(1), F.size(done) - 1))).otherwise(F.concat(done, F.array(x)))
    )
    clean = F.array_join(F.concat(F.aggregate(steps, F.array().cast("array<string>"), step), last), "/")
    return F.when(path(full).rlike(r"(^|/)\.\.?(/|$)"), F.concat(at, clean, rest)).otherwise(full)


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls (url, host, path), distinct, with the rule that fits best and its action; null where none fits."""
    names = ("action", "at", "begins", "rule")
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, (a, h, p, h + p), strict=True)]) for a, h, p in rules]
    known = urls.sparkSession.range(1).select(F.inline(F.array(*rows))) if rows else urls.selectExpr(*[f"'' as {n}" for n in names]).where("false")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = (
        urls.where("host <> ''")
        .select("url", "path", F.explode(suffixes).alias("at"))
        .join(small(known), "at")
        .where(F.startswith("path", "begins"))
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
        .select("url", "best.rule", "best.action")
    )
    return urls.join(fits, "url", "left")


def links(pages: DataFrame) -> DataFrame:
    """(url, to): all redirect and canonical links of pages whose html has any."""
    tags = F.regexp_extract_all("html", F.lit(TAG), F.lit(0))
    target = lambda t: F.when(t.rlike("(?is)^<link"), F.when(t.rlike(CANONICAL), F.regexp_extract(t, HREF, 1))).otherwise(
        F.when(t.rlike(REFRESH), F.regexp_extract(t, TARGET, 1))
    )
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, "(?i)&#(0*38|x0*26);", "&"), "(?i)&amp;", "&")
    found = F.filter(F.transform(tags, lambda t: resolved(plain(target(t)), F.col("url"))), lambda x: F.contains(x, F.lit("://")))
    marked = pages.where(F.col("html").rlike(r"(?i)\b(canonical|refresh)\b") & F.contains("url", F.lit("://")))
    return marked.select("url", F.explode(F.array_distinct(found)).alias("to"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, key: str = "page_id") -> DataFrame:
    """key, url, host, path, rule and verdict of every page."""
    edges = saved(links(pages))
    urls = pages.select("url").union(edges.select("to")).where("url is not null").distinct()
    own = saved(ruled(urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules))
    group = components(edges.select(node(F.col("url")).alias("a"), node(F.col("to")).alias("b")))
    decided = own.select(node(F.col("url")).alias("node"), "action").where("node is not null and action is not null")
    spread = (
        decided.join(group, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("alias"))
        .agg(F.when(F.bool_or(F.col("action") == "allow"), "allow").otherwise("block").alias("spread"))
    )
    open_urls = own.where("action is null").select("url", node(F.col("url")).alias("node"))
    inherited = (
        open_urls.join(group, "node", "left")
        .select("url", F.coalesce("component", "node").alias("alias"))
        .join(spread, "alias")
        .select("url", "spread")
    )
    out = pages.select(F.col(key), "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    out = out.join(own.select("url", "rule", "action"), "url", "left").join(inherited, "url", "left")
    return out.withColumn("verdict", F.coalesce("action", "spread", F.lit("allow"))).drop("action", "spread")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
