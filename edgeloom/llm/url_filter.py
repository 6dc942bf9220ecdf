"""URL filters by redirect equivalence, in DataFrame operations only.

Explicit rules judge a URL by host and path. URLs that redirect to each other (a page's refresh
directive), that name each other as canonical, or that differ in their fragment alone are aliases:
connected components over those links form a class, and a class's decision holds for every member
without a rule of its own. Precedence: a URL's own rule; else, if any alias is explicitly allowed,
allow; else, if any alias is blocked, block; else allow.

Nodes are 128-bit hashes of whole URLs, so a link costs 64 bytes whatever the URLs' lengths, and
only URLs with a link enter the components. Relative targets are resolved against the page's URL.

Defined results: a null url or one without ``://`` has empty host and path, no rule and verdict
allow; null html has no links; repeated rows give repeated rows; rules of equal length that fit one
URL: allow wins; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.components import star_components
from edgeloom.storage import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for ``prefix``: a host and the start of a path, as host/path."""

    verdict: str
    prefix: str

    @property
    def host(self) -> str:
        return self.prefix.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.prefix.split("/", 1)[1] if "/" in self.prefix else ""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule's prefix that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.prefix), r.verdict, r.prefix)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, r.prefix) if out is None else out.when(fits, r.prefix)
    return F.lit(None).cast("string") if out is None else out


def _verdict(rule: Column, rules: list[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.prefix, r.verdict).otherwise(out)
    return out


def _resolve(base: Column, target: Column) -> Column:
    """An absolute URL of a link's target."""
    t = F.trim(F.regexp_replace(target, "&amp;", "&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(t == "", None)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), t)
        .when(t.startswith("//"), F.concat(scheme, t))
        .when(t.startswith("/"), F.concat(origin, t))
        .when(t.startswith("?") | t.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)[?#].*$", ""), t))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), t))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of canonical links, refresh directives and fragments of (url, html) rows."""
    html = F.coalesce(F.col("html"), F.lit(""))
    # The cheap test spares pages without either word the tag patterns.
    tags = F.when(html.rlike("(?i)canonical|refresh"), F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    href = r"(?is)\bhref\s*=\s*[\"']?([^\"'>\s]+)"
    again = r"(?is)\burl\s*=\s*['\"]?([^\"'>]+)"
    named = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b")),
        lambda t: F.when(t.rlike(r"(?is)^<link"), F.regexp_extract(t, href, 1)).otherwise(F.regexp_extract(t, again, 1)),
    )
    found = pages.where("url is not null").select("url", F.explode(F.concat(named, F.when(F.col("url").contains("#"), F.array(F.regexp_replace("url", r"(?s)#.*$", ""))).otherwise(F.array().cast("array<string>")))).alias("raw"))
    return found.select("url", _resolve(F.col("url"), F.col("raw")).alias("target")).where("target is not null and target <> url")


def judge(pages: DataFrame, rules: list[Rule], links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and alias class of every page.

    ``links`` adds known redirects as (url, target) rows, for instance from a crawl log.
    """
    own = page_links(pages.select("url", "html"))
    if links is not None:
        own = own.union(links.where("url is not null and target is not null").select("url", "target"))
    node = lambda c: F.unhex(F.md5(c))
    ends = own.select("url", "target", node("url").alias("u"), node("target").alias("v"))
    ends = materialise(ends.distinct(), "url-links")
    out = pages.select("page_id", "url")
    out = out.select("page_id", node("url").alias("__node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"))
    if ends.isEmpty():
        found = out.select("page_id", "host", "path", "rule", F.coalesce(_verdict(F.col("rule"), rules), F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_class"))
        return found
    classes = materialise(star_components(ends.select("u", "v")), "url-classes")
    urls = ends.select(F.col("url").alias("x"), F.col("u").alias("node")).union(ends.select("target", "v")).distinct()
    ruled = urls.select("node", _verdict(rule_of(host_of(F.col("x")), path_of(F.col("x")), rules), rules).alias("v")).where("v is not null")
    voted = ruled.join(classes, "node").groupBy("component").agg(F.max((F.col("v") == "allow").cast("int")).alias("allowed"))
    # Each node once on the right, and pages with no link are kept: a plain outer join on the node.
    decided = classes.join(voted, "component", "left").select(F.col("node").alias("__node"), "component", "allowed")
    joined = out.join(decided, "__node", "left")
    method = F.when(F.col("allowed") == 0, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce(_verdict(F.col("rule"), rules), method).alias("verdict"), F.lower(F.hex("component")).alias("alias_class"))
