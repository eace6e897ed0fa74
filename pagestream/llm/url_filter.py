"""URL filter with redirect equivalence.

Allow and block rules fit a host with its subdomains and a path prefix; the longest decides.
Addresses that redirect to one another, or name one canonical address, are one class
(connected components over those links); a class passes its decisions on to members that
no rule fits: allowed if any member is allowed, else blocked if any is blocked, else allowed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestream.llm.components import components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Query parameters that don't change what an address shows.
TRACKING = "utm_[^=&]*|gclid|fbclid|ref"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """One name for forms of an address: no scheme, fragment, default port, tracking or last slash."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, rf"(^|&)({TRACKING})=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _fitting(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest fitting rule as (rule, verdict), or null; of equally long ones allow goes first, then by text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", r.text))
    for rule in reversed(ranked):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _link(html: Column, tag: str, mark: str, value: str) -> Column:
    found = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*\b{mark}[^>]*>", 0)
    out = F.regexp_extract(found, value, 1)
    return F.when(out != "", F.replace(out, F.lit("&amp;"), F.lit("&")))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target): the canonical address and the refresh target that a page's head names."""
    html = F.col(html_col)
    canonical = _link(html, "link", r"rel\s*=\s*[\"']?canonical\b", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = _link(html, "meta", r"http-equiv\s*=\s*[\"']?refresh\b", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)")
    target, url = F.col("target"), F.col("url")
    site = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(path_of(url), r"(?s)^.*/", 0)
    whole = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )
    return (
        pages.select(F.col(url_col).alias("url"), F.explode(F.array(canonical, refresh)).alias("target"))
        .where(target.isNotNull() & url.contains("://"))
        .select("url", whole.alias("target"))
    )


def judge_urls(
    pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(id, host, path, rule, verdict, via): via is "rule", "alias" or "default".

    `redirects` (url, target) are links known from elsewhere, a crawl's log say. Null urls and
    those without :// have an empty host and path, no rule and no class, and are allowed.
    Null html names no link. Repeated rows each give a row; other columns are not read.
    """
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))

    def judged(url: Column) -> tuple[Column, Column]:
        return address_of(url), _fitting(rules, host_of(url), path_of(url))["verdict"]

    source, target = judged(F.col("url")), judged(F.col("target"))
    ends = links.select(
        source[0].alias("a"), source[1].alias("a_verdict"), target[0].alias("b"), target[1].alias("b_verdict")
    )
    classes = components(ends.select("a", "b"))
    url = F.col(url_col)
    own = pages.select(
        F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address")
    ).withColumn("own", _fitting(rules, F.col("host"), F.col("path")))

    # What rules say of each address, of pages and of links' ends; then of each class.
    said = own.select("address", F.col("own.verdict").alias("said")).unionByName(
        ends.select(F.col("a").alias("address"), F.col("a_verdict").alias("said"))
    ).unionByName(ends.select(F.col("b").alias("address"), F.col("b_verdict").alias("said")))
    rank = F.when(F.col("said") == "allow", 2).when(F.col("said") == "block", 1)
    by_address = said.where("address is not null and said is not null").groupBy("address").agg(F.max(rank).alias("rank"))
    by_class = (
        classes.join(by_address, classes["node"] == by_address["address"])
        .groupBy("component").agg(F.max("rank").alias("class_rank"))
    )
    passed = classes.join(by_class, "component").select(F.col("node").alias("address"), F.col("class_rank").alias("rank"))
    decided = by_address.unionByName(passed).groupBy("address").agg(F.max("rank").alias("rank"))
    alias = F.when(F.col("rank") == 2, "allow").when(F.col("rank") == 1, "block")
    return own.join(decided, "address", "left").select(
        id_col, "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), alias, F.lit("allow")).alias("verdict"),
        F.when(F.col("own.verdict").isNotNull(), "rule").when(alias.isNotNull(), "alias").otherwise("default").alias("via"),
    )
