"""Links of pages: found by rule, resolved, told apart, capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relictum.functions.markup import attribute, closed_tags
from relictum.functions.url import host_matches, host_of, refined_relation, resolve_url, without_fragment

MOST_LINKS = 500
# Fixed values: (tag pattern, attribute, relation), in the order in which links are listed.
RULES = (
    (r"<link\b[^>]*>", "href", "stylesheet"),
    (r"<script\b[^>]*>", "src", "script"),
    (r"<img\b[^>]*>", "src", "image"),
    (r"<input\b[^>]*>", "src", "image"),
    (r"<body\b[^>]*>", "background", "image"),
    (r"<t[dhr]\b[^>]*>", "background", "image"),
    (r"<(?:frame|iframe)\b[^>]*>", "src", "frame"),
    (r"<(?:embed|object)\b[^>]*>", "src", "object"),
    (r"<object\b[^>]*>", "data", "object"),
    (r"<(?:audio|video|source)\b[^>]*>", "src", "media"),
    (r"<a\b[^>]*>", "href", "link"),
    (r"<area\b[^>]*>", "href", "link"),
)
NO_LINK = r"(?i)^(?:javascript|mailto|data|about|tel|ftp|news):"


def matches(text: Column, number: int, tag: str, name: str, relation: str) -> Column:
    """What one rule finds in a page, as an array."""

    def link(found: Column, place: Column) -> Column:
        location = F.concat(F.lit("<"), F.lower(F.regexp_extract(found, r"<\s*([A-Za-z0-9]+)", 1)), F.lit(f" {name}>"))
        return F.struct(F.lit(number).alias("rule_ord"), place.alias("match_ord"), attribute(found, name).alias("raw_url"), F.lit(relation).alias("relation"), location.alias("location"))

    return F.transform(closed_tags(text, "(?i)" + tag), link)


def raw_links(pages: DataFrame, *, key: str = "page_id", text: str = "html") -> DataFrame:
    """Every attribute that a rule names, in order: key, rule_ord, match_ord, raw_url, relation, location."""
    found = [matches(F.col(text), number, *rule) for number, rule in enumerate(RULES)]
    links = pages.select(key, F.explode(F.concat(*found)).alias("l")).select(key, "l.*")
    return links.where(F.col("raw_url").isNotNull() & (F.col("raw_url") != "") & ~F.col("raw_url").startswith("#") & ~F.col("raw_url").rlike(NO_LINK))


def base_url(text: Column, url: Column) -> Column:
    """What links resolve against: the first base element, else the page's own URL."""
    tag = F.coalesce(F.get(closed_tags(text, r"(?i)<base\b[^>]*>"), 0), F.lit(""))
    return F.when(tag != "", F.coalesce(resolve_url(attribute(tag, "href"), url), url)).otherwise(url)


def discover_links(pages: DataFrame, *, key: str = "page_id", url: str = "original_url", text: str = "html", most: int = MOST_LINKS) -> DataFrame:
    """Resolved links, each (relation, URL) of a page once, at most `most` a page."""
    raw = raw_links(pages, key=key, text=text)
    based = pages.select(key, base_url(F.col(text), F.col(url)).alias("base"))
    resolved = raw.join(based, key).withColumn("resolved_url", without_fragment(resolve_url(F.col("raw_url"), F.col("base"))))
    resolved = resolved.where(F.col("resolved_url").rlike("^https?:")).withColumn("relation", refined_relation(F.col("relation"), F.col("resolved_url")))
    return capped(first_links(resolved.drop("base"), key), key, most)


def first_links(links: DataFrame, key: str) -> DataFrame:
    place = F.struct("rule_ord", "match_ord")
    return links.groupBy(key, "relation", "resolved_url").agg(F.min_by(F.struct("rule_ord", "match_ord", "raw_url", "location"), place).alias("l")).select(key, "l.rule_ord", "l.match_ord", "l.raw_url", "resolved_url", "relation", "l.location")


def capped(links: DataFrame, key: str, most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy("rule_ord", "match_ord")
    return links.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def in_scope(url: Column, hosts: list[str]) -> Column:
    """Whether a URL's host is one of the hosts or lies below one."""
    host = host_of(url)
    inside = F.lit(False)
    for h in hosts:
        inside = inside | host_matches(host, F.lit(h))
    return F.coalesce(inside, F.lit(False))


def followed(relation: Column, relations: list[str], page_links: bool) -> Column:
    return relation.isin(*relations) | (F.lit(page_links) & (relation == "link"))


def captured_targets(links: DataFrame, captured: DataFrame, *, url: str = "original_url") -> DataFrame:
    """Links to other URLs of which the collection holds a body. `captured` has one row for each URL."""
    return links.join(captured.select(F.col(url).alias("resolved_url")), "resolved_url", "left_semi").where(F.col("resolved_url") != F.col(url))
