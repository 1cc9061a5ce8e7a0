"""URL rules, propagated over redirect and canonical-link equivalence.

A page is judged by the longest rule that fits its host (or a parent domain)
and the start of its path. Pages without a rule take the decision of their
aliases: addresses joined by redirects and canonical links form components, and
a component in which some address has a blocking rule blocks its other
members, except those that an explicit rule allows.

DataFrame and SQL functions only.

Defined results
- A null url, or one without ``://``, has an empty host and path, no rule and
  no alias; it is allowed.
- Of rules of equal length, allow goes before block.
- A null or empty html has no links. Repeated rows are judged alike.
- An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import written
from strataweave.llm.components import connected_components

_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """What two spellings of one address share: host, path and query; null if there is no host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, path_of(url), F.coalesce(F.regexp_extract(url, _ADDRESS, 3), F.lit(""))))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(size, allowed, rule) of the longest fitting rule (verdict, host, path), or null."""
    listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v == "allow").alias("allowed")) for v, h, p in rules])
    fits = lambda r: ((host == r.host) | host.endswith(F.concat(F.lit("."), r.host))) & path.startswith(r.path)
    return F.array_max(
        F.transform(
            F.filter(listed, fits),
            lambda r: F.struct((F.length(r.host) + F.length(r.path)).alias("size"), r.allowed.alias("allowed"), F.concat(r.host, r.path).alias("rule")),
        )
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and immediate redirects that a page's html declares."""
    html = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b""")
    refresh = lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""")
    href = lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?\s*([^\s"'>]+)""", 1)
    aim = lambda t: F.regexp_extract(t, r"""(?i)\bcontent\s*=\s*["']?\s*[\d.]+\s*[;,]\s*url\s*=\s*["']?\s*([^\s"'>]+)""", 1)
    found = pages.where(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", F.explode(tags).alias("tag"))
    link = F.when(canonical(F.col("tag")), href(F.col("tag"))).when(refresh(F.col("tag")), aim(F.col("tag")))
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    base = F.concat(F.lit("http://"), host_of(F.col("url")))
    target = (
        F.when(F.col("link").contains("://"), F.col("link"))
        .when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link")))
        .when(F.col("link").startswith("/"), F.concat(base, F.col("link")))
        .otherwise(F.concat(base, F.coalesce(F.nullif(F.regexp_extract(path_of(F.col("url")), r"(?s)^.*/", 0), F.lit("")), F.lit("/")), F.col("link")))
    )
    return found.withColumn("link", link).where(F.col("link") != "").select("url", target.alias("target"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component for pages (page_id, url, html).

    ``redirects``: further alias edges (url, target), such as a crawl's 3xx answers.
    """
    pages = pages.select("page_id", "url", "html")
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("url", "target"))
    edges = written(links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).where("a <> b").distinct(), "aliases")
    members = connected_components(edges)

    as_url = F.concat(F.lit("x://"), F.col("node"))
    decided = members.withColumn("own", best_rule(host_of(as_url), path_of(as_url), rules))
    blocked = decided.where(~F.col("own.allowed")).select("component").distinct().withColumn("blocked", F.lit(True))
    aliases = members.join(blocked, "component", "left").select("node", "component", F.coalesce("blocked", F.lit(False)).alias("blocked"))

    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.withColumn("own", best_rule(F.col("host"), F.col("path"), rules)).join(aliases, "node", "left")
    blocks = F.coalesce(~F.col("own.allowed"), F.col("blocked"), F.lit(False))
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.when(blocks, "block").otherwise("allow").alias("verdict"), "component")
