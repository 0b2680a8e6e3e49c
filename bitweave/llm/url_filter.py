"""URL verdicts: host and path rules, then block decisions carried over redirect equivalence."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components


@dataclass(frozen=True)
class Rule:
    """host and all its subdomains, where the url's path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url):
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.substring_index(_rest(url), "/", 1)
    return F.translate(F.regexp_extract(rest, r"^[^?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url):
    at = F.locate("://", url)
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))


def node_of(url):
    """What stands for a url among its aliases: host, path and query, without scheme and fragment."""
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*(\?[^#]*)?", 1)
    return F.concat(host_of(url), path_of(url), query)


def matched(host, path, rules: list[Rule]):
    """(rule, verdict) of the longest rule that fits, as a struct; null if none. Equal lengths: allow before block."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def link_edges(pages: DataFrame) -> DataFrame:
    """(url, target) of every canonical link and meta redirect in the html, targets made absolute. Null urls and html
    have none, targets that are no urls are left out, repeated rows repeat theirs."""

    def links(batches):
        import re
        from html import unescape
        from urllib.parse import urljoin

        tag = re.compile(r"<(link|meta)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
        attr = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
        skip = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S)
        for batch in batches:
            out = []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, inside in tag.findall(skip.sub("", html)):
                    a = {k.lower(): unescape(x or y or z) for k, x, y, z in attr.findall(inside)}
                    target = None
                    if kind.lower() == "link" and "canonical" in a.get("rel", "").lower().split():
                        target = a.get("href")
                    elif kind.lower() == "meta" and a.get("http-equiv", "").lower() == "refresh":
                        m = re.search(r"url\s*=\s*['\"]?([^'\"]+)", a.get("content", ""), re.I)
                        target = m and m[1]
                    if target:
                        try:
                            out.append({"url": url, "target": urljoin(url, target.strip())})
                        except ValueError:
                            pass  # not a url: no alias
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("url", pa.string()), ("target", pa.string())]))

    some = pages.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|http-equiv")).select("url", "html")
    return some.mapInArrow(links, "url string, target string")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """Verdicts of all pages' urls: page_id, url, host, path, rule, verdict, component_blocked.

    A url's own longest rule decides. Without one, it is blocked if any url of its redirect equivalence class is
    blocked by a rule: classes are the connected components over the pages' canonical links and meta redirects and the
    optional table `redirects` (url, target). Explicit allow takes precedence over a block carried over. Everything
    else is allowed. rules is a short list (it becomes an expression).

    pages needs page_id, url and html. Null urls and urls without :// have an empty host and path, fit no rule and are
    allowed; null html has no links; repeated rows are judged alike; an empty table gives an empty result.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    ends = edges.where(F.col("target").contains("://") & F.col("url").contains("://")).select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    classes = components(ends)
    whole = F.concat(F.lit("x://"), F.col("node"))
    own = classes.withColumn("own", matched(host_of(whole), path_of(whole), rules))
    blocked = own.where(F.col("own.verdict") == "block").select("component").distinct()
    aliases = classes.join(blocked, "component").select(F.col("node").alias("_node"), F.lit(True).alias("component_blocked"))
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("_node"))
    rows = rows.withColumn("own", matched(F.col("host"), F.col("path"), rules)).join(aliases, "_node", "left")
    carried = F.coalesce("component_blocked", F.lit(False))
    verdict = F.coalesce("own.verdict", F.when(carried, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), carried.alias("component_blocked"))
