"""URL filters: a trie over reversed host labels, then path segments, with the longest matching rule winning.

A rule is (action, host, path).  It fits its host and every subdomain of it, where the URL's path starts with the
rule's path.  The trie goes down the host's labels from the last one (``com``, ``example``), and at the end of each
rule's host hangs a second trie over the path's whole segments (``/en/`` is the segment ``en/``); what a rule has
after its last slash (``7`` of ``/en/7``) is a partial segment, kept at the node it ends in and compared as a prefix.
A lookup therefore walks the labels and segments of one URL and never looks at other rules.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; an empty host fits no
rule; among matching rules the one with the most code points of host and path together wins, then the longer host,
then ``block`` before ``allow``; repeated rules count once; a rule with an empty host is refused; repeated rows and
extra columns stay as they are (result columns that clash with existing ones replace them); an empty table stays empty.

Scale: no shuffle.  A trie is broadcast only up to `max_rules` rules; a longer list is cut into tries of that size,
applied one after the other with the longer match kept, so that no broadcast grows with the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticore.llm.common import need

Rule = tuple[str, str, str]
#: Rules in one broadcast trie: some tens of MB at most.
MAX_RULES = 200_000

MATCH = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
_PARTS = re.compile(r"[^/]*/?")


class UrlTrie:
    """The compiled rules.  A node is [children by label or segment, path root or None, {partial segment: (rule, action)}]."""

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for action, host, path in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"not allow or block: {action!r}")
            if not host:
                raise ValueError("a rule needs a host")
            node = self.root
            for label in reversed(_lower(host).split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            if path and not path.startswith("/"):
                raise ValueError(f"a rule's path starts with a slash: {path!r}")
            node = node.setdefault("path", {})
            *whole, part = _segments(path)
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if ends.get(part, (None, "allow"))[1] == "allow":
                ends[part] = (_lower(host) + path, action)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the winning rule."""
        best, key = None, (-1, -1)
        node, depth = self.root, 0
        segments = None
        for label in reversed(host.split(".")) if host else ():
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            depth += len(label) + 1
            if "path" in node:
                segments = segments or _segments(path)
                for found in _path_matches(node["path"], segments):
                    if (k := (len(found[0]), depth)) > key or k == key and found[1] == "block":
                        best, key = found, k
        return best


def _path_matches(node: dict, segments: list[str]) -> Iterator[tuple[str, str]]:
    for segment in segments:
        ends = node.get("ends", {})
        if len(ends) <= len(segment):
            yield from (found for part, found in ends.items() if segment.startswith(part))
        else:
            yield from (ends[segment[:k]] for k in range(len(segment) + 1) if segment[:k] in ends)
        node = node.get("next", {}).get(segment)
        if node is None:
            return


def _segments(path: str) -> list[str]:
    """'/en/7' is ['/', 'en/', '7'], '/en/' is ['/', 'en/', '']: whole segments and then a partial one."""
    return _PARTS.findall(path)[: path.count("/") + 1]


def _lower(host: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filter(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """pages with host, path, rule (host and path of the winning rule, else null) and verdict (its action, else `default`)."""
    need(pages, url)
    spark = pages.sparkSession
    rules = list(dict.fromkeys((a, _lower(h), p) for a, h, p in rules))
    out = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    best = F.lit(None).cast(MATCH)
    for a in range(0, len(rules), max_rules):
        trie = spark.sparkContext.broadcast(UrlTrie(rules[a : a + max_rules]))

        found = _lookup(trie)(F.col("host"), F.col("path"))
        if a:
            out = out.withColumn("_found", found)
            found = F.col("_found")
            longer = F.length(found.rule) > F.coalesce(F.length(F.col("_best.rule")), F.lit(-1))
            tie = (F.length(found.rule) == F.length(F.col("_best.rule"))) & (found.verdict == "block")
            found = F.when(longer | tie, found).otherwise(F.col("_best"))
        out = out.withColumn("_best", found).drop("_found")
        best = F.col("_best")
    return out.withColumns({"rule": best.rule, "verdict": F.coalesce(best.verdict, F.lit(default))}).drop("_best")


def _lookup(trie):
    @F.pandas_udf(MATCH)
    def lookup(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        return pd.DataFrame([match(h, p) or (None, None) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"], index=host.index, dtype=object)

    return lookup


#: The rules of the registered query.
RULES: list[Rule] = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every url of pages judged by RULES."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM parts)
"""
