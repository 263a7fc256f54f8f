"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter. Only URLs that the
filter lets pass meet the list itself, in an exact join, which removes false positives. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import bloom
from fieldspark.llm.base import lower_ascii
from fieldspark.session import materialise


@dataclass(frozen=True)
class Rule:
    """A host, which stands for its subdomains too, and how a path begins."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www., path without closing slashes, and the query's arguments in order without those that
    only track; null where there is no host."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda a: (a != "") & ~a.rlike("^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"))
    args = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(h, F.regexp_replace(path(url), "/+$", ""), F.when(args != "", F.concat(F.lit("?"), args)).otherwise(F.lit("")))
    return F.when(h != "", whole)


def rule_columns(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], blocks: int = bloom.BLOCKS) -> DataFrame:
    """One row per row of `pages` (page_id, url): host, path, canonical, rule, listed and verdict, which is the rule's, else
    block for a canonical URL among `listed` (canonical) and allow for all others, those without a host included.
    Repeated rows stay; nulls in `listed` list nothing; an empty list blocks nothing. Other columns are ignored."""
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    name, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", name.alias("rule"), verdict.alias("_ruled"))
    known = materialise(listed.select("canonical").filter("canonical is not null").distinct(), "listed")
    rows = bloom.flagged(rows, bloom.build(known, "canonical", blocks=blocks), "canonical", blocks=blocks)
    asked = F.col("_ruled").isNull() & F.col("_maybe")
    hits = rows.filter(asked).join(known.withColumn("_hit", F.lit(True)), "canonical", "left")
    rows = hits.unionByName(rows.filter(~asked).withColumn("_hit", F.lit(None).cast("boolean")))
    hit = F.coalesce("_hit", F.lit(False))
    verdict = F.coalesce("_ruled", F.when(hit, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "canonical", "rule", hit.alias("listed"), verdict.alias("verdict"))
