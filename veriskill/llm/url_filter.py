"""URL filters: rules (verdict, host, path) indexed by their rarest literal token."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Fits `host` and its subdomains where the url's path starts with `path`; verdict is allow or block."""

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over host and path put together; a host has no slash, a path starts with one."""
        return r"^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", self.text) + ("" if self.path else "(?=/|$)")

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that any url the rule fits holds whole: labels of the host, closed segments of the path."""
        return [t for t in [*self.host.split("."), *re.split(r"[./]", self.path)[:-1]] if t]


def host_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path by the contract; both empty for a null url or one without `://`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", literal_limit: int = 1000) -> DataFrame:
    """`df` with host, path, rule (the fitting rule's text, or null) and verdict (the rule's, else `default`).

    Each rule is filed under the one of its literal tokens that the fewest urls of `df` hold (one counting pass whose
    result has a row for each rule token). A url's tokens fetch the rules filed under them, and only those run their
    regular expression; the longest that fits wins, of equally long ones a block, then the greater text. Up to
    `literal_limit` rules the index is a literal of the plan and nothing is shuffled; beyond that, distinct urls join
    the index, and the result is joined back.

    A null, empty or odd url has empty host and path and fits no rule. Repeated rows are judged alike and all kept;
    columns of `df` named as those added are replaced; an empty table or no rules give `default` everywhere.
    """
    df = df.drop(*({"host", "path", "rule", "verdict"} - {url}))
    host, path = host_of(F.col(url))
    frame = df.withColumn("__host", host).withColumn("__path", path).withColumn("__at", F.concat("__host", "__path"))
    tokens = F.array_distinct(F.split(F.col("__at"), r"[./]"))
    known = sorted({t for r in rules for t in r.tokens})
    if not rules:
        hit = F.lit(None).cast("struct<n:int,block:boolean,rule:string,verdict:string>")
    else:
        names = F.array(*map(F.lit, known))
        seen = dict(frame.select(F.explode(F.array_intersect(tokens, names)).alias("t")).groupBy("t").count().collect())
        filed: dict[str, list[Rule]] = {}
        for r in dict.fromkeys(rules):
            filed.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t)), []).append(r)
        if len(rules) <= literal_limit:
            as_struct = lambda r: F.struct(F.lit(len(r.text)).alias("n"), F.lit(r.verdict == "block").alias("block"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
            index = F.create_map(*(x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*map(as_struct, rs)))))
            found = F.flatten(F.transform(F.array_intersect(tokens, F.array(*map(F.lit, sorted(filed)))), lambda t: F.try_element_at(index, t)))
            hit = F.array_max(F.filter(found, lambda r: F.rlike(F.col("__at"), r["pattern"])))
        else:
            index = df.sparkSession.createDataFrame([(t, len(r.text), r.verdict == "block", r.text, r.verdict, r.pattern) for t, rs in filed.items() for r in rs], "t string, n int, block boolean, rule string, verdict string, pattern string")
            urls = frame.select("__at").distinct()
            fits = urls.select("__at", F.explode(tokens).alias("t")).join(index, "t").where(F.expr("__at rlike pattern")).groupBy("__at").agg(F.max(F.struct("n", "block", "rule", "verdict")).alias("__hit"))
            frame, hit = frame.join(fits, "__at", "left"), F.col("__hit")
    frame = frame.withColumn("__hit", hit)
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    return frame.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__hit.rule").alias("rule"), F.coalesce("__hit.verdict", F.lit(default)).alias("verdict"))
