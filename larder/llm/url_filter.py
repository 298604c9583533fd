"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame expressions only. The model is trained by full-batch gradient steps over a small labelled URL table; each step
is one aggregation whose result has at most ``buckets`` rows.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from larder.llm.common import materialise

#: Hashed n-gram buckets; also the bound of what one training step sends to the driver.
BUCKETS = 4096
#: Labelled URLs taken for each verdict when the labelled table is drawn from rule decisions.
SAMPLE_PER_VERDICT = 2048


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host and path as in ``example.com/en/``; it holds for the host and all its subdomains."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        _, slash, rest = self.pattern.partition("/")
        return slash + rest


@dataclass(frozen=True)
class UrlModel:
    bias: float
    weights: tuple[float, ...]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def rule_column(host: Column, path: Column, rules: list[Rule], value: str) -> Column:
    """The pattern or verdict of the longest rule that fits, else null. Rules are a short list, tested longest first."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, getattr(r, value)) if out is None else out.when(fits, getattr(r, value))
    return F.lit(None).cast("string") if out is None else out


def ngram_buckets(host: Column, path: Column, n: int = 3, buckets: int = BUCKETS) -> Column:
    """Distinct hashed n-grams of ``^host$`` and ``^path$``, each kind with its own prefix."""

    def grams(text: Column, kind: str) -> Column:
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        places = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(kind), *[F.get(chars, i + k) for k in range(n)]), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(grams(host, "h"), grams(path, "p")))


def _margin(idx: Column, model: UrlModel) -> Column:
    table = F.split(F.lit(",".join(repr(w) for w in model.weights)), ",").cast("array<double>")  # folded to one literal
    return F.aggregate(idx, F.lit(model.bias), lambda s, i: s + F.get(table, i))


def labelled_from_rules(pages: DataFrame, rules: list[Rule], per_verdict: int = SAMPLE_PER_VERDICT) -> DataFrame:
    """A small labelled table (url, blocked): of the distinct urls that a rule decides, the first by hash for each verdict.

    Distinct urls are counted (approximately) by verdict, and only those whose hash lies in a share of some three times
    the sample are made distinct and ordered, so the table is not shuffled.
    """
    host, path = host_and_path(F.col("url"))
    ruled = pages.select("url", rule_column(host, path, rules, "verdict").alias("v")).filter("v is not null")
    urls = {r["v"]: r["count"] for r in ruled.groupBy("v").agg(F.approx_count_distinct("url").alias("count")).collect()}
    draw = F.pmod(F.xxhash64("url"), F.lit(1 << 31))
    parts = [
        ruled.filter((F.col("v") == v) & (draw < min(1 << 31, 3 * per_verdict * (1 << 31) // urls[v]))).select("url", draw.alias("draw")).distinct().orderBy("draw", "url").limit(per_verdict)
        .select("url", F.lit(float(v == "block")).alias("blocked"))
        for v in ("allow", "block") if urls.get(v)
    ]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else ruled.select("url", F.lit(0.0).alias("blocked")).limit(0)


def fit(labelled: DataFrame, n: int = 3, buckets: int = BUCKETS, steps: int = 24, rate: float = 0.5, decay: float = 1e-4) -> UrlModel:
    """Train on a small labelled table (url, blocked in 0..1). An empty table gives the zero model, which allows."""
    host, path = host_and_path(F.col("url"))
    rows = materialise(labelled.select(F.col("blocked").cast("double").alias("y"), ngram_buckets(host, path, n, buckets).alias("idx")).coalesce(2), "url-labels")
    bias, w, seen = 0.0, [0.0] * buckets, [1e-8] * (buckets + 1)
    for _ in range(steps):
        error = F.lit(1.0) / (F.lit(1.0) + F.exp(-_margin(F.col("idx"), UrlModel(bias, tuple(w))))) - F.col("y")
        gradient = (
            rows.select(error.alias("e"), F.explode(F.concat("idx", F.array(F.lit(buckets)))).alias("i"))
            .groupBy("i").agg(F.avg("e").alias("m"), F.sum("e").alias("g"), F.count("*").alias("n"))
            .collect()
        )
        if not gradient:
            break
        total = max(r["n"] for r in gradient)
        for r in gradient:
            g, i = r["g"] / total, r["i"]
            g += decay * (bias if i == buckets else w[i])
            seen[i] += g * g
            step = rate * g / math.sqrt(seen[i])
            if i == buckets:
                bias -= step
            else:
                w[i] -= step
    return UrlModel(bias, tuple(w))


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, n: int = 3) -> DataFrame:
    """Every row of ``pages``: page_id, host, path, rule, verdict, score (the model's probability of block).

    A null url or one without ``://`` has empty host and path and is judged by the model's bias. Repeated rows are
    judged alike; only page_id and url are read.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-_margin(ngram_buckets(h, p, n, len(model.weights)), model)))
    out = base.select("page_id", "host", "path", rule_column(h, p, rules, "pattern").alias("rule"), rule_column(h, p, rules, "verdict").alias("v"), score.alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("v", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
