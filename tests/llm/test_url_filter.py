import math

import pytest
from pyspark.sql import functions as F

from larder.llm.queries import URL_RULES
from larder.llm.url_filter import Rule, UrlModel, fit, judge, labelled_from_rules, ngram_buckets
from tests.llm.helpers import DATA

ZERO = UrlModel(0.0, (0.0,) * 8)
CASES = [
    (None, "", ""), ("", "", ""), ("no scheme/at/all", "", ""), ("http://", "", ""),
    ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x"), ("//x://Y/z", "y", "/z"), ("a://b?c/d", "b", ""), ("a://b#c/d", "b", ""),
    ("a://É.Ü/Ä", "É.Ü", "/Ä"), ("http://x.net/es/" + "é" * 20_000, "x.net", "/es/" + "é" * 20_000),
]


def brute(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    stop = min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:stop]


def brute_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.pattern), default=None)


def test_parts_and_rules(spark):
    urls = [u for u, *_ in CASES] + ["http://www.example.com/en/", "http://w.www.example.com/en/1", "http://example.com/en", "http://notexample.com/en/1", "http://a.net/fr/", "http://a.net/de/", "http://net/es/1", "http://anet/es/1", "http://a.com"]
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in judge(rows, URL_RULES, ZERO).collect()}
    for i, url in enumerate(urls):
        host, path = brute(url)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (rule and rule.pattern)
        assert got[i].verdict == (rule.verdict if rule else "allow")
    assert [brute(u) for u, *_ in CASES] == [(h, p) for _, h, p in CASES]


def test_scores_are_the_models(spark):
    rows = spark.createDataFrame([(1, "http://ab.org/c"), (2, None)], "page_id long, url string")
    idx = rows.filter("page_id = 1").select(ngram_buckets(F.lit("ab.org"), F.lit("/c"), 3, 8).alias("i")).first().i
    model = UrlModel(-0.25, tuple(0.5 * i for i in range(8)))
    got = {r.page_id: r.score for r in judge(rows, [], model).collect()}
    sigmoid = lambda x: 1 / (1 + 2.718281828459045**-x)
    assert got[1] == pytest.approx(sigmoid(-0.25 + sum(0.5 * i for i in idx)))
    empty = rows.select(ngram_buckets(F.lit(""), F.lit(""), 3, 8).alias("i")).first().i
    assert empty == [] and got[2] == pytest.approx(sigmoid(-0.25))


def test_held_out_accuracy(spark):
    rules = [Rule("block", "example.net/"), Rule("allow", "example.org/")]
    pages = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/pages.parquet").select("page_id", "url")
    test = F.pmod(F.xxhash64("url"), F.lit(3)) == 0
    model = fit(labelled_from_rules(pages.filter(~test), rules))
    truth = judge(pages.filter(test), rules, model).filter("rule is not null")
    good, n = truth.select(F.sum(((F.col("score") > 0.5) == (F.col("verdict") == "block")).cast("int")), F.count("*")).first()
    assert n > 30 and good / n > 0.95


def test_no_labels_and_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    model = fit(labelled_from_rules(none, URL_RULES))
    assert model.bias == 0 and judge(none, URL_RULES, model).collect() == []


def test_repeated_urls_lose_no_label(spark):
    few = spark.createDataFrame([(i, f"http://h{i}.{('com', 'net')[i % 2]}/{('en', 'es')[i % 2]}/") for i in range(40)], "page_id long, url string")
    many = few.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50_000)))).drop("n")
    got = [sorted(map(tuple, labelled_from_rules(t, URL_RULES).collect())) for t in (few, many)]
    assert got[0] == got[1] and len(got[0]) == 40 and {y for _, y in got[0]} == {0.0, 1.0}


def test_training_against_plain_loops(spark):
    rows = [(f"http://{h}.org/{p}", float(y)) for h, p, y in (("ab", "x", 0), ("abc", "y", 0), ("spam", "buy", 1), ("spa", "buys", 1), ("ab", "buy", 1), ("zz", "", 0))]
    table = spark.createDataFrame(rows, "url string, blocked double")
    steps, rate, decay, size = 6, 0.5, 1e-4, 64
    model = fit(table, 3, size, steps, rate, decay)
    parts = [brute(u) for u, _ in rows]
    idx = [r.i for r in spark.createDataFrame([(i, *p) for i, p in enumerate(parts)], "n int, h string, p string").select("n", ngram_buckets(F.col("h"), F.col("p"), 3, size).alias("i")).orderBy("n").collect()]
    bias, w, seen = 0.0, [0.0] * size, [1e-8] * (size + 1)
    for _ in range(steps):
        errors = [1 / (1 + math.exp(-(bias + sum(w[i] for i in at)))) - y for at, (_, y) in zip(idx, rows)]
        gradient = {size: sum(errors) / len(rows)}
        for at, e in zip(idx, errors):
            for i in at:
                gradient[i] = gradient.get(i, 0.0) + e / len(rows)
        new = list(w)
        for i, g in gradient.items():
            g += decay * (bias if i == size else w[i])
            seen[i] += g * g
            if i < size:
                new[i] -= rate * g / math.sqrt(seen[i])
        g = gradient[size] + decay * bias
        bias, w = bias - rate * g / math.sqrt(seen[size]), new
    assert model.bias == pytest.approx(bias) and list(model.weights) == pytest.approx(w)
