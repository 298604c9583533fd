"""Operators over repeated rows and other tables on which a cut of the input would show."""

import numpy as np

from larder.llm import langid
from larder.llm.url_filter import Rule, labelled_from_rules

WORDS = {"de": "das ist ein kurzer satz", "en": "this is one short line", "es": "esta es una frase corta", "fr": "voici une phrase assez courte"}


def rows_of_words(repeats):
    return [(10 * j + i, " ".join(w.split()[: 2 + i % 4]) + " " + "abcdefghij"[i] * 3, g) for j, (g, w) in enumerate(WORDS.items()) for i in range(10) for _ in range(repeats(10 * j + i))]


def test_repeated_rows_count_once(spark):
    train = lambda repeats: langid.train(spark.createDataFrame(rows_of_words(repeats), "doc_id long, text string, lang string"), sample_rows=40)
    once = train(lambda i: 1)
    assert once.langs == ("de", "en", "es", "fr")
    for repeats in (lambda i: 30, lambda i: 500 if i == 0 else 1):  # every row; one id of the first language
        got = train(repeats)
        assert got.langs == once.langs and np.array_equal(got.centroids, once.centroids)


def test_repeated_urls_leave_the_labelled_sample_whole(spark):
    rules = [Rule("block", "bad.test/"), Rule("allow", "good.test/")]
    once = spark.createDataFrame([(f"https://{h}.test/p{i}",) for h in ("bad", "good") for i in range(20)], "url string")
    many = once.crossJoin(spark.range(500)).select("url")
    rows = lambda pages: sorted(map(tuple, labelled_from_rules(pages, rules, per_verdict=10).collect()))
    assert len(rows(once)) == 20 and rows(many) == rows(once)
