"""Words found by the automaton equal those found one by one, and so do the columns made of either."""

import random
import time

import pytest
from pyspark.sql import functions as F

from larder.functions import patterns, text
from larder.operators import matching


def plain(words, t, outer):
    held = [i for i, w in enumerate(words) if w in t]
    return [i for i in held if not (outer and any(words[j] != words[i] and words[i] in words[j] for j in held))]


@pytest.mark.parametrize("letters", ["ab", "가나다 ", "a😀b"])
@pytest.mark.parametrize("outer", [False, True])
def test_random_words(letters, outer):
    rnd = random.Random(letters)
    make = lambda most: "".join(rnd.choice(letters) for _ in range(rnd.randrange(most)))
    for _ in range(60):
        words = list(dict.fromkeys(make(6) for _ in range(rnd.randrange(1, 30))))
        texts = [make(20) for _ in range(30)] + [""]
        assert patterns.Automaton(words).held(texts, outer) == [plain(words, t, outer) for t in texts]


def test_no_words_no_texts_and_slices(monkeypatch):
    assert patterns.Automaton([]).held(["a", ""], True) == [[], []] and patterns.Automaton(["a"]).held([], False) == []
    monkeypatch.setattr(patterns, "SLICE", 3)
    assert patterns.Automaton(["a", "ba"]).held(["xbax", "a", "", "bbbbbbbbba"], True) == [[1], [0], [], [1]]


def test_columns_are_equal_either_way(spark, monkeypatch):
    rnd = random.Random(5)
    make = lambda most: "".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, most)))
    words = [(make(5), rnd.choice(["RICE", "SOUP", "MEAT", "-"])) for _ in range(60)]
    brands = list(dict.fromkeys(w for w, _ in words[:20]))
    names = [(i, make(25)) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(names, "id int, name string").repartition(3)
    foods = df.select(F.col("name").alias("company_name"), F.col("id").alias("food_code"), F.lit("x").alias("normalized_name"))

    def columns():
        got = df.select("id", text.keyword_tags(F.col("name"), words).alias("tags"), matching.brand_of(F.col("name"), brands).alias("brand"), text.has_term(F.col("name"), brands).alias("has"))
        return sorted(map(tuple, got.collect())), sorted(map(tuple, matching.pools(foods, brands).select("food_code", "pool").collect()))

    few = columns()
    monkeypatch.setattr(patterns, "MOST_EXPRESSIONS", 0)
    monkeypatch.setattr(text, "MOST_EXPRESSIONS", 0)
    assert columns() == few


def test_cost_does_not_grow_with_the_words():
    rnd = random.Random(6)
    make = lambda n: "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(n))
    texts = [make(40) for _ in range(20_000)]
    few, many = patterns.Automaton([make(6) for _ in range(50)]), patterns.Automaton([make(6) for _ in range(5_000)])

    def seconds(a):
        began = time.process_time()
        a.held(texts, True)
        return time.process_time() - began

    assert min(seconds(many) for _ in range(3)) < 4 * min(seconds(few) for _ in range(3))
