import random
from collections import defaultdict

import pyarrow as pa
import pytest

from larder.llm.components import components
from larder.llm.near_dedup import MinMax, near_dedup, plan_bands, shingle_sets
from tests.llm.helpers import DOCS, awkward, documents

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in (text or "").translate(UPPER):
        if c in SPACE:
            out, word = out + [word] if word else out, ""
        else:
            word += c
    return out + [word] if word else out


def brute(rows, k, percent):
    """(doc_id, n, component, kept) by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for a, b in {(a, b) for ids in by.values() for a in ids for b in ids if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows)


def family(seed, n, words, edits):
    """A text and n copies, each with some words changed; later ones are copies of copies."""
    rng = random.Random(seed)
    texts = [[rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(words)]]
    for _ in range(n):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(words)] = str(rng.random())
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_documents_against_all_pairs(spark, k, percent):
    docs = documents(spark)
    assert sorted(map(tuple, near_dedup(docs, k, percent).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)


@pytest.mark.parametrize("seed", [1, 2])
def test_families_whose_links_form_chains(spark, seed):
    texts = [t for f in range(6) for t in family(seed * 10 + f, 60, 60 + 20 * f, 4)]
    random.Random(seed).shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, near_dedup(docs, 3, 85).collect()))
    want = brute(rows, 3, 85)
    assert got == want
    assert 6 < sum(k for *_, k in want) < len(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = sorted(map(tuple, near_dedup(docs, 3, 85).collect()), key=str)
    named = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    want = brute(named, 3, 85) + [(None, 5, None, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert near_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_a_doc_id_with_several_texts_links_what_any_of_them_links(spark):
    one, two, three = ([" ".join(f"{w}{i}" for i in range(60))] for w in ("a", "b", "c"))
    rows = [(5, one[0]), (5, two[0]), (5, two[0]), (3, one[0] + " x"), (9, two[0] + " y"), (7, two[0]), (1, three[0]), (8, three[0] + " z"), (8, "short")]
    for parts in (1, 6):
        got = sorted(near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 3, 85).collect())
        assert [(r.doc_id, r.component_id) for r in got] == sorted([(5, 3)] * 3 + [(3, 3), (9, 3), (7, 3), (1, 1), (8, 1), (8, 1)])
        assert sorted(r.n_shingles for r in got if r.doc_id == 8) == [1, 59]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_min_max_estimates_similarity_without_bias():
    hashing = MinMax(64, 4)
    rng, found = random.Random(7), []
    for _ in range(60):
        shared = [str(rng.random()) for _ in range(300)]
        a, b = (shared + [str(rng.random()) for _ in range(100)] for _ in range(2))
        sa, sb = shingle_sets(pa.array([" ".join(a), " ".join(b)]), 1)
        found.append((hashing.signature(sa) == hashing.signature(sb)).mean())
    assert abs(sum(found) / len(found) - 300 / 500) < 0.02


def test_bands_miss_less_than_one_in_ten_million():
    for percent in (70, 80, 85, 90):
        bands, rows = plan_bands(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 1e-7
