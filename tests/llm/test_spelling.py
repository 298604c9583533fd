import random
import re
import zlib
from collections import Counter

from larder.llm import queries, spelling
from tests.llm.helpers import DATA, DOCS, awkward, documents


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(count, near=None):
    """``near``: words to look at for a word; without it all."""
    form, partners = {}, {}
    for w, n in count.items():
        partners[w] = [x for x in (near(w) if near else count) if x in count and one_edit(w, x)]
        best = min(partners[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None
    out = set()
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(partners[w]), count[form[w]] if form[w] is not None else None))
    return out


def edits(alphabet):
    return lambda w: {w[:i] + x + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for x in ["", *alphabet]}


def words_of(rows):
    count = Counter()
    for r in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0])
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def op12(docs):
    runs = spelling.runs(docs)
    return spelling.variants(spelling.counted(runs.select(queries.misspelt(runs).alias("word"))))


def test_documents(spark):
    count = words_of(documents(spark).collect())
    got = queries.op12_spelling(spark, DATA)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, got.collect())) == brute(count, edits(sorted(set("".join(count)))))
    assert any(f for _, f, *_ in brute(count, edits(sorted(set("".join(count))))))


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    assert set(map(tuple, op12(docs).collect())) == brute(words_of(docs.collect()))
    assert op12(docs.limit(0)).collect() == []


def check(spark, count):
    table = spark.createDataFrame([(w, n, "clash", 1.5) for w, n in count.items()], "word string, n long, form string, best double")
    got = list(map(tuple, spelling.variants(table).collect()))
    assert len(got) == len(count) and set(got) == brute(count)


def test_dense_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("ab", k=rng.randint(0, 7))) for _ in range(260)} | {"c" * k for k in range(9)}
    check(spark, {w: rng.choice([1, 2, 3, 10, 30, 400, 5000]) for w in words})


def test_letters_of_any_kind(spark):
    words = ["straße", "strasse", "strase", "日本語", "日本", "本語", "日本誤", "a😀b", "a😁b", "ab", "a😀", "ÿ", "", "ét", "et", "long" * 3000, "long" * 3000 + "😀", "x" + "long" * 3000]
    check(spark, {w: 10**i for i, w in enumerate(words)})


def test_chains_of_forms(spark):
    check(spark, {"a" * k: 10**k for k in range(1, 18)} | {"b": 3})


def test_ties_and_one_hot_beginning(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    check(spark, {f"beginning{a}{b}": 20 if a in "xyz" else 2 for a in letters[:14] + "xyz" for b in letters[:9]})


def test_runs(spark):
    rows = [(1, "ABCDEFG abcdefÿ×x, short lettersé1morelett"), (2, None), (None, "")]
    got = spelling.runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.run) for r in got) == [(1, "abcdefg"), (1, "abcdefÿ×x"), (1, "lettersé"), (1, "morelett")]
    assert spelling.runs(spark.createDataFrame([], DOCS)).collect() == []
