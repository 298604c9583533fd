import math

import numpy as np
from pyspark.sql import functions as F

from larder.llm import langid
from larder.llm.queries import held_out, op9_langid
from tests.llm.helpers import DATA, DOCS, awkward


def test_held_out_accuracy(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    got = op9_langid(spark, sf).join(truth, "doc_id")
    n, good, lost = got.filter("held_out").select(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 250 and good / n > 0.95 and lost / n < 0.02
    assert got.filter("score < 0 or score > 1").isEmpty()


def test_held_out_rows_are_never_learnt_from(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    a = langid.train(docs.filter(~held_out(docs)))
    odd = docs.withColumn("text", F.when(held_out(docs), F.lit("zzz qqq")).otherwise(F.col("text")))
    b = langid.train(odd.filter(~held_out(odd)))
    assert a.langs == b.langs and np.array_equal(a.centroids, b.centroids)


def test_awkward_rows(spark):
    docs = awkward(spark).union(spark.createDataFrame([(20, "123 !!", "en", "s", 6, None)], DOCS))
    model = langid.train(docs)
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(docs, model).collect()}
    assert {(3, "und", True), (4, "und", True), (5, "und", True), (20, "und", True)} <= got
    assert {p for _, p, _ in got} <= {"und", "en", "de", "fr"}
    assert langid.keep_known(docs, model).columns == docs.columns
    empty = langid.train(docs.limit(0))
    assert empty.langs == () and {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).collect() == []


def test_far_text_is_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(docs)
    odd = ["ыфва олджэ йцукен " * 20, "日本語のテキスト" * 20]
    assert model.predict(odd)[2] == [True, True]


def test_counts_against_plain_loops():
    text = "Straße  zum\nMeer"
    data = langid.vector_bytes(text)
    want = np.zeros(langid.DIMS, np.float32)
    for n in langid.SIZES:
        for i in range(len(data) - n + 1):
            code = 0
            for b in data[i : i + n]:
                code = (code * 257 + b) % 2**32
            want[(code + n) % 2**32 * 2654435761 % 2**32 >> 20] += 1
    assert data == " straße zum meer ".encode() and np.array_equal(langid.counts(data), want)


def test_repeated_rows_lose_no_language_and_no_document(spark):
    words = {"aa": "banana cabana", "bb": "zwolf schloss", "zz": "kiryuu oyuki", "zx": "quoi peux"}
    few = spark.createDataFrame([(100 * j + i, f"{w} {'xyzuvw'[i % 6]}{i}", g) for j, (g, w) in enumerate(words.items()) for i in range(10)], "doc_id long, text string, lang string")
    many = few.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n")
    one, all_ = langid.train(few), langid.train(many)
    assert one.langs == all_.langs == tuple(sorted(words)) and np.array_equal(one.centroids, all_.centroids)


def test_nearest_centroid_against_plain_loops(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    texts = [r.text for r in docs.collect()][:60] + ["x", "été", "ыфва", None]
    lang, score, rejected = model.predict(texts)
    for text, g, s, out in zip(texts, lang, score, rejected):
        if not text:
            assert (g, s, out) == ("und", 0.0, True)
            continue
        tally = {}
        for at, n in enumerate(langid.counts(langid.vector_bytes(text)).tolist()):
            if n:
                tally[at] = math.log(1 + n) * float(model.idf[at])
        size = math.sqrt(sum(v * v for v in tally.values())) or 1.0
        cosines = [sum(v / size * float(c[at]) for at, v in tally.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=lambda j: cosines[j])
        assert g == model.langs[model.owner[best]] and abs(s - cosines[best]) < 1e-4 and out == (1 - cosines[best] > model.reach[best])


def test_clustering_against_plain_loops():
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(40, 6))) + 3 * np.eye(6)[rng.integers(0, 3, 40)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, dot = x.tolist(), lambda a, b: sum(p * q for p, q in zip(a, b))
    mean = lambda part: [sum(c) / len(part) for c in zip(*part)]
    centres = [mean(rows)]
    while len(centres) < 3:  # the row farthest from all centres so far
        centres.append(min(rows, key=lambda r: max(dot(r, c) for c in centres)))
    for _ in range(12):
        centres = [[v / math.sqrt(dot(c, c)) for v in c] for c in centres]
        near = [max(range(3), key=lambda j: dot(r, centres[j])) for r in rows]
        centres = [mean([r for r, m in zip(rows, near) if m == j]) if j in near else centres[j] for j in range(3)]
    centres = [[v / math.sqrt(dot(c, c)) for v in c] for c in centres]
    assert np.allclose(langid._kmeans(x, 3), centres)


def test_every_labelled_language_is_learned(spark):
    rng = np.random.default_rng(2)
    letters = [chr(0x4E00 + i) for i in range(600)]
    rows = [(i, "".join(rng.choice([letters[i], letters[(i * 7 + 1) % 600], " "], 60)), f"g{i:03d}") for i in range(600)] + [(1000, None, "none"), (1001, "123", "digits")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=100)
    assert model.langs == tuple(f"g{i:03d}" for i in range(600))
