"""Language ID: nearest of several clustered centroids per language, by cosine of TF-IDF n-gram vectors.

A text's vector counts hashed byte n-grams of its lower-cased whole text. Training takes a bounded sample of labelled
rows; IDF and centroids (spherical k-means within each language) come from it; a centroid that mostly draws other
languages' rows is dropped. A prediction whose distance to the nearest centroid is far beyond the training texts' is
marked rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from larder.llm.common import give_back, materialise, own_worker, parts_of, prepare

DIMS = 4096
SIZES = (2, 3)
#: Labelled rows taken for training, over all languages; rows for each are this over the number of languages.
SAMPLE_ROWS = 2400
CENTROIDS = 4
#: How much of what is left from the farthest training text to a right angle is still within reach.
SLACK = 0.6
NO_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def counts(text: bytes) -> np.ndarray:
    """Hashed n-gram counts of one text's bytes."""
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(DIMS, dtype=np.float32)
    code = b
    for n in range(2, max(SIZES) + 1):
        if len(b) < n:
            break
        code = code[:-1] * np.uint32(257) + b[n - 1 :]
        if n in SIZES:
            out += np.bincount((((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int32), minlength=DIMS)
    return out


def vector_bytes(text: str | None) -> bytes:
    """What the vectors see: lower-cased text, runs of white space, digits and ASCII marks as single spaces, one at either end."""
    return b" " + b" ".join((text or "").lower().encode().translate(NO_LETTERS).split()) + b" "


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # one row per centroid, unit length
    owner: np.ndarray  # index into langs per centroid
    reach: np.ndarray  # greatest accepted cosine distance per centroid

    def weigh(self, rows: np.ndarray) -> np.ndarray:
        x = np.log1p(rows) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score (cosine, cut to 0..1) and whether the distance is out of reach."""
        if not texts:
            return [], [], []
        lang, score, out = [], [], []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            known = np.array([bool(self.langs) and has_letter(t) for t in part])
            if not self.langs:
                near, best = np.zeros(len(part), int), np.zeros(len(part))
            else:
                cos = self.weigh(np.stack([counts(vector_bytes(t)) for t in part])) @ self.centroids.T
                near = cos.argmax(axis=1)
                best = cos[np.arange(len(part)), near]
            for k, j, c in zip(known.tolist(), near.tolist(), best.tolist()):
                lang.append(self.langs[self.owner[j]] if k else "und")
                score.append(min(1.0, max(0.0, float(c))) if k else 0.0)
                out.append(not k or 1 - c > self.reach[j])
        return lang, score, out


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, seeded by farthest points from the mean, without chance."""
    centres = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[(x @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (x @ c.T).argmax(axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit on (doc_id, text, lang). Rows with null lang or without a letter are left out.

    At most ``sample_rows`` documents are used (one for each language, where there are more languages), the first of
    each language by a hash of doc_id; the driver gets their sparse counts alone. Every labelled language is learned, so
    that the model grows with their number, by some 16 KB each. Repeated rows of a language and doc_id count once; of their
    texts the first in order that has a letter is used. Without labelled rows the model knows no language and answers
    ``und``.
    """
    spark = labelled.sparkSession
    prepare(spark)
    ids = labelled.filter("lang is not null and text is not null and doc_id is not null").select("lang", F.col("doc_id").cast("long").alias("doc_id"))
    ids_of = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()
    each = max(1, sample_rows // max(1, len(ids_of)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    share = spark.createDataFrame([(r["lang"], min(1 << 31, 3 * each * (1 << 31) // max(1, r["n"]))) for r in ids_of], "lang string, upto long")
    near = ids.join(F.broadcast(share), "lang").filter(draw < F.col("upto"))  # some three times the sample; one row for each language
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    picked = near.select("lang", draw.alias("draw"), "doc_id").distinct().withColumn("place", place).filter(F.col("place") <= each)
    wanted = materialise(picked.select("lang", "doc_id"), "langid-sample")  # at most sample_rows ids, or one for each language
    every = labelled.filter("lang is not null and text is not null").select(F.col("doc_id").cast("long"), "text", "lang").join(F.broadcast(wanted), ["lang", "doc_id"], "left_semi")
    rows = every.groupBy("lang", "doc_id").agg(F.min(F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))).alias("text"))

    def sparse(batches):
        own_worker("langid")
        for b in (part for whole in batches for part in parts_of(whole)):
            keep = [(t, g) for t, g in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()) if has_letter(t)]
            got = [counts(vector_bytes(t)) for t, _ in keep]
            at = [np.flatnonzero(v) for v in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for _, g in keep], pa.string()), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([v[a].astype("<f4").tobytes() for v, a in zip(got, at)], pa.binary())],
                names=["lang", "at", "n"],
            )

    table = rows.mapInArrow(sparse, "lang string, at binary, n binary").orderBy("lang", "at", "n").toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    raw = np.zeros((table.num_rows, DIMS), dtype=np.float32)
    for i, (a, n) in enumerate(zip(table.column("at").to_pylist(), table.column("n").to_pylist())):
        raw[i, np.frombuffer(a, "<u2")] = np.frombuffer(n, "<f4")
    label = np.array([langs.index(g) for g in table.column("lang").to_pylist()], dtype=int)
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    model = LanguageModel((), idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    x = model.weigh(raw) if len(raw) else raw
    found = [_kmeans(x[label == g], centroids) for g in range(len(langs))]
    if not found:
        return model
    c, owner = np.concatenate(found).astype(np.float32), np.concatenate([np.full(len(f), g) for g, f in enumerate(found)])
    # Mislabelled rows can gather in a centroid of their own; one that is nearest mostly to other languages' rows goes.
    near = (x @ c.T).argmax(axis=1)
    own = np.array([(label[near == j] == owner[j]).mean() if (near == j).any() else 0.0 for j in range(len(c))])
    keep = (own > 0.5) | np.array([own[j] == own[owner == owner[j]].max() for j in range(len(c))])
    c, owner = c[keep], owner[keep]
    # Short texts lie far from any centroid, so the reach is wide; text in an unknown script is nearly at a right angle.
    far = np.array([(1 - (x[label == g] @ c[owner == g].T).max(axis=1)).max() for g in range(len(langs))])
    return LanguageModel(tuple(langs), idf, c, owner, (far + (1 - far) * SLACK)[owner])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected. Only doc_id and text are read.

    A null text or one without a letter is ``und`` with score 0, and rejected. Repeated rows are judged alike; an empty
    table gives an empty result. The model (its size is centroids x dimensions) goes to the workers with the task.
    """
    prepare(docs.sparkSession)

    def run(batches):
        own_worker("langid")
        for b in (part for whole in batches for part in parts_of(whole)):
            lang, score, out = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with the same columns."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        own_worker("langid")
        for b in (part for whole in batches for part in parts_of(whole, at)):
            yield b.filter(pa.array([not r for r in model.predict(b.column(at).to_pylist())[2]], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
