"""Reading values off a recognised scan: the number nearest to a label inside a window of offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.enums import OCR_ITEMS, OCR_WEIGHT_DX, OCR_WEIGHT_DY, OCR_WEIGHT_LABEL, OCR_WEIGHT_LABEL_Y
from larder.functions.text import leading_number, ocr_date, ocr_text


def centre(vertices: Column, axis: str) -> Column:
    """Mean of an axis over a box's vertices, missing values as 0; 0 without vertices."""
    total = F.aggregate(vertices, F.lit(0.0), lambda s, v: s + F.coalesce(v[axis], F.lit(0.0)))
    return F.when(F.size(vertices) > 0, total / F.size(vertices)).otherwise(F.lit(0.0))


def field_array(images: Column) -> Column:
    """All fields of all images in order, nulls left out: array<struct<pos, text, cx, cy>>."""
    none = F.array().cast("array<struct<inferText: string, inferConfidence: double, boundingPoly: struct<vertices: array<struct<x: double, y: double>>>>>")
    fields = F.filter(F.flatten(F.transform(images, lambda i: F.coalesce(i["fields"], none))), lambda f: f.isNotNull())
    box = lambda f: f["boundingPoly"]["vertices"]
    return F.transform(fields, lambda f, i: F.struct(i.alias("pos"), f["inferText"].alias("text"), centre(box(f), "x").alias("cx"), centre(box(f), "y").alias("cy")))


def flatten_fields(scans: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, pos, text, cx, cy) of all fields of all images, nulls left out, in order."""
    return scans.select(doc, F.explode(field_array(F.col("images"))).alias("f")).select(doc, "f.*")


def labels(fields: DataFrame, doc: str, texts: tuple[str, ...]) -> DataFrame:
    """The first field of each scan whose text, spaces aside, is a label."""
    hits = fields.filter(F.col("text").isNotNull() & ocr_text(F.col("text")).isin(*texts))
    return hits.groupBy(doc).agg(F.min_by(F.struct("cx", "cy"), "pos").alias("label"))


def _numbers(fields: DataFrame) -> DataFrame:
    return fields.filter("text is not null").withColumn("value", leading_number(F.col("text"))).filter("value is not null")


def nearest_number(fields: DataFrame, doc: str, texts: tuple[str, ...], dx: tuple[float, float], dy: tuple[float, float], values: tuple[float, float]) -> DataFrame:
    """(doc, value): of the numbers in the window and range the one nearest by height, then by width, then first."""
    near = _numbers(fields).join(labels(fields, doc, texts), doc)
    x, y = F.col("cx") - F.col("label.cx"), F.col("cy") - F.col("label.cy")
    inside = near.filter(x.between(*dx) & y.between(*dy) & F.col("value").cast("double").between(*values))
    return inside.groupBy(doc).agg(F.min_by("value", F.struct(F.abs(y), F.abs(x), "pos")).alias("value"))


def weight(fields: DataFrame, doc: str) -> DataFrame:
    """(doc, value) of the weight, whose label is looked for at a height of its own and whose window's borders are out."""
    low, high = OCR_WEIGHT_LABEL_Y
    near = _numbers(fields).join(labels(fields.filter((F.col("cy") > low) & (F.col("cy") < high)), doc, (OCR_WEIGHT_LABEL,)), doc)
    x, y = F.col("cx") - F.col("label.cx"), F.col("cy") - F.col("label.cy")
    inside = near.filter((x > OCR_WEIGHT_DX[0]) & (x < OCR_WEIGHT_DX[1]) & (y > OCR_WEIGHT_DY[0]) & (y < OCR_WEIGHT_DY[1]))
    return inside.groupBy(doc).agg(F.min_by("value", F.struct(F.abs(x), "pos")).alias("value"))


def extract(scans: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per scan: six values, day and ``status``: ok, or failed with the first value that is missing.

    A scan's fields are one array, so everything is read off row by row, without a join.
    """
    rows = scans.select(doc, field_array(F.col("images")).alias("f"))
    low, high = OCR_WEIGHT_LABEL_Y
    labelled = rows.select(
        doc, F.transform("f", lambda f: F.struct(f["pos"].alias("pos"), f["cx"].alias("cx"), f["cy"].alias("cy"), ocr_text(f["text"]).alias("plain"), leading_number(f["text"]).alias("value"))).alias("f"),
        F.array_compact(F.transform("f", lambda f: ocr_date(f["text"]))).alias("days"),
    )

    def first(texts: tuple[str, ...], where=lambda f: F.lit(True)) -> Column:
        return F.get(F.filter("f", lambda f: f["plain"].isin(*texts) & where(f)), 0)

    found = {"weight": first((OCR_WEIGHT_LABEL,), lambda f: (f["cy"] > low) & (f["cy"] < high)), **{n: first(how[0]) for n, how in OCR_ITEMS.items()}}
    labelled = labelled.withColumns({f"l_{n}": c for n, c in found.items()})

    def nearest(name: str, inside, rank) -> Column:
        x, y = (lambda f: f["cx"] - F.col(f"l_{name}.cx")), (lambda f: f["cy"] - F.col(f"l_{name}.cy"))
        hits = F.filter("f", lambda f: f["value"].isNotNull() & inside(x(f), y(f), f["value"].cast("double")))
        return F.array_min(F.transform(hits, lambda f: F.struct(*rank(F.abs(x(f)), F.abs(y(f))), f["pos"].alias("pos"), f["value"].alias("value"))))["value"]

    def window(dx, dy, values):
        return lambda x, y, v: x.between(*dx) & y.between(*dy) & v.between(*values)

    open_window = lambda x, y, v: (x > OCR_WEIGHT_DX[0]) & (x < OCR_WEIGHT_DX[1]) & (y > OCR_WEIGHT_DY[0]) & (y < OCR_WEIGHT_DY[1])
    values = {"weight": nearest("weight", open_window, lambda x, y: (x.alias("x"),))}
    values |= {n: nearest(n, window(*how[1:]), lambda x, y: (y.alias("y"), x.alias("x"))) for n, how in OCR_ITEMS.items()}
    out = labelled.select(doc, *[c.alias(n) for n, c in values.items()], F.get("days", F.lit(0)).alias("measured_at"))
    missing = F.coalesce(*[F.when(F.col(n).isNull(), F.lit(f"failed({n})")) for n in values], F.lit("ok"))
    whole = {n: F.col(n).cast("int") for n in ("bmr", "visceral_fat_level", "inbody_score")}
    return out.withColumn("status", missing).withColumns(whole)
