"""Sharding along a Hilbert curve: quantise metadata, sort by curve index, cut the order into equal runs.

DataFrame expressions only. The rank in the curve order comes from a range sort whose partitions are counted; only the
partition counts reach the driver.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from larder.llm.common import in_order, materialise, with_rank


@cache
def curve_table(dims: int) -> list[int]:
    """Hilbert automaton: entry ``state * 2**dims + cell`` holds ``next_state * 2**dims + digit``.

    A state is (entry corner e, direction d); rotating and reflecting the Gray-code walk gives the next one.
    """
    side, mask = 1 << dims, (1 << dims) - 1

    def rot(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    ungray = {gray(i): i for i in range(side)}

    def ones(i: int) -> int:
        return ((i + 1) & -(i + 1)).bit_length() - 1

    def entry(i: int) -> int:
        return 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def direction(i: int) -> int:
        return 0 if i == 0 else ones(i - 1) % dims if i % 2 == 0 else ones(i) % dims

    out = []
    for e in range(side):
        for d in range(dims):
            for cell in range(side):
                w = ungray[rot(cell ^ e, dims - (d + 1) % dims)]
                out.append(((e ^ rot(entry(w), d + 1)) * dims + (d + direction(w) + 1) % dims) * side + w)
    return out


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Curve index of integer cells in 0 .. 2**bits - 1, by table-driven descent from the top bit."""
    dims = len(cells)
    table = F.split(F.lit(",".join(map(str, curve_table(dims)))), ",").cast("array<int>")
    side = 1 << dims
    digits = []
    for b in range(bits - 1, -1, -1):
        cell = F.lit(0)
        for k, c in enumerate(cells):
            cell = cell.bitwiseOR(F.shiftleft(F.shiftright(c.cast("int"), b).bitwiseAND(F.lit(1)), k))
        digits.append(cell)
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))

    def step(acc: Column, cell: Column) -> Column:
        got = F.get(table, acc["s"] * side + cell)
        return F.struct((acc["h"] * side + got % side).alias("h"), F.floor(got / side).cast("int").alias("s"))

    return F.aggregate(F.array(*digits), start, step, lambda acc: acc["h"])


def string_key(text: Column) -> Column:
    """Order-preserving number of the first seven UTF-8 bytes; null sorts first."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(text, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(-1))


def quantile_cell(value: Column, cuts: list) -> Column:
    """The number of cut points at or below the value."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
    return F.size(F.filter(table, lambda c: c <= value))


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = 4) -> DataFrame:
    """Every row: doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null), curve.

    The curve runs over language, source, size and doc_id, each cut at its own quantiles over all rows. Rows with equal
    texts take the metadata of the group's smallest doc_id, so they are neighbours on the curve and share a shard unless
    a cut falls between them. Shard counts differ by one at most. A null text has no bytes and checksum 0; null metadata
    sorts first; repeated rows take a slot each; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = materialise(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("text_key"),
            string_key(F.col("lang")).alias("lang_key"),
            string_key(F.col("source")).alias("source_key"),
        ),
        "shard-meta",
    )
    names = ("lang_key", "source_key", "size", "doc_id")
    points = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = slim.agg(*[F.percentile_approx(c, points, 1000).alias(c) for c in names]).first()
    head = slim.groupBy("text_key", "size").agg(F.min(F.struct("doc_id", "lang_key", "source_key")).alias("head"), F.count("*").alias("copies"))
    # Written first: a join of two plain exchanges is one whose large partitions Spark can split.
    groups = materialise(
        head.filter("copies > 1").select("text_key", "size", F.col("head.lang_key").alias("l"), F.col("head.source_key").alias("s"), F.col("head.doc_id").alias("d")), "shard-groups"
    )
    meta = slim.join(groups, ["text_key", "size"], "left").withColumns(
        {"l": F.coalesce("l", "lang_key"), "s": F.coalesce("s", "source_key"), "d": F.coalesce("d", "doc_id")}
    )
    cells = [F.coalesce(quantile_cell(F.col(c), cuts[n] or []), F.lit(0)) for c, n in zip(("l", "s", "size", "d"), names)]
    curve = meta.select("doc_id", "size", "text_crc32", "text_key", hilbert_index(cells, bits).alias("curve"))
    placed = in_order(curve, ["curve", "text_key", "size", "doc_id"], "shard-order")
    return _cut(*with_rank(placed), shards)


def _cut(ranked: DataFrame, total: int, shards: int) -> DataFrame:
    small, more = divmod(total, shards)  # the first `more` shards hold one row more
    wide = more * (small + 1)
    shard = F.expr(f"case when rank < {wide} then rank div {small + 1} else {more} + (rank - {wide}) div {max(small, 1)} end").cast("int")
    start = F.expr(f"case when shard < {more} then shard * {small + 1}L else {wide} + (shard - {more}) * {small}L end")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
