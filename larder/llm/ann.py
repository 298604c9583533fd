"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, in flat arrays.

Inner product is searched as nearness on a sphere: every stored vector gets one more component that makes all lengths
equal. Vectors of a shard are divided by the longest one's length first, and those of very unequal lengths get graphs of
their own, so that no magnitude of finite vectors matters. Graphs are built and searched in NumPy, many vectors at once.
Equal vectors are one node. A task takes in a shard's graph once, then all queries stream past it; shards' results are merged.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from larder.llm.common import materialise, prepare

MIN_SHARDS, SHARD_ROWS = 8, 20_000
#: Bytes of vectors in a shard, by which long vectors make more shards.
SHARD_BYTES = 64 << 20
LINKS, BASE_LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 32, 64, 128
EXPAND = 4
#: Lengths in a band differ by at most this logarithm; a band of at most so many vectors is compared one by one.
BAND, SCANNED = 0.2, 512


def _dots(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.matmul(rows, q[:, :, None])[:, :, 0]


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all rows of q: (ids, scores), best first, -1 where fewer were reached."""
    n, m = len(q), links.shape[1]
    ids = np.full((n, width), -1, np.int32)
    score = np.full((n, width), -np.inf, np.float32)
    open_ = np.zeros((n, width), bool)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column takes the -1s
    ids[:, 0], open_[:, 0] = entry, True
    score[:, 0] = np.einsum("bd,bd->b", x[entry], q)
    seen[np.arange(n), entry] = True
    live = np.arange(n)
    while len(live):
        s = np.where(open_[live], score[live], -np.inf)
        t = min(EXPAND, width)
        best = np.argpartition(-s, t - 1, axis=1)[:, :t] if t < width else np.broadcast_to(np.arange(width), s.shape)
        good = np.take_along_axis(s, best, 1) > -np.inf
        keep = good.any(axis=1)
        live, best, good = live[keep], best[keep], good[keep]
        if not len(live):
            break
        row = live[:, None]
        near = np.where(good[:, :, None], links[np.take_along_axis(ids[live], best, 1)], -1).reshape(len(live), t * m)
        open_[row, best] = False
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[row, near]] = -1
        seen[row, near] = True
        seen[live, -1] = False
        got = _dots(x[near], q[live])
        got[near < 0] = -np.inf
        all_ids, all_score = np.concatenate([ids[live], near], 1), np.concatenate([score[live], got], 1)
        all_open = np.concatenate([open_[live], near >= 0], 1)
        top = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
        ids[live], score[live], open_[live] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_score, all_open))
        ids[live] = np.where(score[live] > -np.inf, ids[live], -1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def select(x: np.ndarray, ids: np.ndarray, score: np.ndarray, m: int) -> np.ndarray:
    """Of candidates, best first, those nearer to the node than to any chosen before; then the best rest, up to m."""
    n, c = ids.shape
    v = x[ids]
    between = np.matmul(v, v.transpose(0, 2, 1))
    to_chosen = np.full((n, c), -np.inf, np.float32)
    chosen = np.zeros((n, c), bool)
    for j in range(c):
        take = (ids[:, j] >= 0) & (score[:, j] > to_chosen[:, j]) & (chosen.sum(axis=1) < m)
        chosen[:, j] = take
        to_chosen = np.where(take[:, None], np.maximum(to_chosen, between[:, j]), to_chosen)
    rank = np.where(ids < 0, 2 * c + np.arange(c), np.where(chosen, 0, c) + np.arange(c))
    order = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(ids, order, 1)
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Add the reverse of every new link. A list's first half holds the links a node chose itself, which lead in all
    directions and stay; its second half the nearest reverse ones."""
    half = links.shape[1] // 2
    m = links.shape[1] - half
    to, of = chosen.ravel(), np.repeat(new, chosen.shape[1])
    to, of = to[to >= 0], of[to >= 0]
    near = np.einsum("bd,bd->b", x[to], x[of])
    order = np.lexsort((-near, to))
    to, of = to[order], of[order]
    start = np.r_[0, np.flatnonzero(np.diff(to)) + 1]
    place = np.arange(len(to)) - np.repeat(start, np.diff(np.r_[start, len(to)]))
    to, of, place = to[place < m], of[place < m], place[place < m]
    node, at = np.unique(to, return_inverse=True)
    fresh = np.full((len(node), m), -1, np.int32)
    fresh[at, place] = of
    pool = np.concatenate([links[node, half:], fresh], 1)
    s = _dots(x[pool], x[node])
    s[pool < 0] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :m]
    links[node, half:] = np.take_along_axis(pool, top, 1)


def _layer(x: np.ndarray, m: int, guide) -> np.ndarray:
    """Links of one layer over x, in order of insertion; guide(rows) gives where the search for these rows starts."""
    n = len(x)
    links = np.full((n, m), -1, np.int32)
    first = min(n, 512)
    done = 0
    while done < n:
        step = first if not done else min(512, done, n - done)
        new = np.arange(done, done + step, dtype=np.int32)
        peers = x[new] @ x[new].T
        np.fill_diagonal(peers, -np.inf)
        c = min(step - 1, BUILD_WIDTH)
        mine = np.argpartition(-peers, c - 1, axis=1)[:, :c] if 0 < c < step else np.zeros((step, 0), int)
        ids, score = new[mine], np.take_along_axis(peers, mine, 1)
        if done:
            start = guide(new)  # the layer above may hold nodes that are not in this one yet
            old, s = beam(x[:done], links[:done], x[new], np.where(start < done, start, 0), BUILD_WIDTH)
            ids, score = np.concatenate([old, ids], 1), np.concatenate([s, score], 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :BUILD_WIDTH]
        chosen = select(x, np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1), m // 2)
        links[new, : m // 2] = chosen
        _link_back(x, links, new, chosen)
        done += step
    return links


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors divided by one number, so that the longest has about length one and no square overflows: the order of inner
    products with any one vector stays."""
    v = np.asarray(vectors, dtype=np.float64)
    if v.size:
        v = v / max(np.abs(v).max(), np.finfo(float).tiny)
        v = v / max(np.sqrt((v * v).sum(axis=1)).max(), np.finfo(float).tiny)
    return v


class Graph:
    """``x`` sorted so that every layer is a prefix; ``layers`` are its link arrays, base first, -1 for none."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], order: np.ndarray):
        self.x, self.layers, self.order = x, layers, order

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        v = unit(vectors)
        norm = (v * v).sum(axis=1)
        x = np.concatenate([v, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]], 1).astype(np.float32)
        level = np.floor(-np.log(np.random.default_rng(len(v)).random(len(v)) + 1e-12) / math.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")
        x, level = np.ascontiguousarray(x[order]), level[order]
        sizes = [int((level >= i).sum()) for i in range(int(level.max(initial=0)) + 1)]
        graph = cls(x, [], order)
        above: list[np.ndarray] = []
        for i in reversed(range(len(sizes))):
            part = x[: sizes[i]]
            above.insert(0, _layer(part, BASE_LINKS if i == 0 else LINKS, lambda rows, up=tuple(above): graph._descend(x[rows], list(up))))
        graph.layers = above
        return graph

    def _descend(self, q: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
        """The entry point found through the given upper layers, top first taken last in the list."""
        at = np.zeros(len(q), np.int32)
        for links in reversed(layers):
            at = beam(self.x[: len(links)], links, q, at, 4)[0][:, 0]
        return at

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """Positions in the vectors as given to build, best first, -1 for none."""
        # Each query by its own length: the order of its inner products stays.
        q = np.concatenate([unit(row[None]) for row in q]) if len(q) else np.zeros((0, self.x.shape[1] - 1))
        q = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
        out = []
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            ids, _ = beam(self.x, self.layers[0], part, self._descend(part, self.layers[1:]), min(width, len(self.x)))
            out.append(np.where(ids >= 0, self.order[ids], -1))
        return np.concatenate(out)


def _vectors(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


class Bands:
    """The vectors of a shard in bands of about equal length, longest first, each a graph of its own: in one graph the short
    vectors would lie near one another whatever their direction. Vectors of small bands are compared one by one."""

    def __init__(self, vectors: np.ndarray, graphs: list[tuple[np.ndarray, Graph]], scanned: np.ndarray):
        self.vectors, self.graphs, self.scanned = vectors, graphs, scanned
        self.rows = unit(vectors[scanned])

    @classmethod
    def build(cls, vectors: np.ndarray) -> Bands:
        v = np.asarray(vectors, dtype=np.float64)
        largest = np.maximum(np.abs(v).max(axis=1), np.finfo(float).tiny)  # no vector is zero
        length = np.log(largest) + np.log(np.sqrt(((v / largest[:, None]) ** 2).sum(axis=1)))
        order, graphs, scanned, at = np.argsort(-length, kind="stable"), [], [], 0
        while at < len(order):
            end = at + int(np.searchsorted(-length[order[at:]], -length[order[at]] + BAND, side="right"))
            mine, at = np.sort(order[at:end]), end
            if len(mine) > SCANNED:
                graphs.append((mine, Graph.build(v[mine])))
            else:
                scanned.append(mine)
        return cls(vectors, graphs, np.concatenate(scanned) if scanned else np.zeros(0, int))

    def search(self, q: np.ndarray, width: int, k: int) -> np.ndarray:
        """Positions of what may be nearest to each query, -1 for none: what each graph finds, and the first k of the rest."""
        found = [np.where((at := graph.search(q, width)) >= 0, mine[at], -1) for mine, graph in self.graphs]
        if len(self.scanned):
            found.append(np.concatenate([self._first(q[at : at + 256], min(k, len(self.scanned))) for at in range(0, len(q), 256)]))
        return np.concatenate(found, axis=1) if found else np.zeros((len(q), 0), int)

    def _first(self, q: np.ndarray, k: int) -> np.ndarray:
        score = np.concatenate([unit(row[None]) for row in q]) @ self.rows.T
        return self.scanned[np.argsort(-score, axis=1, kind="stable")[:, :k]]

    def arrays(self) -> dict[str, np.ndarray]:
        out = {"vectors": self.vectors, "scanned": self.scanned}
        for b, (mine, g) in enumerate(self.graphs):
            out |= {f"mine{b}": mine, f"x{b}": g.x, f"order{b}": g.order, **{f"layer{b}_{i}": a for i, a in enumerate(g.layers)}}
        return out

    @classmethod
    def of(cls, z: dict[str, np.ndarray]) -> Bands:
        graphs = []
        for b in range(sum(f.startswith("mine") for f in z)):
            layers = [z[f"layer{b}_{i}"] for i in range(sum(f.startswith(f"layer{b}_") for f in z))]
            graphs.append((z[f"mine{b}"], Graph(z[f"x{b}"], layers, z[f"order{b}"])))
        return cls(z["vectors"], graphs, z["scanned"])


def _build(table: pa.Table) -> pa.Table:
    rows, ids = _vectors(table.column("vec").combine_chunks()), table.column("vec_id").to_numpy()
    vectors, owner = np.unique(rows, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([owner.ravel(), ids], 1), axis=0)
    blob = io.BytesIO()
    np.savez(blob, ids=pairs[:, 1], start=np.searchsorted(pairs[:, 0], np.arange(len(vectors) + 1)), **Bands.build(vectors).arrays())
    return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "graph": pa.array([blob.getvalue()], pa.binary())})


def _nearest(graph: bytes, queries: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """What one shard holds nearest to each query, k and one in case the query itself is among them."""
    with np.load(io.BytesIO(graph)) as z:
        arrays = {f: z[f] for f in z.files}
    bands, vectors, ids, start = Bands.of(arrays), arrays["vectors"], arrays["ids"], arrays["start"]
    for batch in queries:
        q = _vectors(batch.column("vec"))
        out = {"qid": [], "vec_id": [], "score": []}
        for row, near, qid in zip(q, bands.search(q, width, 2 * k + 2), batch.column("qid").to_pylist()):
            near = near[near >= 0]
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (vectors[near] * row).sum(axis=1)
            exact[np.isnan(exact)] = -np.inf  # beyond doubles on either side
            hits = []
            taken: set[int] = set()  # an id with several vectors counts with its best
            for j in np.argsort(-exact, kind="stable"):
                if len(hits) > k and exact[j] < hits[k][0]:
                    break
                fresh = [i for i in ids[start[near[j]] : start[near[j] + 1]].tolist() if i not in taken]
                taken.update(fresh)
                hits += [(float(exact[j]), i) for i in fresh]
            hits = sorted(hits, key=lambda h: (-h[0], h[1]))[: k + 1]
            out["qid"].append(qid)
            out["vec_id"].append([i for _, i in hits])
            out["score"].append([s for s, _ in hits])
        yield pa.record_batch({"qid": pa.array(out["qid"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.list_(pa.int64())), "score": pa.array(out["score"], pa.list_(pa.float64()))})


def _stream(k: int, width: int):
    """Rows sorted by shard, in each its graph before its queries: one graph and one batch are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def more() -> pa.RecordBatch | None:
            while not waiting:
                batch = next(batches, None)
                if batch is None:
                    return None
                if batch.num_rows:
                    waiting.append(batch)
            return waiting.pop()

        def queries() -> Iterator[pa.RecordBatch]:
            """Up to the next graph, with which what follows waits."""
            while (batch := more()) is not None:
                cut = np.flatnonzero(batch.column("graph").is_valid().to_numpy(zero_copy_only=False))
                end = int(cut[0]) if len(cut) else batch.num_rows
                if end < batch.num_rows:
                    waiting.append(batch.slice(end))
                if end:
                    yield batch.slice(0, end)
                if end < batch.num_rows:
                    return

        while (batch := more()) is not None:
            graph = batch.column("graph")[0].as_py()
            if batch.num_rows > 1:
                waiting.append(batch.slice(1))
            del batch
            yield from _nearest(graph, queries(), k, width)

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec, dim) of the rows whose vector is not null, not zero and wholly finite."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")).filter("vec_id is not null and vec is not null")
    ok = F.forall("vec", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & F.exists("vec", lambda v: v != 0)
    return rows.filter(ok).withColumn("dim", F.size("vec"))


def build_index(rows: DataFrame, k: int, n: int, widest: int) -> DataFrame:
    """(dim, shard, graph): every vector is a node of its shard; of equal vectors the k + 1 smallest ids are kept, which is
    all that k results can hold. Graphs are written to the shared folder."""
    shards = max(MIN_SHARDS, -(-n // min(SHARD_ROWS, max(1, SHARD_BYTES // (8 * widest)))))
    least = Window.partitionBy("vec").orderBy("vec_id")
    kept = rows.withColumn("r", F.dense_rank().over(least)).filter(F.col("r") <= k + 1).drop("r")
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    return materialise(dealt.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, graph binary"), "graphs")


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20, width: int = SEARCH_WIDTH) -> DataFrame:
    """The k nearest rows found for each query row, its own left out: query_id, rank, vec_id, score.

    Both tables have vec_id and embedding. Nearest is the largest inner product in double precision, ties to the smaller
    vec_id. Vectors that are null, zero or hold a null or non-finite component take no part; vectors meet only others of
    their length. Repeated rows with one vec_id and vector count once as candidates, and each as a query; of several
    vectors under one vec_id the best counts as candidate, and none of them for a query of that vec_id. Empty tables give
    an empty result. A score beyond doubles is infinite, one whose sum is of both infinities the lowest.
    """
    prepare(embeddings.sparkSession)
    rows = usable(embeddings)
    n, widest = rows.agg(F.count("*"), F.max("dim")).first()
    index = build_index(rows, k, n, widest or 1)
    asked = usable(queries)
    distinct = materialise(asked.select("dim", "vec").distinct().withColumn("qid", F.monotonically_increasing_id()), "query-vectors")
    shards = index.select("dim", "shard")
    asked_of = distinct.join(F.broadcast(shards), "dim")  # one row per shard
    rows = index.select("dim", "shard", "graph", F.lit(None).cast("long").alias("qid"), F.lit(None).cast("array<double>").alias("vec")).unionByName(
        asked_of.select("dim", "shard", F.lit(None).cast("binary").alias("graph"), "qid", "vec")
    )
    # More partitions than shards, so that few shards meet in one; the one null qid of a shard is its graph's and comes first.
    tasks = 2 * shards.count() or 1
    streams = rows.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "qid")
    hits = streams.mapInArrow(_stream(k, width), "qid long, vec_id array<long>, score array<double>")
    flat = hits.select("qid", F.explode(F.arrays_zip("vec_id", "score")).alias("h")).select("qid", "h.vec_id", "h.score")
    flat = flat.repartition("qid").groupBy("qid", "vec_id").agg(F.max("score").alias("score"))  # shards may hold vectors of one id
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    best = flat.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    top = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    named = asked.select("vec_id", "vec").join(distinct.select("vec", "qid"), "vec").select(F.col("vec_id").alias("query_id"), "qid").join(top, "qid")
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(others).alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
