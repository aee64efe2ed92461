"""Nearest neighbours by low-dimensional stable projections and a kd-tree.

Unit vectors are projected by m Gaussian (2-stable) directions: the squared projected distance of a pair, over its squared
distance, is chi-square with m degrees of freedom. A kd-tree over the projections of a bounded sample parts the space into
cells, and every row goes to its cell. The search is incremental: in each round a query visits its next cells, GROWTH times
as many as in the round before, by projected distance, and in a cell its rows by projected distance. After every few rows
the k-th distance d found so far sets the reach: a row as near as d lies within it with probability `confidence`. Rows and
cells beyond the reach are never verified, and a query whose next cell lies beyond has stopped. Every verified score is the
exact cosine in double precision.

The number m is the one of DIMENSIONS with the least work (projected and verified components) in the sample. Equal vectors
are one node with its k + 1 smallest ids, and queries with equal vectors ask once, so that a vector that a third of all rows
share costs no more than another. Adjacent cells make up tiles of up to BLOCK nodes; a larger cell is dealt to blocks, and
the queries that visit a tile to chunks: a task holds one block and one chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from caliper.sources.scratch import drop, written

DIMENSIONS = (8, 12, 16, 24)
CONFIDENCE = 0.95
#: Rows that the tree is fitted on, and the fewest of them in a cell on average. The cells of n rows are sqrt(n) else.
SAMPLE, CELL_SAMPLE = 65_536, 16
#: Rows in a block, queries in a chunk, and rows that are verified before the first test in a block; twice as many each time.
BLOCK, CHUNK, STEP = 4096, 4096, 128
#: Cells that each query visits in the first round, and the factor for each further one.
FIRST_CELLS, GROWTH = 4, 4


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for an even m, by bisection of the closed form of the distribution."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < p else (low, x)
    return high


class Tree:
    """Median splits on the widest projected dimension; cells are boxes, open at the outer sides."""

    def __init__(self, points: np.ndarray, cells: int):
        m = points.shape[1]
        self.lo, self.hi = [], []
        self.nodes: list[tuple] = []  # (dim, at, left, right), or (cell,)

        def build(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> int:
            me = len(self.nodes)
            self.nodes.append(())
            wide = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            if n <= 1 or len(p) < 2 or np.ptp(p[:, wide]) == 0:
                self.nodes[me] = (len(self.lo),)
                self.lo.append(lo)
                self.hi.append(hi)
                return me
            at = float(np.median(p[:, wide]))
            left = p[:, wide] < at
            if not left.any():
                at = float(p[p[:, wide] > at, wide].min())
                left = p[:, wide] < at
            below, above = hi.copy(), lo.copy()
            below[wide] = above[wide] = at
            a = build(p[left], lo, below, n // 2)
            b = build(p[~left], above, hi, n - n // 2)
            self.nodes[me] = (wide, at, a, b)
            return me

        build(points, np.full(m, -np.inf), np.full(m, np.inf), cells)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def cell(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            n = self.nodes[node]
            if len(n) == 1:
                out[rows] = n[0]
            elif len(rows):
                left = points[rows, n[0]] < n[1]
                todo += [(n[2], rows[left]), (n[3], rows[~left])]
        return out

    def squared_gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance from a point to each cell."""
        gap = np.maximum(0, np.maximum(self.lo - point, point - self.hi))
        return (gap * gap).sum(axis=1)


def chi_square_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """For an even m, in closed form."""
    term, total = np.ones_like(x), np.ones_like(x)
    for i in range(1, m // 2):
        term = term * x / 2 / i
        total = total + term
    return 1 - np.exp(-x / 2) * total


def best_dimension(unit: np.ndarray, k: int, confidence: float) -> int:
    """The m of DIMENSIONS for which projecting a row and verifying the rows in reach takes the least components."""
    asked = unit[:64]
    gaps = np.maximum(2 - 2 * asked @ unit.T, 1e-12)
    gaps[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    if len(unit) <= k + 1:
        return DIMENSIONS[0]
    kth = np.partition(gaps, k - 1, axis=1)[:, k - 1 : k]
    work = {m: m + unit.shape[1] * chi_square_cdf(chi_square_quantile(confidence, m) * kth / gaps, m).mean() for m in DIMENSIONS}
    return min(work, key=work.get)


def _unit(v: np.ndarray) -> np.ndarray:
    u = v / np.abs(v).max(axis=1, keepdims=True)  # scaled against overflow
    return u / np.sqrt((u * u).sum(axis=1, keepdims=True))


def valid(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, each once; floats stay floats, other numbers become doubles."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast(f"array<{kind}>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) == dims) & sound)


def _dtype(rows: DataFrame) -> type:
    return np.float32 if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else np.float64


def _matrix(column: pd.Series, dtype: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1).astype(np.float64)


def _bytes(v: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in v + 0.0]  # no negative zeros: equal vectors have equal bytes


def _nodes(rows: DataFrame, ids: int) -> DataFrame:
    """(embedding, ids): each different vector with the smallest ids of its rows; a task hands on no more than these."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= ids)
    return first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _indexed(nodes: DataFrame, tree: Tree, directions: np.ndarray) -> DataFrame:
    """(cell, ids, vector, point): vectors as bytes of their type, the projected unit vectors as doubles."""
    shared = nodes.sparkSession.sparkContext.broadcast((tree, directions))
    dtype = _dtype(nodes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, d = shared.value
        for f in frames:
            if len(f):
                v = np.array(f["embedding"].tolist(), dtype=dtype)
                y = _unit(v.astype(np.float64)) @ d
                yield pd.DataFrame({"cell": t.cell(y), "ids": f["ids"], "vector": _bytes(v), "point": [r.tobytes() for r in y]})

    return nodes.mapInPandas(run, "cell int, ids array<long>, vector binary, point binary")


def _asked(rows: DataFrame) -> DataFrame:
    """(query_id, vector) of query rows: the least vector of each id."""
    dtype = _dtype(rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"query_id": f["vec_id"], "vector": _bytes(np.array(f["embedding"].tolist(), dtype=dtype))})

    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInPandas(run, "query_id long, vector binary")


def _tiles(index: DataFrame, cells: int) -> tuple[np.ndarray, DataFrame]:
    """The tile of each cell, and (cell, tile, blocks). Counts of cells, bounded by the sample, pass the driver."""
    n = np.zeros(cells, np.int64)
    for r in index.groupBy("cell").count().collect():
        n[r["cell"]] = r["count"]
    tile, size, now = np.zeros(cells, np.int64), [0], 0
    for c in range(cells):
        if size[now] and size[now] + n[c] > BLOCK:
            now += 1
            size.append(0)
        tile[c] = now
        size[now] += n[c]
    rows = [(c, int(tile[c]), max(1, -(-size[tile[c]] // BLOCK))) for c in range(cells)]
    return tile, index.sparkSession.createDataFrame([tuple(map(int, r)) for r in rows], "cell int, tile int, blocks int")


def _visits(queries: DataFrame, tree: Tree, tile: np.ndarray, at: int, to: int) -> DataFrame:
    """(tile, node, vector, point, reach, cells): of each query the cells number at to `to` by projected distance, as far
    as they lie within its reach."""
    shared = queries.sparkSession.sparkContext.broadcast((tree, tile))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, tile_of = shared.value
        for f in frames:
            rows = []
            for q, v, y, reach in zip(f["node"], f["vector"], f["point"], f["reach"], strict=True):
                gaps = t.squared_gaps(np.frombuffer(y, np.float64))
                near = np.argsort(gaps, kind="stable")[at:to]
                near = np.sort(near[gaps[near] <= reach])
                for x in np.unique(tile_of[near]):
                    rows.append((int(x), q, v, y, reach, near[tile_of[near] == x].tolist()))
            yield pd.DataFrame(rows, columns=["tile", "node", "vector", "point", "reach", "cells"])

    return queries.mapInPandas(run, "tile int, node long, vector binary, point binary, reach double, cells array<int>")


def _best_of(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best different ids, ties to the smaller one."""
    order = np.lexsort((ids, -score))
    ids, score = ids[order], score[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], score[first]


def _verify(k: int, factor: float, dtype: type):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values(["cell", "vector"], kind="stable")
            several, cell, y = rows["ids"].to_numpy(), rows["cell"].to_numpy(), _matrix(rows["point"])
            v = _matrix(rows["vector"], dtype)
            v /= np.abs(v).max(axis=1, keepdims=True)
            norm = np.sqrt((v * v).sum(axis=1))
            for q, x, p, reach, cells in zip(queries["node"], _matrix(queries["vector"], dtype), _matrix(queries["point"]), queries["reach"], queries["cells"], strict=True):
                own = np.concatenate([np.arange(*np.searchsorted(cell, (c, c + 1))) for c in cells])
                gap = ((y[own] - p) ** 2).sum(axis=1)
                near = np.flatnonzero(gap <= reach)
                near = near[np.argsort(gap[near], kind="stable")]
                own, gap = own[near], gap[near]
                a = x / np.abs(x).max()
                size = np.sqrt((a * a).sum())
                best, score, at, step = np.empty(0, np.int64), np.empty(0), 0, STEP
                while at < len(own):
                    to = min(at + step, int(np.searchsorted(gap, reach, side="right")))
                    if to <= at:
                        break
                    some = own[at:to]
                    cosine = (v[some] * a).sum(axis=1) / (size * norm[some])  # row by row: the same in every block
                    ids = several[some]
                    best, score = _best_of(np.concatenate([best, *ids]), np.r_[score, np.repeat(cosine, [len(i) for i in ids])], k)
                    if len(best) == k:
                        reach = min(reach, (2 - 2 * score[-1]) * factor + 1e-12)
                    at, step = to, 2 * step
                out += [(q, int(i), float(s), at if j == 0 else 0) for j, (i, s) in enumerate(zip(best, score, strict=True))]
        return pd.DataFrame(out, columns=["node", "vec_id", "score", "verified"])

    return run


def _met(index: DataFrame, tiles: DataFrame, visits: DataFrame, run) -> DataFrame:
    """The k best rows of each block for each query that visits it."""
    blocks = tiles.select("tile", "blocks").distinct()
    chunks = visits.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(CHUNK))).cast("int").alias("chunks")).join(blocks, "tile")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    places = F.broadcast(tiles.select("cell", "tile").join(chunks, "tile"))  # a row for each cell, bounded by the sample
    rows = index.join(places, "cell").select("tile", dealt("blocks", "vector").alias("block"), every("chunks").alias("chunk"), "cell", "ids", "vector", "point")
    asked = visits.join(F.broadcast(chunks), "tile").select("tile", every("blocks").alias("block"), dealt("chunks", "node").alias("chunk"), "node", "vector", "point", "reach", "cells")
    keys = ["tile", "block", "chunk"]
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "node long, vec_id long, score double, verified long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("node", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, confidence: float = CONFIDENCE, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): the k nearest rows by cosine found for each query row, ties to the smaller
    vec_id; verified is the number of different vectors whose cosine with the query was computed.

    Vectors that are null, zero, hold null or non-finite components take no part, as rows or queries; nor do those that have
    not the table's most common length, since a cosine needs equal lengths. Rows that repeat a vec_id are one row: its best
    score counts, and a query asks with the least of its vectors. A query never meets a row with its own id. With k or fewer
    other rows all are returned. Other columns are ignored. No rows give no rows.
    """
    lengths = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims, total = (lengths["n"], lengths["count"]) if lengths else (0, 0)
    rows = valid(vectors, dims)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).distinct().toArrow()["embedding"].combine_chunks()
    u = _unit(sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(dims, 1))) if len(sample) else np.zeros((0, max(dims, 1)))
    u = u[np.lexsort(u.T)]  # a set has no order
    u = np.random.default_rng(seed).permutation(u)
    m = best_dimension(u, k, confidence) if len(u) else DIMENSIONS[0]
    directions = np.random.default_rng(seed).standard_normal((max(dims, 1), m))
    tree = Tree(u @ directions, max(1, min(math.ceil(math.sqrt(total)), len(u) // CELL_SAMPLE)))
    index = written(_indexed(_nodes(rows, k + 1), tree, directions), "ann-index")
    tile, tiles = _tiles(index, len(tree.lo))
    asking = written(_asked(valid(vectors.where(is_query), dims)).join(index.select("vector", "point"), "vector"), "ann-asking")
    queries = written(asking.groupBy("vector").agg(F.first("point").alias("point"), F.min("query_id").alias("node")), "ann-queries")
    factor = chi_square_quantile(confidence, m)
    asked, found, at, to = queries.withColumn("reach", F.lit(float("inf"))), None, 0, FIRST_CELLS
    while at < len(tree.lo):
        visits = written(_visits(asked, tree, tile, at, to), "ann-visits")
        if found is not None and visits.isEmpty():
            break
        met = written(_met(index, tiles, visits, _verify(k + 1, factor, _dtype(rows))), "ann-found")
        drop(visits)
        found = met if found is None else found.unionByName(met)
        kth = _best(found, k + 1).where(F.col("rank") == k + 1).select("node", ((2 - 2 * F.col("score")) * factor + 1e-12).alias("r"))
        asked = queries.join(kth, "node", "left").select("node", "vector", "point", F.coalesce("r", F.lit(float("inf"))).alias("reach"))
        at, to = to, to + (to - at) * GROWTH
    drop(index)
    seen = found.groupBy("node").agg(F.sum("verified").alias("verified"))
    best = _best(found, k + 1).join(seen, "node").join(queries.select("node", "vector"), "node")
    each = asking.select("query_id", "vector").join(best, "vector").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")
