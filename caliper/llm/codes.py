"""Product codes of vectors: codebooks fitted by heap Lloyd in integers.

Shape of the work. Every step is a scan without a shuffle. Tasks hold vectors in blocks; a block is one row with its vectors,
the present codes and, for each part position and entry, a heap of the parts that the entry has. A part's key in the heap is its
slack, the lower bound of the distance to any other entry minus the upper bound of the distance to its own, plus the drift of
that entry up to then. When the entries have moved, drift grows, and a heap gives up its parts from the top as long as their keys
are not above it: only these are compared with all entries again, exactly; what stays in the heap cannot have a nearer entry.
A step hands on what the moved parts change in the sums and counts of the entries, one row a task; these are added up in Spark
and come to the driver as parts x entries x width numbers, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.operators.skew import join_hot
from caliper.sources.scratch import drop, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and the bytes of their components as they are read.
BLOCK, BLOCK_BYTES = 4096, 1 << 23


@dataclass
class Books:
    """Entries [parts, entries, width] as integers, and the cumulative drift of each entry [parts, entries]: by how much the
    slack of its parts may have shrunk since the beginning."""

    entries: np.ndarray
    drift: np.ndarray

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Books:
        """Each entry at the floor of its parts' mean; unused entries stay."""
        means = np.floor_divide(sums, np.maximum(counts, 1)[..., None])
        after = np.where(counts[..., None] > 0, means, self.entries)
        step = np.sqrt(((after - self.entries).astype(float) ** 2).sum(axis=2))
        order = np.sort(step, axis=1)
        most = order[:, -1:]
        second = order[:, -2:-1] if step.shape[1] > 1 else np.zeros_like(most)
        others = np.where(np.arange(step.shape[1]) == step.argmax(axis=1)[:, None], second, most)
        return Books(after, self.drift + (step + others) * (1 + 1e-9))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def component_limit(dim: int) -> int:
    """The largest absolute integer component for which a vector's error fits into a long."""
    return math.isqrt((1 << 62) // max(dim, 1)) // 2


def integers(values: np.ndarray, dim: int) -> np.ndarray:
    """floor(256 * x), held to +-component_limit, with zeros up to a multiple of PARTS: [n, PARTS, width]."""
    limit, width = component_limit(dim), max(1, -(-dim // PARTS))
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(values.astype(np.float64) * SCALE), -limit, limit).astype(np.int64)
    out = np.zeros((len(whole), PARTS * width), np.int64)
    out[:, :dim] = whole
    return out.reshape(-1, PARTS, width)


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For parts x [n, width]: the nearest entry of each, the lower index of several, and a slack that is not above the true
    one: the distance to the nearest other entry minus that to its own."""
    exact = np.float64 if 4 * x.shape[1] * max(abs(x).max(initial=0), abs(entries).max(initial=0)) ** 2 < 1 << 50 else np.int64
    c = entries.astype(exact)
    best, slack = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 8192):
        p = x[at : at + 8192].astype(exact)
        d = (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)
        best[at : at + 8192] = own = d.argmin(axis=1)
        if len(c) == 1:
            slack[at : at + 8192] = np.inf
            continue
        near, other = (np.sqrt(y.astype(float)) for y in (d[np.arange(len(d)), own], np.partition(d, 1, axis=1)[:, 1]))
        slack[at : at + 8192] = other - near - 1e-9 * other
    return best, slack


class Block:
    """Vectors with their codes and heaps. heaps[part] is (keys, rows): the entries' heaps one after the other, by entry, each
    in heap order; keys are rounded down to floats of 4 bytes."""

    def __init__(self, x: np.ndarray, codes: np.ndarray, heaps: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.codes, self.heaps = x, codes, heaps
        self.rescans = 0

    @classmethod
    def fresh(cls, x: np.ndarray, books: Books) -> Block:
        codes, heaps = np.empty((len(x), PARTS), np.uint8), []
        for p in range(PARTS):
            best, slack = nearest_entries(x[:, p], books.entries[p])
            codes[:, p] = best
            keys = _down(slack + books.drift[p, best])
            order = np.lexsort((keys, best))  # what is sorted is a heap
            heaps.append((keys[order], order.astype(np.uint16)))
        out = cls(x, codes, heaps)
        out.rescans = x.shape[0] * PARTS
        return out

    def reassign(self, books: Books) -> None:
        """Codes and heaps as the moved entries want them."""
        n_entries = books.entries.shape[1]
        for p in range(PARTS):
            keys, rows = self.heaps[p]
            ends = np.cumsum(np.bincount(self.codes[:, p], minlength=n_entries))
            starts = ends - np.diff(ends, prepend=0)
            full = np.flatnonzero(ends > starts)
            violated = full[keys[starts[full]] <= books.drift[p, full]]
            if not len(violated):
                continue
            heaps = {j: list(zip(keys[starts[j] : ends[j]].tolist(), rows[starts[j] : ends[j]].tolist(), strict=True)) for j in violated.tolist()}
            popped = []
            for j, heap in heaps.items():
                while heap and heap[0][0] <= books.drift[p, j]:
                    popped.append(heappop(heap)[1])
            best, slack = nearest_entries(self.x[popped, p], books.entries[p])
            self.rescans += len(popped)
            self.codes[popped, p] = best
            for row, j, key in zip(popped, best.tolist(), _down(slack + books.drift[p, best]).tolist(), strict=True):
                if j not in heaps:
                    heaps[j] = list(zip(keys[starts[j] : ends[j]].tolist(), rows[starts[j] : ends[j]].tolist(), strict=True))
                heappush(heaps[j], (key, row))
            new = [(np.array([k for k, _ in heaps[j]], np.float32), np.array([r for _, r in heaps[j]], np.uint16)) if j in heaps else (keys[starts[j] : ends[j]], rows[starts[j] : ends[j]]) for j in range(n_entries)]
            self.heaps[p] = (np.concatenate([k for k, _ in new]), np.concatenate([r for _, r in new]))

    def errors(self, books: Books) -> np.ndarray:
        own = books.entries[np.arange(PARTS), self.codes]
        return ((self.x - own) ** 2).sum(axis=(1, 2))


def _down(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


class _Change:
    """What a task changes in the entries' sums and counts."""

    def __init__(self, books: Books):
        self.sums, self.counts, self.rescans = np.zeros_like(books.entries), np.zeros(books.entries.shape[:2], np.int64), 0

    def add(self, x: np.ndarray, codes: np.ndarray, sign: int) -> None:
        """x [n, PARTS, width] to their entries; codes of 255 and more entries do not occur."""
        for p in range(PARTS):
            np.add.at(self.sums[p], codes[:, p], sign * x[:, p])
            self.counts[p] += sign * np.bincount(codes[:, p], minlength=self.counts.shape[1])

    def move(self, block: Block, before: np.ndarray) -> None:
        for p in range(PARTS):
            at = np.flatnonzero(before[:, p] != block.codes[:, p])
            if len(at):
                np.add.at(self.sums[p], before[at, p], -block.x[at, p])
                np.add.at(self.sums[p], block.codes[at, p], block.x[at, p])
                np.add.at(self.counts[p], before[at, p], -1)
                np.add.at(self.counts[p], block.codes[at, p], 1)

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        flat = np.concatenate([self.sums.reshape(-1), self.counts.reshape(-1)]).tolist()
        return pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in schema][:-2] + [pa.array([flat], pa.list_(pa.int64())), pa.array([self.rescans], pa.int64())], schema=schema)


def _schema(label: pa.DataType) -> pa.Schema:
    binary = [(c, pa.binary()) for c in ("x", "codes", "keys", "rows")]
    return pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(label)), *binary, ("change", pa.list_(pa.int64())), ("rescans", pa.int64())])


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(block: Block, ids: pa.Array, labels: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    x = block.x.astype(np.int16) if abs(block.x).max(initial=0) < 1 << 15 else block.x.astype(np.int32)
    parts = [x.tobytes(), block.codes.tobytes(), b"".join(k.tobytes() for k, _ in block.heaps), b"".join(r.tobytes() for _, r in block.heaps)]
    arrays = [_one(ids), _one(labels), *(pa.array([b], pa.binary()) for b in parts), pa.nulls(1, schema.field("change").type), pa.nulls(1, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, pa.Array, Block]]:
    for batch in batches:
        for i in range(len(batch)):
            ids, labels = (batch.column(c)[i].values for c in (0, 1))
            n = len(ids)
            x, codes, keys, rows = (batch.column(c)[i].as_buffer() for c in range(2, 6))
            kind = np.int16 if x.size == 2 * n * PARTS * width else np.int32
            x = np.frombuffer(x, kind).reshape(n, PARTS, width).astype(np.int64)
            keys, rows = np.frombuffer(keys, np.float32).reshape(PARTS, n), np.frombuffer(rows, np.uint16).reshape(PARTS, n)
            yield ids, labels, Block(x, np.frombuffer(codes, np.uint8).reshape(n, PARTS).copy(), list(zip(keys, rows, strict=True)))


def _first_step(books: Books, dim: int, schema: pa.Schema):
    """From rows (vec_id, label, vector): blocks with the first codes, and one row of changes."""
    rows = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(dim, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = _Change(books)
        for batch in _cut(batches, rows):
            values = batch.column(2)
            x = integers(values.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim), dim)
            block = Block.fresh(x, books)
            change.add(x, block.codes, 1)
            change.rescans += block.rescans
            yield _packed(block, batch.column(0), batch.column(1), schema)
        yield change.row(schema)

    return run


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _next_step(books: Books, schema: pa.Schema):
    width = books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = _Change(books)
        for ids, labels, block in _unpacked(batches, width):
            before = block.codes.copy()
            block.reassign(books)
            change.move(block, before)
            change.rescans += block.rescans
            yield _packed(block, ids, labels, schema)
        yield change.row(schema)

    return run


def _last_step(books: Books):
    width = books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, block in _unpacked(batches, width):
            block.reassign(books)
            codes = pa.array([c.tobytes() for c in block.codes], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array(block.errors(books), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _added(state: DataFrame, books: Books) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums, counts and rescans of all tasks."""
    changes = state.where("change is not null")
    rows = changes.select(F.posexplode("change").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(books.entries.size + books.drift.size, np.int64)
    flat[rows["at"].to_numpy()] = rows["v"].to_numpy()
    sums, counts = flat[: books.entries.size].reshape(books.entries.shape), flat[books.entries.size :].reshape(books.drift.shape)
    return sums, counts, changes.agg(F.sum("rescans")).first()[0] or 0


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


@dataclass
class Coded:
    """rows (vec_id, label, code, error), the final codebooks, and how many parts each assignment compared with all entries."""

    rows: DataFrame
    books: Books
    rescans: list[int]


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", n_entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    """Codes of vectors under codebooks of n_entries (256 at most) for each of 16 parts.

    Vectors that are null or hold null or non-finite components have no row. Components are floor(256 * x), beyond
    component_limit held to it. Vectors of another length than the table's most common one (of several the smallest) keep their
    row, with null code and error. A length that 16 does not divide is filled up with zeros. The codebooks begin as the vectors
    of the smallest ids (null ids last, ties by vector), fewer if there are fewer; rows may repeat. Other columns are
    ignored. Without vectors there are no rows and the books are empty.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    kept = kept.where(F.col("vector").isNotNull() & F.forall("vector", _finite))
    sizes = kept.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    dim = sizes["size"] if sizes else 0
    same = kept.where(F.size("vector") == dim)
    first = [r["vector"] for r in same.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(n_entries).collect()]
    start = integers(np.array(first, float).reshape(len(first), dim), dim).transpose(1, 0, 2)
    books, rescans = Books(start, np.zeros(start.shape[:2])), []
    out_type = f"vec_id bigint, label {kept.schema['label'].dataType.simpleString()}, code binary, error bigint"
    if not first:
        return Coded(spark.createDataFrame([], out_type), books, rescans)
    schema = _schema(same.limit(0).select("label").toArrow().schema.field(0).type)
    ddl = f"ids array<bigint>, labels array<{kept.schema['label'].dataType.simpleString()}>, x binary, codes binary, keys binary, rows binary, change array<bigint>, rescans bigint"
    state = written(same.mapInArrow(_first_step(books, dim, schema), ddl), "codes-state")
    sums = counts = 0
    for r in range(rounds):
        more, used, n = _added(state, books)
        sums, counts, rescans = sums + more, counts + used, [*rescans, n]
        books = books.moved(sums, counts)
        if r < rounds - 1:
            after = written(state.where("ids is not null").mapInArrow(_next_step(books, schema), ddl), "codes-state")
            drop(state)
            state = after
    coded = written(state.where("ids is not null").mapInArrow(_last_step(books), out_type), "codes")
    drop(state)
    other = kept.where(F.size("vector") != dim).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return Coded(coded.unionByName(other), books, rescans)


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with `label_error`, the sum of error over the rows of the same label; null labels are one group. A sum beyond a
    long is null, as is that of a label without a code."""
    keyed = written(coded.withColumn("__label", F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("label"))), "codes-labels")
    sums = keyed.groupBy("__label").agg(F.try_sum("error").alias("label_error"))
    return join_hot(keyed, sums, "__label").drop("__label")
