"""Variable-capacity best-fit packing of documents into training sequences.

Pieces go in decreasing length into the open bin with the least room that holds them. If none does, the bin size with the
least cost per word that can still fill it is opened; at the end each bin shrinks to the smallest permitted length that
holds its contents. Opening sizes are limited to the first one, two, ... permitted lengths in turn and the cheapest of
these packings stays, so that all lengths are weighed together. Packing happens within a task, over windows of a bounded
number of documents as they stream by; what a task has left below a window is dealt anew, to as many tasks as fill windows,
so that the bins hardly depend on how the input is parted. Only those rests, ids and lengths, are shuffled.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.sources.scratch import written

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces packed together.
WINDOW = 8192
SCHEMA = "doc_id long, piece int, start long, length long, bin_id long, bin_capacity long, bin_offset long"


def bin_cost(capacity: int) -> float:
    """Cost of one sequence: a fixed part, a linear part and a quadratic (attention) part."""
    return 64.0 + capacity + capacity * capacity / 16384.0


def _fill(order: list[tuple[int, int]], sizes: tuple[int, ...]) -> tuple[float, list[tuple[int, int]], list[int]]:
    """order: (length, index) decreasing. Cost, (bin, offset) by position in order, final capacity of each bin."""
    left = sum(x for x, _ in order)
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    used: list[int] = []
    opened: list[int] = []
    at: list[tuple[int, int]] = []
    for length, _ in order:
        i = bisect.bisect_left(rooms, (length, -1))
        if i < len(rooms):
            room, b = rooms.pop(i)
        else:
            b = len(used)
            room = min((c for c in sizes if c >= length), key=lambda c: (bin_cost(c) / min(c, left), c))
            used.append(0)
            opened.append(room)
        at.append((b, used[b]))
        used[b] += length
        left -= length
        if room > length:
            bisect.insort(rooms, (room - length, b))
    final = [next(c for c in sizes if c >= u) for u in used]
    return sum(map(bin_cost, final)), at, final


def pack_window(lengths: list[int], sizes: tuple[int, ...] = CAPACITIES) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) for each length, none above the largest size, and the capacity of each bin."""
    order = sorted(((x, i) for i, x in enumerate(lengths)), key=lambda t: (-t[0], t[1]))
    longest = order[0][0] if order else 0
    _, at, final = min((_fill(order, sizes[: k + 1]) for k in range(len(sizes)) if sizes[k] >= longest), key=lambda r: r[0])
    place = [(0, 0)] * len(lengths)
    for (_, i), p in zip(order, at, strict=True):
        place[i] = p
    return place, final


def _rows(frames: Iterator[pd.DataFrame], sizes: tuple[int, ...], window: int, first_bin: int, keep_rest: bool) -> Iterator[pd.DataFrame]:
    """Bins of (doc_id, piece, start, length) rows, window by window; keep_rest: the last rows, fewer than a window, come back
    with bin_id -1."""
    held: list[tuple] = []
    next_bin = first_bin

    def flush(rest: bool) -> pd.DataFrame:
        nonlocal next_bin
        rows: list[tuple] = []
        pieces = [x for x in held if x[3]]
        rows += [(*x, None, None, None) for x in held if not x[3]]
        full = [x for x in pieces if x[3] == sizes[-1]]
        rows += [(*x, next_bin + i, sizes[-1], 0) for i, x in enumerate(full)]
        next_bin += len(full)
        rests = [x for x in pieces if x[3] < sizes[-1]]
        if rest:
            rows += [(*x, -1, None, None) for x in rests]
        elif rests:
            place, final = pack_window([x[3] for x in rests], sizes)
            rows += [(*x, next_bin + b, final[b], off) for x, (b, off) in zip(rests, place, strict=True)]
            next_bin += len(final)
        held.clear()
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "bin_id", "bin_capacity", "bin_offset"], dtype=object)
        return out.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "bin_id": "Int64", "bin_capacity": "Int64", "bin_offset": "Int64"})

    for f in frames:
        for doc, piece, start, n in zip(f["doc_id"], f["piece"], f["start"], f["length"], strict=True):
            held.append((None if pd.isna(doc) else int(doc), int(piece), int(start), int(n)))
            if len(held) >= window:
                yield flush(False)
    yield flush(keep_rest)


def pack(docs: DataFrame, length: Column, sizes: tuple[int, ...] = CAPACITIES, window: int = WINDOW) -> DataFrame:
    """Pieces of docs (doc_id, text, ...) in bins: columns of SCHEMA.

    A document longer than the largest size is cut into full bins of that size and a rest. A document of length 0 or null
    has one row of length 0 without a bin. Repeated rows are packed one by one, null ids are kept, other columns are
    ignored, no documents give no rows. Every bin is whole within one task.
    """
    sizes = tuple(sorted(sizes))
    top = sizes[-1]
    n = F.coalesce(length, F.lit(0)).cast("long")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / top)).cast("int"))).alias("piece"))
    start = (F.col("piece") * F.lit(top)).cast("long")
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(top), F.col("n") - start).cast("long").alias("length"))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _rows(frames, sizes, window, TaskContext.get().partitionId() << 40, True)

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _rows(frames, sizes, window, (1 << 62) + (TaskContext.get().partitionId() << 40), False)

    packed = written(pieces.mapInPandas(first, SCHEMA), "packed")
    rest = packed.where("bin_id = -1").select("doc_id", "piece", "start", "length")
    tasks = max(1, rest.count() // window)
    again = rest.repartition(tasks).sortWithinPartitions("doc_id", "piece", "start", "length")
    return packed.where("bin_id is null or bin_id >= 0").unionByName(again.mapInPandas(second, SCHEMA))
