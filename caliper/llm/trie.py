"""The trie of conversations that share first turns.

Shape of the work. Texts are read once and become digests of 16 bytes with a length. Conversations of the same turns are one
class with a count, so that copies cost one row. Classes are parted by the hash of their first turn, and each part builds its
tries of pointer dictionaries in one applyInPandas call, folded by an iterative postorder. First-turn subtries with more turns
than LIMIT are not built: the turns that all their classes share become a chain of nodes, whose numbers are aggregates, and
the classes are parted again by the turn after it, until every subtrie is small; then the chains take their subtries' sums, the
deepest first. A chain ends where classes part, so that a round is needed for each branching within large subtries, not for
each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliper.operators.skew import join_hot
from caliper.sources.scratch import scope, written

#: Turns of a first-turn subtrie that is built in one call at most, and turns that a call gets on average.
LIMIT, PART = 8_000, 4_000
#: Bits of a conversation's number within a piece of a node's list of ends.
PIECE_BITS = 12
HEAD = 5
_NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _digest(s: Column) -> Column:
    return F.substring(F.unhex(F.sha2(s, 256)), 1, 16)


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, d, n): each conversation's turns in order (null turns first, equal ones by digest) as digests of role and text
    and the texts' code points. Null roles and texts are empty; rows without a conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").alias("at"), _digest(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("d"), F.char_length(text).alias("n"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.col("t.d").alias("d"), F.col("t.n").alias("n"))


def with_shared_heads(convs: DataFrame, block: int = 100) -> DataFrame:
    """convs (conv_id, d, n) with the first h turns of each replaced by the first h (all, if fewer) of the conversation that
    begins its block of ids, none if there is none; h is crc32 of the decimal id, modulo HEAD + 1."""
    heads = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("__first"), F.slice("d", 1, HEAD).alias("__d"), F.slice("n", 1, HEAD).alias("__n"))
    keyed = convs.withColumn("__first", F.col("conv_id") - F.col("conv_id") % block).withColumn("__h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int"))
    both = keyed.join(heads, "__first", "left")
    swap = lambda own, head: F.concat(F.coalesce(F.slice(head, F.lit(1), F.col("__h")), F.slice(own, 1, 0)), F.slice(own, F.col("__h") + 1, F.size(own)))
    return both.select("conv_id", swap("d", "__d").alias("d"), swap("n", "__n").alias("n"))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, piece, ids), sorted by key and piece: (key, ends), SHA-256 of a key's pieces joined by commas. Of a key's
    list the task holds one piece and the state of the hash."""
    key, state = None, hashlib.sha256()
    for b in batches:
        out: list[tuple[bytes, str]] = []
        for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield _pairs(out)
    if key is not None:
        yield _pairs([(key, state.hexdigest())])


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.string())], names=["key", "ends"])


def _classes(convs: DataFrame) -> DataFrame:
    """(d, n, c, lo, ends) of the different lists of turns: how many conversations have it, the smallest, and the digest of
    all their ids."""
    keyed = written(convs.withColumn("key", _digest(F.concat_ws("", F.transform("d", F.hex)))), "trie-convs")
    pieces = keyed.groupBy("key", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("c"), F.min("conv_id").alias("lo"))
    pieces = written(pieces, "trie-ends")
    ends = pieces.select("key", "piece", "ids").repartition("key").sortWithinPartitions("key", "piece").mapInArrow(_hash_lists, "key binary, ends string")
    counts = pieces.groupBy("key").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"))
    named = counts.join(ends, "key").select("c", "lo", "ends")
    return written(keyed.join(named, keyed["conv_id"] == named["lo"]).select("d", "n", "c", "lo", "ends"), "trie-classes")


def subtries(classes: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of classes (p, k, d, n, c, lo, ends): p and k are the smallest member and the depth of the node
    that the first turn hangs on. `top` marks the nodes of first turns."""
    kids: list[dict[bytes, int]] = []
    roots: dict[tuple[int, int], dict[bytes, int]] = {}
    parent, depth, count, lo, own, ends = [], [], [], [], [], []
    for p, k, d, n, c, least, end in classes[["p", "k", "d", "n", "c", "lo", "ends"]].itertuples(index=False):
        at, up = roots.setdefault((p, k), {}), -1
        for i, (turn, length) in enumerate(zip(d, n, strict=True)):
            node = at.get(turn)
            if node is None:
                node = at[turn] = len(kids)
                kids.append({})
                parent.append(up)
                depth.append(k + 1 + i)
                count.append(0)
                lo.append(least)
                own.append(length)
                ends.append(_NONE)
            count[node] += c
            lo[node] = min(lo[node], least)
            at, up = kids[node], node
        ends[up] = end
    saved = [(c - 1) * n for c, n in zip(count, own, strict=True)]
    leaves = [0] * len(kids)
    hangs_on = {node: key for key, tops in roots.items() for node in tops.values()}
    for top in hangs_on:  # postorder: a node is folded into its parent when its own children have been
        stack = [(top, iter(kids[top].values()))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                stack.append((child, iter(kids[child].values())))
                continue
            stack.pop()
            leaves[node] += not kids[node]
            if stack:
                leaves[stack[-1][0]] += leaves[node]
                saved[stack[-1][0]] += saved[node]
    up = [hangs_on[i][0] if p < 0 else lo[p] for i, p in enumerate(parent)]
    return pd.DataFrame({"conv_id": np.array(lo, np.int64), "depth": np.array(depth, np.int64), "parent_conv_id": np.array(up, np.int64), "n_convs": count, "n_children": [len(x) for x in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "top": [p < 0 for p in parent]})


def _built(rest: DataFrame, turns: int) -> DataFrame:
    """The nodes of all subtries of rest, in parts of about PART turns."""
    parts = max(1, -(-turns // PART))
    part = F.pmod(F.xxhash64("p", "k", F.get("d", F.lit(0))), F.lit(parts)).alias("__part")
    return written(rest.groupBy(part).applyInPandas(subtries, f"{NODE}, top boolean"), "trie-nodes")


def _shared(first: Column, last: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(first, last, lambda a, b: F.coalesce(a == b, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def _chains(big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the classes (g, p, k, d, n, c, lo, ends) of large subtries g: the chain of turns that all of a subtrie's classes share,
    (g, p, k, glo, gc, shared, lens, ends), and what is left of the classes below the chains."""
    least, most = F.min("d").alias("least"), F.max("d").alias("most")
    sums = big.groupBy("g").agg(F.first("p").alias("p"), F.first("k").alias("k"), F.min("lo").alias("glo"), F.sum("c").alias("gc"), least, most, F.min_by("n", "d").alias("lens"))
    sums = sums.withColumn("shared", _shared(F.col("least"), F.col("most"))).withColumn("lens", F.slice("lens", F.lit(1), F.col("shared")))
    chains = written(sums.drop("least", "most"), "trie-chains")
    met = written(join_hot(big.drop("p"), chains.select("g", "glo", "shared"), "g"), "trie-met")
    ends = met.where(F.size("d") == F.col("shared")).select("g", "ends")
    below = met.where(F.size("d") > F.col("shared"))
    cut = lambda c: F.slice(c, F.col("shared") + 1, F.size(c)).alias(c)
    rest = below.select(F.col("glo").alias("p"), (F.col("k") + F.col("shared")).alias("k"), cut("d"), cut("n"), "c", "lo", "ends")
    return written(chains.join(ends, "g", "left").withColumn("ends", F.coalesce("ends", F.lit(_NONE))), "trie-chains"), rest


def prefix_trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of convs (conv_id, d, n), each conversation being a list of turns with lengths; conv_id is unique.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member, turns,
    the parent's smallest member (null for the root), members, children, childless nodes at or below, the lengths of last turns
    that members after the first repeat, summed over the subtree, and SHA-256 of the ascending ids that end there. Conversations
    without turns belong to the root alone; no conversations have no trie. A conversation's digests are one row."""
    with scope() as kept:
        return _trie(convs, limit, kept)


def _trie(convs: DataFrame, limit: int, kept: list[DataFrame]) -> DataFrame:
    """prefix_trie; `kept` gets the tables that the result reads."""
    spark = convs.sparkSession
    classes = _classes(convs)
    total, first, turns = classes.agg(F.sum("c"), F.min("lo"), F.sum(F.size("d"))).first()
    if total is None:
        return spark.createDataFrame([], NODE)
    empty = classes.where(F.size("d") == 0).select("ends").first()
    rest = classes.where(F.size("d") > 0).select(F.lit(first).alias("p"), F.lit(0).alias("k"), "d", "n", "c", "lo", "ends")
    nodes, rounds = [], []
    while True:
        group = F.struct("p", "k", F.get("d", F.lit(0)).alias("turn"))
        sizes = rest.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("d")).alias("turns"))
        sizes = written(sizes.withColumn("big", (F.col("rows") > 1) & (F.col("turns") > limit)), "trie-sizes")
        small, n_big = sizes.agg(F.sum(F.when(~F.col("big"), F.col("turns"))), F.count_if("big")).first()
        if not n_big:
            nodes.append(_built(rest, turns))
            break
        parted = written(join_hot(written(rest.withColumn("g", group), "trie-rest"), sizes.select("g", "big"), "g"), "trie-parted")
        nodes.append(_built(parted.where("not big").drop("g", "big"), small or 0))
        chains, rest = _chains(parted.where("big").drop("big"))
        rounds.append(chains)
        rest = written(rest, "trie-rest")
        turns = rest.agg(F.sum(F.size("d"))).first()[0] or 0
    kept += nodes
    built = nodes[0]
    for more in nodes[1:]:
        built = built.unionByName(more)
    tops = built.where("top").select(F.col("parent_conv_id").alias("p"), (F.col("depth") - 1).alias("k"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    out = built.drop("top")
    for chains in reversed(rounds):
        sums = tops.groupBy("p", "k").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"), F.count(F.lit(1)).alias("children"))
        sums = sums.select(F.col("p").alias("glo"), F.col("k").alias("bottom"), "leaves", "below", "children")
        keyed = chains.withColumn("bottom", (F.col("k") + F.col("shared")).cast("bigint"))
        folded = written(keyed.join(sums, ["glo", "bottom"]), "trie-folded")
        kept.append(folded)
        repeats = (F.col("gc") - 1) * F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x)
        tops = tops.unionByName(folded.select("p", F.col("k").cast("bigint").alias("k"), "leaves", (F.col("below") + repeats).alias("saved")))
        out = out.unionByName(_chain_nodes(folded))
    sums = tops.where((F.col("p") == first) & (F.col("k") == 0)).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = sums.select(
        F.lit(first).alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(total).alias("n_convs"), F.col("children").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("bigint").alias("saved_tokens"), F.lit(empty["ends"] if empty else _NONE).alias("ends_sha256"),
    )
    return out.unionByName(root)


def _chain_nodes(folded: DataFrame) -> DataFrame:
    """A node for each turn of the chains: every one but the last has one child and no ends."""
    steps = folded.select("p", "k", "glo", "gc", "bottom", "leaves", "below", "children", "ends", F.posexplode("lens").alias("i", "own"))
    depth = (F.col("k") + 1 + F.col("i")).cast("bigint")
    onward = Window.partitionBy("glo", "bottom").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    last = depth == F.col("bottom")
    return steps.select(
        F.col("glo").alias("conv_id"), depth.alias("depth"), F.when(F.col("i") == 0, F.col("p")).otherwise(F.col("glo")).alias("parent_conv_id"), F.col("gc").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + F.sum((F.col("gc") - 1) * F.col("own")).over(onward)).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.lit(_NONE)).alias("ends_sha256"),
    )
