"""Near-duplicate documents by MinHash: many universal hash minima, banding, signature and full-set verification,
components by alternating large-star and small-star.

Shape of the work. Documents with the same shingle set are one node, the smallest id (an aggregate with map-side
combine, so a group of copies of any size costs one row a task). Nodes meet in band buckets. Round one links each member
of a bucket with the bucket's smallest id, one row a member; full sets are compared where a hub's set meets a chunk of its
partners. Round two looks only at buckets that still hold several components. A document that may link with one of another
component shares a rare shingle with it (prefix filter: in any common order of shingles, rarest first, one of the first
n - ceil(2 * 0.8 / 1.8 * n) + 1 of the smaller of two linked sets, of n, is among the first m - ceil(0.8 m) + 1 of the larger,
of m); the others leave, so that texts of one template that are not linked cost no pairs up to the threshold. Tasks compare the
signatures of the rest block against block, confirm what may be a link on the full sets of both texts, and hand on no more
links than join the components. Hot keys (buckets, hubs, groups of copies) are joined by broadcast, see join_hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.blocks import blocks
from caliper.llm.shingles import intersection, shingle_set
from caliper.operators.components import connected_components
from caliper.operators.skew import join_hot
from caliper.sources.scratch import scope, written

#: A pair of similarity 0.8 shares none of 32 bands of 4 minima with probability 5e-8.
BANDS, ROWS = 32, 4
N_HASH = BANDS * ROWS
#: Members of a bucket that are compared with one another in one task, and the bytes of their sets.
BLOCK, BLOCK_BYTES = 1024, 1 << 25
#: Slots of the counts by which round two orders shingles: 1 MB that is broadcast, 4 MB of counts to the driver.
SLOT_BITS = 18
#: Document ids (8 bytes each) that are broadcast at most.
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**63, N_HASH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, N_HASH, dtype=np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The N_HASH minima of (a*x + b) mod 2^64 >> 32 over a nonempty set, as uint32."""
    out = np.full(N_HASH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        x = s[None, i : i + 2048]
        np.minimum(out, (_A[:, None] * x + _B[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, 1):
                n, key1, key2, sigs = [], [], [], []
                for t in part.column(1):
                    s = shingle_set(t.as_py(), k)
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    n.append(len(s))
                    key1.append(int.from_bytes(d[:8], "little", signed=True))
                    key2.append(int.from_bytes(d[8:], "little", signed=True))
                    sigs.append(minima(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n_shingles", "key1", "key2", "sig"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, 1):
                s = [shingle_set(t.as_py(), k).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.binary())], names=["id", "members"])

    return run


def _confirm(percent: int):
    """From rows (a, chunk, partner, members), those of one (a, chunk) adjacent and a's own set (partner null) first: pairs
    (a, b) whose full sets have 100 * intersection >= percent * union. A hub's set and one partner's are held. An id that
    stands with several texts has a set for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for batch in batches:
            left, right = [], []
            for a, c, b, x in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                members = np.frombuffer(x.as_buffer(), np.uint64)
                if b is None:
                    hub, own = (a, c), [*(own if hub == (a, c) else ()), members.copy()]
                elif hub == (a, c) and any(100 * (both := intersection(h, members)) >= percent * (len(h) + len(members) - both) for h in own):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _slot_counts(k: int):
    """(slot, c): how often the shingles of a slot stand in the texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            for part in blocks(b, 1):
                s = np.concatenate([shingle_set(t.as_py(), k) for t in part.column(1)])
                total += np.bincount((s >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "c"])

    return run


def prefix(s: np.ndarray, percent: int, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, ties by hash: two sets of which 100 * intersection >= percent * union share one."""
    order = np.lexsort((s, counts[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))
    least = -(-percent * len(s) // 100)  # shingles that a linked set has in common with this one
    return s[order[: len(s) - least + 1]]


def short_size(n: int, percent: int) -> int:
    """How many of the prefix of a set of n shingles are its short prefix. Of two linked sets, of n and m >= n shingles, at least
    percent * (n + m) / (100 + percent) are common, which is least for m = n: one of the first of the smaller set, as many as
    that leaves out and one more, is in the prefix of the larger."""
    return n - -(-2 * percent * n // (100 + percent)) + 1 if n else 0


def _prefixes(k: int, percent: int, shared):
    """(id, component, n, shingle, short) of the prefixes of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, 1):
                sets = [shingle_set(t.as_py(), k) for t in part.column(1)]
                rare = [prefix(s, percent, shared.value)[: len(s)] for s in sets]
                size = np.array([len(x) for x in rare], np.int64)
                short = [np.arange(len(x)) < short_size(len(s), percent) for x, s in zip(rare, sets, strict=True)]
                columns = [np.repeat(part.column(c).to_numpy(), size) for c in (0, 2)] + [np.repeat([len(s) for s in sets], size)]
                joined = lambda arrays, kind: np.concatenate(arrays) if arrays else np.empty(0, kind)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns), pa.array(joined(rare, np.uint64).view(np.int64)), pa.array(joined(short, bool), pa.bool_())],
                    names=["id", "component", "n", "shingle", "short"],
                )

    return run


def _agreeing(floor: int):
    """Keeps pairs (a, b) of which at least `floor` minima agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, N_HASH) for c in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((s == t).sum(axis=1) >= floor))

    return run


def _signed_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, 1):
                s = [shingle_set(t.as_py(), k) for t in part.column(1)]
                sig = [minima(x).tobytes() if len(x) else None for x in s]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in s], pa.binary()), pa.array(sig, pa.binary())], names=["id", "members", "sig"])

    return run


def _join_components(floor: int, percent: int):
    """From rows (hub, i, j, chunk, id, component, members, sig), those of one (hub, i, j) adjacent: links (a, b) between
    different components. Pairs whose minima and sizes allow a link are confirmed on their full sets, best first; a link
    joins its components there and then, so that a block of n rows gives n - 1 links at most."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        i, j = rows[0][1], rows[0][2]
        ids = np.array([r[4] for r in rows], dtype=np.int64)
        _, root = np.unique(np.array([r[5] for r in rows], dtype=np.int64), return_inverse=True)
        chunk = np.array([r[3] for r in rows])
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        n = np.array([len(s) for s in sets])
        sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint32).reshape(-1, N_HASH)
        right = np.flatnonzero(chunk == j)
        for x in np.flatnonzero(chunk == i):
            y = right[(root[right] != root[x]) & ((ids[right] > ids[x]) | (i != j))]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            if not len(y):
                continue
            agree = (sig[y] == sig[x]).sum(axis=1)
            for z in y[np.argsort(-agree, kind="stable")][: int((agree >= floor).sum())]:
                if root[z] != root[x]:
                    both = intersection(sets[x], sets[z])
                    if 100 * both >= percent * (n[x] + n[z] - both):
                        root[root == root[z]] = root[x]
                        yield min(int(ids[x]), int(ids[z])), max(int(ids[x]), int(ids[z]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len({r[5] for r in held}) > 1:
                out.extend(links(held))
            held.clear()

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != r[:3]:
                    close()
                held.append(r)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return run


class _Linker:
    def __init__(self, docs: DataFrame, feats: DataFrame, k: int, percent: int):
        self.k, self.percent = k, percent
        t = percent / 100
        #: Four standard deviations below the minima that a pair at the threshold shares on average.
        self.floor = int(N_HASH * t - 4 * (N_HASH * t * (1 - t)) ** 0.5)
        self.docs = docs
        self.members = feats.where("n_shingles > 0 and doc_id is not null").groupBy(F.struct("key1", "key2").alias("key")).agg(F.min("doc_id").alias("id"))
        self.members = written(self.members, "dedup-members")
        first = self.members.select(F.col("key.key1").alias("key1"), F.col("key.key2").alias("key2"), F.col("id").alias("doc_id"))
        nodes = feats.join(first, ["key1", "key2", "doc_id"], "left_semi")
        self.nodes = written(nodes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig"), "dedup-nodes")
        band = F.explode(F.array(*[F.xxhash64(F.lit(j), F.expr(f"substring(sig, {4 * ROWS * j + 1}, {4 * ROWS})")) for j in range(BANDS)]))
        bands = written(self.nodes.select("id", "n", band.alias("bucket")), "dedup-bands")
        hubs = bands.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
        hubs = written(hubs.select("bucket", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "dedup-hubs")
        #: (bucket, id, n, hub, hub_n) of the buckets with several members.
        self.met = written(join_hot(bands, hubs, "bucket"), "dedup-met")

    def _texts(self, ids: DataFrame) -> DataFrame:
        """(doc_id, text, other columns of ids) of distinct doc_ids. Up to BROADCAST_IDS ids go to the texts, beyond that the
        texts are shuffled to the ids."""
        ids = written(ids, "dedup-ids")
        few = ids.count() <= BROADCAST_IDS
        rest = [c for c in ids.columns if c != "doc_id"]
        return self.docs.join(F.broadcast(ids) if few else ids, "doc_id").select("doc_id", "text", *rest)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) those that are links; a may have any number of partners, b has few."""
        sig = self.nodes.select("id", "sig")
        left = join_hot(written(pairs, "dedup-pairs"), sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
        both = left.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")
        near = written(both.mapInArrow(_agreeing(self.floor), "a long, b long").distinct(), "dedup-near")
        hubs = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("chunks"))
        ends = hubs.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
        sets = written(self._texts(ends).select("doc_id", "text").mapInArrow(_sets(self.k), "id long, members binary").where("length(members) > 0").distinct(), "dedup-sets")
        chunk = F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk")
        partners = join_hot(near, hubs, "a").select("a", chunk, "b").join(sets.withColumnRenamed("id", "b"), "b").select("a", "chunk", "b", "members")
        own = hubs.join(sets.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "members")
        met = partners.unionByName(own).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
        return written(met.mapInArrow(_confirm(self.percent), "a long, b long").distinct(), "dedup-links")

    def star_pairs(self) -> DataFrame:
        """Each member of a bucket with the bucket's smallest id, where the set sizes allow a link."""
        fit = 100 * F.least("n", "hub_n") >= self.percent * F.greatest("n", "hub_n")
        return self.met.where((F.col("id") != F.col("hub")) & fit).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()

    def joining_links(self, components: DataFrame) -> DataFrame:
        """Links between the components that share a bucket. Buckets with the same smallest id are one group, so that what
        meets in many buckets is compared once or a few times; a large group is compared chunk by chunk."""
        labels = components.withColumnRenamed("component", "known")
        labelled = self.met.select("id", "n", "bucket", "hub").join(labels, "id", "left").withColumn("component", F.coalesce("known", "id"))
        labelled = written(labelled.select("id", "n", "bucket", "hub", "component"), "dedup-labelled")
        mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        met = join_hot(labelled, written(mixed, "dedup-mixed-buckets"), "bucket")
        rows = written(met.select("hub", "id", "n", "component").distinct(), "dedup-mixed")
        texts = written(self._texts(rows.select(F.col("id").alias("doc_id"), "component").distinct()), "dedup-mixed-texts")
        able = written(self._able(texts), "dedup-able")
        rows = written(rows.join(able, "id", "left_semi"), "dedup-able-rows")
        parts = F.greatest(F.count(F.lit(1)) / F.lit(float(BLOCK)), F.sum("n") * 8 / F.lit(float(BLOCK_BYTES)))
        groups = rows.groupBy("hub").agg(F.ceil(parts).cast("int").alias("chunks"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("hub", "chunks")
        rows_ = join_hot(rows, written(groups, "dedup-groups"), "hub").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
        met = rows_.select("hub", "chunk", other, "id", "component")
        sets = texts.join(able.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_signed_sets(self.k), "id long, members binary, sig binary").where("sig is not null")
        keyed = met.join(sets, "id").select("hub", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "component", "members", "sig")
        near = keyed.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "id")
        return written(near.mapInArrow(_join_components(self.floor, self.percent), "a long, b long").distinct(), "dedup-joining")

    def _able(self, texts: DataFrame) -> DataFrame:
        """Of (doc_id, text, component) the ids of which a pair with another component passes the prefix filter, as far as the
        sizes and components of a shingle's rows tell: the smaller set has the shingle in its short prefix, the other in its own."""
        slots = texts.select("doc_id", "text").mapInArrow(_slot_counts(self.k), "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
        counts = np.zeros(1 << SLOT_BITS, np.uint32)
        counts[slots["slot"].to_numpy()] = np.minimum(slots["c"].to_numpy(), np.iinfo(np.uint32).max)
        shared = texts.sparkSession.sparkContext.broadcast(counts)
        rare = written(texts.mapInArrow(_prefixes(self.k, self.percent, shared), "id long, component long, n long, shingle long, short boolean"), "dedup-rare")
        some = lambda f, c, name: f(F.when(F.col("short"), F.col(c))).alias(name)
        several = rare.groupBy("shingle").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("n").alias("most"),
            some(F.min, "component", "short_lo"), some(F.max, "component", "short_hi"), some(F.min, "n", "short_least"),
        ).where("lo <> hi and short_lo is not null")
        met = join_hot(rare, written(several, "dedup-several"), "shingle")
        other = lambda lo, hi: (F.col(lo) != F.col("component")) | (F.col(hi) != F.col("component"))
        smaller = F.col("short") & other("lo", "hi") & (F.col("most") >= F.col("n"))
        larger = other("short_lo", "short_hi") & (F.col("short_least") <= F.col("n"))
        return met.where(smaller | larger).select("id").distinct()


def _components_of(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct k-word shingles. Null or
    wordless texts have the empty set and no links; with fewer than k words the whole sequence is the one shingle. Rows that
    repeat a text belong together. component_id is the smallest doc_id reachable over links, kept says that it is the row's
    own. Rows with a null doc_id cannot be named: component_id is null and they are kept. Extra columns are ignored; empty
    docs give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scope() as kept:
        feats = written(docs.mapInArrow(_features(k), "doc_id long, n_shingles long, key1 long, key2 long, sig binary"), "dedup-feats")
        link = _Linker(docs, feats, k, percent)
        links = link.confirmed(link.star_pairs())
        components = written(_components_of(links), "dedup-components")
        joining = link.joining_links(components)
        if not joining.isEmpty():
            components = written(_components_of(links.unionByName(joining)), "dedup-components")
        rows = written(feats.select("doc_id", "n_shingles", F.struct("key1", "key2").alias("key")), "dedup-rows")
        kept += [rows, link.members, components]
    rep = link.members.join(components, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    linked = join_hot(rows.where("n_shingles > 0 and doc_id is not null"), rep, "key").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one for each doc_id, all columns as they were."""
    with scope() as kept:
        ids = near_duplicates(docs, k, percent).where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept"))
        keep = written(ids.where("kept").select("doc_id", "n"), "dedup-keep")
        kept.append(keep)
    once = docs.join(keep.where("n = 1").select("doc_id"), "doc_id", "left_semi")
    repeated = docs.join(keep.where("n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(repeated).select(docs.columns).unionByName(docs.where("doc_id is null"))
