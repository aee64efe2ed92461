"""Conversation tries, vector codes and the sanitiser, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caliper.llm import codes, privacy, queries, trie

TURNS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute_trie(turns):
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(c - int(math.fmod(c, 100)), [])[:h] + seq[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, d == len(seq)))
    kids = Counter(k[:-1] for k in members if k)
    rows = set()
    for k, v in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(c for c, end in v if end))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        parent = min(c for c, _ in members[k[:-1]]) if k else None
        rows.add((min(c for c, _ in v), len(k), parent, len(v), kids[k], sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def tree_of(spark, turns, limit=trie.LIMIT):
    df = spark.createDataFrame(turns, TURNS).withColumn("d", F.lit("clash")).withColumn("key", F.lit(1))
    out = trie.prefix_trie(trie.with_shared_heads(trie.conversations_of(df)), limit)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversations(rng, n, first):
    out = []
    for c in [*range(0, 400, 100), *rng.sample(range(-60, 400), n)]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            out.append((c, t, "user", first if t == 0 and rng.random() < 0.6 else rng.choice("abc") * rng.randint(1, 2)))
    return [r for i, r in enumerate(out) if (r[0], r[1]) not in {x[:2] for x in out[:i]}]


@pytest.mark.parametrize("limit", [trie.LIMIT, 30, 4])
def test_trie_against_brute_force(spark, limit):
    """With small limits first-turn subtries are parted again and again by later turns."""
    turns = conversations(random.Random(5), 60, "hello")
    assert tree_of(spark, turns, limit) == brute_trie(turns)


def test_long_shared_chains(spark):
    """Conversations that share 40 turns and part only then, some of them ending on the way."""
    turns = [(c, t, "user", f"turn {t}" if t < 40 else f"{c % 7} {t}") for c in range(1, 60) for t in range(12 if c % 5 == 0 else 45)]
    assert tree_of(spark, turns, 100) == brute_trie(turns)


def test_trie_of_odd_conversations(spark):
    turns = [(1, None, None, None), (1, 0, "user", ""), (2, 0, "", ""), (7, 3, "user", "x"), (7, 3, "user", "x"), (None, 0, "user", "lost"), (9, 0, "user", "y" * 200_000), (-3, 1, None, "z"), (205, 0, "a", "b")]
    assert tree_of(spark, turns) == brute_trie(turns)
    assert tree_of(spark, turns, 1) == brute_trie(turns)
    assert tree_of(spark, []) == set()


def test_conversations_without_turns(spark):
    """Of conversations whose own turns are all replaced by a head that is not there, only the root remains."""
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    assert tree_of(spark, [(c, 0, "user", "gone")]) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_ends_of_a_large_class(spark):
    """20,000 equal conversations: their ids are hashed in pieces, in numeric order."""
    turns = [(c, 0, "user", "hi") for c in range(-100, 20_000)]
    rows = {r[1]: r for r in tree_of(spark, turns)}
    with_head = sorted(c for c in range(-100, 20_000) if zlib.crc32(str(c).encode()) % 6 or True)
    assert rows[1][7] == hashlib.sha256(",".join(map(str, with_head)).encode()).hexdigest() and rows[1][3] == 20_100


def plain_lloyd(rows, dim=None):
    dim = dim or len(rows[0][1])
    width = max(1, -(-dim // 16))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.zeros((len(rows), 16 * width), np.int64)
    x[:, :dim] = [[math.floor(256 * v) for v in r[1]] for r in rows]
    x = x.reshape(len(rows), 16, width)
    books = x[: codes.ENTRIES].copy()

    def assign():
        return ((x[:, None] - books[None]) ** 2).sum(axis=3).argmin(axis=1)

    for _ in range(codes.ROUNDS):
        own = assign()
        for p in range(16):
            for e in range(len(books)):
                at = own[:, p] == e
                if at.any():
                    books[e, p] = x[at, p].sum(axis=0) // at.sum()
    own = assign()
    errors = ((x - books[own, np.arange(16)]) ** 2).sum(axis=(1, 2))
    labels = Counter()
    for r, e in zip(rows, errors.tolist(), strict=True):
        labels[r[2]] += e
    sha = hashlib.sha256(",".join(str(v) for v in books.transpose(1, 0, 2).reshape(-1).tolist()).encode()).hexdigest()
    return sorted(((r[0], bytes(c).hex(), e, labels[r[2]], sha) for r, c, e in zip(rows, own.tolist(), errors.tolist(), strict=True)), key=str)


def coded(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("code", "ids", "error")})
    path = tmp_path / f"t{random.random()}"
    df.repartition(3).write.parquet(str(path / "embeddings.parquet"))
    out = queries.op12_heap_lloyd_codes(spark, str(path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in out.collect()), key=str)


def vectors(rng, n, dim, clusters=90):
    centers = rng.normal(size=(clusters, dim))
    return [(i, [float(np.float32(v)) for v in centers[rng.integers(clusters)] + 0.1 * rng.normal(size=dim)], int(rng.integers(4)) if rng.random() < 0.8 else None) for i in range(n)]


@pytest.mark.parametrize(("n", "dim"), [(700, 32), (700, 20), (40, 16), (1, 16)])
def test_codes_against_plain_lloyd(spark, tmp_path, n, dim):
    rows = vectors(np.random.default_rng(n + dim), n, dim)
    assert coded(spark, tmp_path, rows) == plain_lloyd(rows)


def test_codes_of_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [*vectors(rng, 200, 16), *((7, [0.5] * 16, 2) for _ in range(5)), *((i, [-0.001] * 16, None) for i in range(300, 420)), (None, [0.25] * 16, 1), (900, [100.0] * 16, 0)]
    bad = [(500, None, 1), (501, [None] * 16, 1), (502, [float("nan")] + [0.0] * 15, 1), (503, [float("inf")] + [0.0] * 15, 1)]
    got = coded(spark, tmp_path, [*good, *bad, (600, [1.0] * 4, 77), (601, [], 77)])
    other = [r for r in got if r[0] in (600, 601)]
    assert [r[:4] for r in other] == [(600, None, None, None), (601, None, None, None)]
    assert [r for r in got if r not in other] == plain_lloyd(good)
    assert coded(spark, tmp_path, bad) == [] == coded(spark, tmp_path, [])


def test_only_violated_parts_are_compared_again(spark):
    """Codes are exact although the later assignments look at a small part of the vectors' parts, where entries are apart."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(64, 32)) * 4
    rows = [(i, [float(np.float32(v)) for v in centers[i % 64] + 0.05 * rng.normal(size=32)], 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    out = codes.encode(df)
    assert out.rescans[0] == 3000 * 16 and 0 < out.rescans[1] < 0.3 * out.rescans[0]
    got = sorted((r["vec_id"], r["code"].hex(), r["error"]) for r in out.rows.collect())
    assert got == sorted((i, c, e) for i, c, e, _, _ in plain_lloyd(rows))


def test_heaps_hold_every_part_once():
    rng = np.random.default_rng(2)
    x = codes.integers(rng.normal(size=(500, 32)), 32)
    books = codes.Books(x[:64].transpose(1, 0, 2).copy(), np.zeros((16, 64)))
    block = codes.Block.fresh(x, books)
    for _ in range(4):
        sums, counts = np.zeros_like(books.entries), np.zeros((16, 64), np.int64)
        for p in range(16):
            np.add.at(sums[p], block.codes[:, p], x[:, p])
            counts[p] = np.bincount(block.codes[:, p], minlength=64)
        books = books.moved(sums, counts)
        block.reassign(books)
        d = ((x[:, :, None] - books.entries[None]) ** 2).sum(axis=3)
        assert (block.codes == d.argmin(axis=2)).all()
        for p, (keys, rows) in enumerate(block.heaps):
            assert sorted(rows.tolist()) == list(range(500)) and len(keys) == 500
            assert (np.sort(block.codes[rows, p]) == block.codes[rows, p]).all()


def test_large_components_are_held(spark, tmp_path):
    rows = [(1, [3e38] + [0.0] * 15, 1), (2, [-3e38] + [0.0] * 15, 1), (3, [0.0] * 16, 1)]
    got = coded(spark, tmp_path, rows)
    assert [r[2] for r in got] == [0, 0, 0] and len({r[1] for r in got}) == 3


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_patterns_against_plain_matches():
    rng = random.Random(4)
    pieces = ["a@b.c", "@", ".", "x_y", "a.b@c-d.e.f", "1", "22", "255", "256", "1.2.3.4", "999.1.1.1", "+", "(", ")", " ", "-", "+4", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "٣", "%", "5500000000000004", "+49 (30) 123-456", "0", "00", "@@", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert privacy.base_spans(text) == plain_spans(text), text


def test_patterns_are_linear():
    for text in ("x" * 500_000, "1" * 500_000, "+1" + "(" * 500_000, "a@" * 200_000, "1." * 200_000, "+" * 500_000, "x" * 500_000 + "@", "1 " * 300_000, "a.b@" + "c." * 200_000):
        privacy.base_spans(text)


def speech(rng, n):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 9))) for _ in range(n))


def corpus(rng):
    """Twelve texts with the same address and the name zanderhof, and one of the texts copied; a word of half the corpus beside them."""
    rows = [f"{speech(rng, 30)} {'common' if i % 2 else 'rare'} {speech(rng, 30)}" for i in range(400)]
    for i in range(12):
        rows[i] = f"{speech(rng, 10)} Zanderhof {speech(rng, 8)} id x-{i}-77 q-7-z {speech(rng, 6)} common {speech(rng, 5)} mia@example.org {speech(rng, 4)}"
    rows += [rows[0]] * 20
    unique = f"{speech(rng, 20)} singleton {speech(rng, 20)} ending bob@example.org"
    return [*rows, *([unique] * 15), *(f"{unique} {i}" for i in range(5)), f"{speech(rng, 12)} zanderhof {speech(rng, 5)}", "", None]


@pytest.mark.parametrize("few", [privacy.FEW, 0])
def test_terms_that_reveal(spark, few):
    """The name that stands with an address in twelve contexts reveals it; words of the corpus do not, nor do words of copies and
    near-copies, which are one context. few=0: nothing is sent to the tasks, terms are joined."""
    texts = corpus(random.Random(1))
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, term int").repartition(3)
    terms = privacy.revealing_terms(docs, gain=3.0, few=few)
    found = {r["term"]: r["action"] for r in terms.collect()}
    assert found["zanderhof"] == "generalise" and "common" not in found and "singleton" not in found
    assert found["q-7-z"] == "remove"  # no other text has a word of this shape
    assert set(found) <= {"zanderhof", "q-7-z", "id", "ending"}  # the last has another neighbour in each near-copy
    rows = {r["doc_id"]: r for r in privacy.protected(docs, terms, few=few).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = [(s["kind"], s["start"], s["end"]) for s in rows[i]["spans"] if s["kind"] in privacy.KINDS]
        more = [(s["kind"], (text or "")[s["start"] : s["end"]].lower()) for s in rows[i]["spans"] if s["kind"] not in privacy.KINDS]
        assert base == plain_spans(text or "")
        assert sorted(more) == sorted((found[w], w) for w in (t for t, _, _ in privacy.term_spans(text or "", base)) if w in found)
    assert [s["kind"] for s in rows[len(texts) - 3]["spans"]] == ["generalise"]
    clean = rows[0]["sanitised"]
    assert "[email]" in clean and "anderhof" not in clean and "q-7-z" not in clean and "mia@" not in clean
    assert rows[len(texts) - 1]["spans"] == [] and rows[len(texts) - 1]["sanitised"] == ""


def brute_revealing(texts, bits, gain, least):
    """Terms by the definition: contexts of first uses in different texts, over all texts."""
    docs = [(t, privacy.base_spans(t)) for t in texts]
    held = defaultdict(set)
    rows = Counter()
    for t, s in docs:
        for e in privacy.entities(t, s):
            held[e].add(t)
            rows[e] += 1
    contexts, joint = defaultdict(set), defaultdict(set)
    for t, s in docs:
        for w, c in privacy.first_contexts(privacy._words(t, s)).items():
            contexts[w].add(c)
            for e in privacy.entities(t, s):
                joint[w, e].add(c)
    return {w for (w, e), c in joint.items() if len(held[e]) >= least and len(c) >= least and (left := math.log2(len(contexts[w]) / len(c))) <= bits and math.log2(len(texts) / rows[e]) - left >= gain}


@pytest.mark.parametrize("seed", range(3))
def test_terms_against_the_definition(spark, seed):
    rng = random.Random(seed)
    words = [speech(rng, 1) for _ in range(150)]
    texts = []
    for i in range(300):
        who = rng.randint(0, 9)
        parts = rng.choices(words[who * 15 : who * 15 + 20] if rng.random() < 0.7 else words, k=12)
        texts.append(" ".join([*parts, *([f"p{who}@x.org"] if rng.random() < 0.5 else [])]))
    texts += texts[:40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["term"] for r in privacy.revealing_terms(docs, bits=1.5, gain=1.0).collect()}
    want = brute_revealing(texts, 1.5, 1.0, 3)
    assert got == want and want


def test_sanitiser_query_and_odd_texts(spark, tmp_path):
    rows = [(1, None), (1, "call +49 30 1234567 or a@b.co"), (None, "10.0.0.1"), (3, "4111 1111 1111 1111"), (3, "4111 1111 1111 1111"), (4, "x" * 300_000 + " a@b.co")]
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_information_sanitiser(spark, str(tmp_path))
    want = []
    for i, t in rows:
        spans = plain_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = Counter(k for k, _, _ in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert privacy.protected(df.limit(0), privacy.revealing_terms(df.limit(0))).count() == 0
