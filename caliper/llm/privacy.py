"""Personal data in texts: patterns, and terms that reveal by their company what the patterns protect.

Values that the patterns find are the protected entities. A term reveals an entity if, of the different contexts in which texts
of the corpus use it, so many stand in texts with the entity that few bits are left to guess (-log2 p(entity | term) at most
BITS), and it says much more than the entity's share of the corpus (at least GAIN bits). A text gives a term one context, the
neighbours of its first use; different contexts are counted, so that copies, near-copies and passages that many texts share are
one piece of evidence. A revealing term is generalised to its shape where the shape is common enough to hide the entity, and
removed otherwise.

Shape of the work. One scan finds the entities of each text; entities in fewer than CONTEXTS texts cannot be revealed and leave.
Terms are gathered from the texts with the others only. A second scan counts the contexts of these candidates over the whole
corpus, each task to the candidate's own limit, beyond which it is out for good; a third writes the spans. Candidates and
revealing terms go to the tasks while they are at most `few`, and are joined with the terms of the texts beyond.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.blocks import blocks
from caliper.operators.skew import join_hot
from caliper.sources.scratch import scope, written

KINDS = ("email", "ip", "card", "phone")
#: What is left to guess of an entity, what a term must add, and the contexts that a statement needs.
BITS, GAIN, CONTEXTS = 1.0, 6.0, 3
#: Terms, or texts with protected entities, that are sent to all tasks at most.
FEW = 100_000
#: Longer terms stand for themselves by a digest.
LONG = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W_]+(?:[-'_][^\W_]+)*")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each address is sought from its @ on, so that long runs of letters are read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    run = _DIGITS.search(text)
    while run:
        m = _IP.match(text, run.start()) if text.startswith(".", run.end()) else None
        if m and all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m.group().split("."))):
            yield m.span()
        run = _DIGITS.search(text, (m or run).end())


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start: the patterns' leftmost matches that stand their tests."""
    spans = [("email", *s) for s in _emails(text)]
    if not _DIGITS.search(text):
        return spans
    spans += [("ip", *s) for s in _ips(text)]
    for kind, pattern in (("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            digits = _NO_DIGIT.sub("", m.group()) if m.end() - m.start() < 1 << 12 else "0" * sum(map(str.isdecimal, m.group()))
            if (13 <= len(digits) <= 19 and luhn(digits)) if kind == "card" else 9 <= len(digits) <= 15:
                spans.append((kind, *m.span()))
    return spans


def entities(text: str, spans: list[Span]) -> set[str]:
    """The protected values of a text: digits alone for cards and phones, lower case for addresses."""
    value = lambda k, s: _NO_DIGIT.sub("", s) if k in ("card", "phone") else s.lower()
    return {f"{k}:{value(k, text[a:b])}" for k, a, b in spans}


def term_spans(text: str, spans: list[Span], wanted=None) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words of 3 characters and more outside the spans; of the wanted terms, if they are given."""
    words = _TERM.finditer(_blanked(text, spans))
    if wanted is None:
        return [(name(m.group()), *m.span()) for m in words if m.end() - m.start() > 2]
    if wanted.keys().isdisjoint(_words(text, spans)):
        return []
    return [(t, *m.span()) for m in words if m.end() - m.start() > 2 and (t := name(m.group())) in wanted]


def _words(text: str, spans: list[Span]) -> list[str]:
    """The names of all words outside the spans, in order."""
    words = list(map(str.lower, _TERM.findall(_blanked(text, spans))))
    return words if max(map(len, words), default=0) <= LONG else list(map(name, words))


def name(word: str) -> str:
    word = word.lower()
    return word if len(word) <= LONG else f"{word[:8]}#{xxhash.xxh3_128_hexdigest(word.encode())}"


def first_contexts(words: list[str], wanted=None) -> dict[str, int]:
    """term -> a hash of the words before and after its first use; of the wanted terms, if they are given."""
    if wanted is not None:
        first = {w: words.index(w) for w in wanted.keys() & set(words)}
    else:
        first = {w: i for i, w in reversed(list(enumerate(words))) if len(w) > 2}
    return {w: xxhash.xxh3_64_intdigest(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode()) - (1 << 63) for w, i in first.items()}


def _blanked(text: str, spans: list[Span]) -> str:
    """text with spaces for the spans: code points stay where they are."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if b > at:
            out += [text[at : max(a, at)], " " * (b - max(a, at))]
            at = b
    return "".join([*out, text[at:]])


def shape(word: str) -> str:
    """A class for each run of letters and of digits, 8 runs at most: at most some 100,000 shapes."""
    kinds = ("a" if c.isalpha() else "9" if c.isalnum() else c if c in "-'_" else "#" for c in word)
    out: list[str] = []
    for k in kinds:
        if not out or out[-1] != k:
            if len(out) == 8:
                return "".join(out) + "+"
            out.append(k)
    return "".join(out)


def _text(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    return (t.as_py() or "" for t in batch.column(column))


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


def _table(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _rows(held, schema)
            held = []
    yield _rows(held, schema)


def _entity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), _text(b, 1), strict=True):
                for e in entities(text, base_spans(text)):
                    yield key, e

    yield from _table(rows(), pa.schema([("key", pa.string()), ("entity", pa.string())]))


def _company_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with their protected entities: (entities, term, context)."""

    def rows():
        for b in batches:
            for known, text in zip(b.column(0).to_pylist(), _text(b, 1), strict=True):
                for term, context in first_contexts(_words(text, base_spans(text))).items():
                    yield known, term, context

    yield from _table(rows(), pa.schema([("entities", pa.list_(pa.string())), ("term", pa.string()), ("context", pa.int64())]), 1 << 14)


def _context_rows(limits: dict[str, int] | None, shapes: dict[str, int]):
    """(term, context, shape, n) of the terms of limits, or of all terms; a term that exceeds its limit in one task has a null
    context. With them, in how many of the task's texts each of the shapes stands, counted as far as its limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[int] | None] = {}
        found, wanted = dict.fromkeys(shapes, 0), set(shapes)

        def rows():
            for b in batches:
                for text in _text(b, 0):
                    words = _words(text, base_spans(text))
                    for s in wanted & _shapes(words, wanted) if wanted else ():
                        found[s] += 1
                        if found[s] >= shapes[s]:
                            wanted.discard(s)
                    for term, context in first_contexts(words, limits).items():
                        if limits is None:
                            yield term, context, None, None
                        elif (have := seen.setdefault(term, set())) is not None:
                            have.add(context)
                            if len(have) > limits[term]:
                                seen[term] = None
            for term, have in seen.items():
                for context in have if have is not None else (None,):
                    yield term, context, None, None
            for s, n in found.items():
                yield None, None, s, n

        yield from _table(rows(), pa.schema([("term", pa.string()), ("context", pa.int64()), ("shape", pa.string()), ("n", pa.int64())]))

    return run


def _shapes(words: list[str], wanted: set[str]) -> set[str]:
    """The shapes of words of 3 characters and more. Those of letters alone need no look at each character."""
    out = {shape(w) for w in set(words) if len(w) > 2 and not w.isalpha()} if wanted - {"a"} else set()
    if "a" in wanted and any(len(w) > 2 and w.isalpha() for w in words):
        out.add("a")
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.sha2(text, 256).alias("key"), text.alias("text"))


def revealing_terms(docs: DataFrame, bits: float = BITS, gain: float = GAIN, contexts: int = CONTEXTS, few: int = FEW) -> DataFrame:
    """(term, action): the terms of docs (text) that reveal a value that the patterns protect. action is `generalise` or `remove`.

    A statement needs `contexts` different contexts of the term in different texts with the value. Null and empty texts hold
    nothing; repeated texts add nothing; no texts reveal nothing."""
    with scope() as kept:
        kept.append(_revealing(docs, bits, gain, contexts, few))
        return kept[0]


def _revealing(docs: DataFrame, bits: float, gain: float, contexts: int, few: int) -> DataFrame:
    spark, keyed = docs.sparkSession, _keyed(docs)
    none = spark.createDataFrame([], "term string, action string")
    held = written(keyed.mapInArrow(_entity_rows, "key string, entity string").groupBy("key", "entity").agg(F.count(F.lit(1)).alias("rows")), "privacy-entities")
    often = held.groupBy("entity").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= contexts).drop("texts")
    often = written(often, "privacy-often")
    if often.isEmpty():
        return none
    lists = written(join_hot(held, often.select("entity"), "entity").groupBy("key").agg(F.collect_list("entity").alias("entities")), "privacy-lists")
    small = lists.count() <= few
    texts = keyed.join(F.broadcast(lists) if small else lists, "key").dropDuplicates(["key"])
    company = texts.select("entities", "text").mapInArrow(_company_rows, "entities array<string>, term string, context bigint")
    company = written(company, "privacy-company")
    joint = company.select(F.explode("entities").alias("entity"), "term", "context").groupBy("entity", "term").agg(F.count_distinct("context").alias("joint"))
    joint = written(joint.where(F.col("joint") >= contexts), "privacy-joint")
    here = company.groupBy("term").agg(F.count_distinct("context").alias("here"))
    limit = F.floor(F.max("joint") * F.lit(2.0**bits)).cast("bigint")
    candidates = joint.groupBy("term").agg(limit.alias("limit")).join(here, "term").where("here <= limit").select("term", "limit")
    candidates = written(candidates, "privacy-candidates")
    n, n_docs = candidates.count(), docs.count()
    if n == 0:
        return none
    enough = F.floor(F.max("rows") * F.lit(2.0**bits)).cast("bigint") + 1  # texts with a shape that hide an entity
    likely = joint.join(often, "entity").groupBy("term").agg(enough.alias("enough")).join(candidates, "term")
    shaped = written(likely.mapInArrow(_with_shape, "term string, enough bigint, limit bigint, shape string"), "privacy-shaped")
    shapes = {r["shape"]: r["enough"] for r in shaped.groupBy("shape").agg(F.max("enough").alias("enough")).collect()}
    limits = {r["term"]: r["limit"] for r in candidates.collect()} if n <= few else None
    found = written(keyed.select("text").mapInArrow(_context_rows(limits, shapes), "term string, context bigint, shape string, n bigint").distinct(), "privacy-contexts")
    terms = found.where("term is not null").select("term", "context")
    if limits is None:
        terms = join_hot(written(terms, "privacy-terms"), candidates, "term").select("term", "context")
    totals = terms.groupBy("term").agg(F.count_distinct("context").alias("total"), F.bool_or(F.col("context").isNull()).alias("over")).where("not over").drop("over")
    left = F.log2(F.col("total") / F.col("joint"))
    says = F.log2(F.lit(float(n_docs)) / F.col("rows")) - left
    known = joint.join(totals, "term").join(often, "entity").where((left <= bits) & (says >= gain)).select("term").distinct()
    counts = found.where("shape is not null").groupBy("shape").agg(F.sum("n").alias("n"))
    action = F.when(F.col("n") >= F.col("enough"), "generalise").otherwise("remove").alias("action")
    return written(shaped.join(known, "term", "left_semi").join(F.broadcast(counts), "shape").select("term", action), "privacy-revealing")


def _with_shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shapes = pa.array([shape(t) for t in b.column(0).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns, shapes], names=["term", "enough", "limit", "shape"])


def _spans_of(text: str, actions) -> list[Span]:
    base = base_spans(text)
    if not actions:
        return base
    return base + sorted((actions[t], a, b) for t, a, b in term_spans(text, base, actions))


def _protected(actions: dict[str, str] | None, with_text: bool):
    """From rows (doc_id, text, actions of its terms if actions is None): the spans and, if asked for, the sanitised text."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, 1, rows=256):
                own = (dict(x) if x else {} for x in part.column(2).to_pylist()) if actions is None else iter([actions] * len(part))
                spans, texts = [], []
                for text, known in zip(_text(part, 1), own, strict=True):
                    found = _spans_of(text, known)
                    spans.append([{"kind": k, "start": a, "end": z} for k, a, z in found])
                    if with_text:
                        texts.append(_sanitised(text, found))
                arrays = [part.column(0), pa.array(spans, pa.list_(span)), *([pa.array(texts, pa.string())] if with_text else [])]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "spans", *(["sanitised"] if with_text else [])])

    return run


def _sanitised(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            put = f"<{shape(name(text[a:b]))}>" if kind == "generalise" else "" if kind == "remove" else f"[{kind}]"
            out += [text[at:a], put]
        at = max(at, b)
    return "".join([*out, text[at:]])


def protected(docs: DataFrame, terms: DataFrame, with_text: bool = True, few: int = FEW) -> DataFrame:
    """(doc_id, spans, sanitised) for each row of docs (doc_id, text): spans are (kind, start, end) in code points, the patterns'
    by KINDS and start, then those of `terms` (term, action) by action and start, kind being the action. In the sanitised text
    a span of a pattern is named, a term is its shape or gone; of spans that overlap, the first stands.

    Null and empty texts have no spans; rows that repeat are treated alike; any doc_id and other columns are allowed."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>" + (", sanitised string" if with_text else "")
    if terms.count() <= few:
        actions = {r["term"]: r["action"] for r in terms.collect()}
        return rows.mapInArrow(_protected(actions, with_text), out)
    keyed = _keyed(docs)
    every = written(keyed.mapInArrow(_term_rows, "key string, term string").distinct(), "privacy-terms")
    own = join_hot(every, terms, "term").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions"))
    met = rows.withColumn("key", F.sha2("text", 256)).join(own, "key", "left")
    return met.select("doc_id", "text", "actions").mapInArrow(_protected(None, with_text), out)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), _text(b, 1), strict=True):
                for term in {t for t, _, _ in term_spans(text, base_spans(text))}:
                    yield key, term

    yield from _table(rows(), pa.schema([("key", pa.string()), ("term", pa.string())]))
