"""Language identification by interpolated Kneser-Ney character models, kept in sorted hash arrays.

One model holds all languages: the 64-bit hashes of every character n-gram seen in training, sorted, beside a row for each
with the log probability and the log back-off weight under each language. A text's n-grams are looked up through an index
of the hashes' leading bits, once for all languages. The language with the lowest cross-entropy per character wins; a text
whose cross-entropy lies above what calibration texts of that language and length show is rejected.

Counting runs on Spark over the training rows; only the finished counts, bounded by the sample, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.llm.shingles import mix

ORDER = 4
#: Different training texts of a language, and as many again for calibration: the bound of the model's sample.
DOCS_PER_LANGUAGE = 1500
#: A text is rejected if it lies this many standard deviations above the expected cross-entropy, and this many times as
#: far above it as nearly all calibration texts of its language: the quantile of those whose own label wins, less rows
#: beyond the outer fence (quartiles of their logarithms), which junk under any label would be.
REJECT_Z, REJECT_MARGIN, REJECT_QUANTILE, FENCE = 8.0, 1.25, 0.999, 5.5
#: Calibration texts from which a language has figures of its own; with fewer it takes those of all languages together.
LEAST_TEXTS = 8
#: Rows of the table of languages that is broadcast at most.
MANY_LANGUAGES = 10_000
_BLOCK = 1 << 17
_letters: np.ndarray | None = None


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, every run of other characters as one 0, a 0 at either end; no letters: empty."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters[c], c, 0)
    if not c.any():
        return np.empty(0, np.uint32)
    c = np.r_[np.uint32(0), c, np.uint32(0)]
    return c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]


def gram_hashes(codes: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each position; the first n-1 positions of order n are absent."""
    x = codes.astype(np.uint64)
    out = [mix(x + np.uint64(0x1234567))]
    for _ in range(1, order):
        out.append(mix(out[-1][:-1] * np.uint64(0xD6E8FEB86659FD93) + x[len(x) - len(out[-1]) + 1 :]))
    return out


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for t, lang in zip(b.column(0), b.column(1), strict=True):
                by_lang.setdefault(lang.as_py(), []).append(letter_codes(t.as_py()))
            for lang, docs in by_lang.items():
                grams = [gram_hashes(d, order) for d in docs if len(d) >= order]
                for n in range(1, order + 1) if grams else ():
                    h = np.concatenate([g[n - 1] for g in grams])
                    ctx = np.concatenate([g[n - 2][:-1] for g in grams]) if n > 1 else np.zeros(len(h), np.uint64)
                    low = np.concatenate([g[n - 2][1:] for g in grams]) if n > 1 else np.zeros(len(h), np.uint64)
                    h, first, count = np.unique(h, return_index=True, return_counts=True)
                    k = len(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * k), pa.array([n] * k, pa.int32()), *(pa.array(a.view(np.int64)) for a in (h, ctx[first], low[first])), pa.array(count, pa.int64())],
                        names=["lang", "n", "h", "ctx", "low", "c"],
                    )

    return run


@dataclass
class Model:
    langs: list[str]
    order: int
    keys: np.ndarray  #: sorted uint64
    logp: np.ndarray  #: float32 [keys + 1, langs], NaN where the language has not seen the gram; the last row is for absent keys
    back: np.ndarray  #: float32 [keys + 1, langs], log weight that the gram, as a context, gives to the lower order
    floor: np.ndarray  #: float32 [langs], log probability of a character never seen
    mean: np.ndarray | None = None  #: cross-entropy of calibration texts
    spread: np.ndarray | None = None  #: its variance between documents, and per character
    per_char: np.ndarray | None = None
    limit_z: np.ndarray | None = None  #: standard deviations from which a text is rejected
    temper: float = 1.0

    def index(self) -> None:
        bits = min(24, max(8, len(self.keys).bit_length() + 2))  # a quarter of the places hold a key
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange(2**bits + 1, dtype=np.uint64)).astype(np.int32)
        self.run = int(np.diff(self.first).max()) if len(self.keys) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash; the last row if it is absent."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        prefix = (h >> self.shift).astype(np.int64)
        at, end = self.first[prefix], self.first[prefix + 1]
        out = np.where((at < end) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h), at, len(self.keys))
        rest = np.flatnonzero((out == len(self.keys)) & (end - at > 1))
        for step in range(1, self.run):
            if not len(rest):
                break
            p = at[rest] + step
            hit = (p < end[rest]) & (self.keys[np.minimum(p, len(self.keys) - 1)] == h[rest])
            out[rest[hit]] = p[hit]
            rest = rest[~hit & (p + 1 < end[rest])]
        return out

    def score(self, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """Sum of log probabilities under each language, and the number of characters predicted."""
        total = np.zeros(len(self.langs))
        n = max(0, len(codes) - 1)
        for at in range(1, len(codes), _BLOCK):
            lead = min(at, self.order - 1)
            total += self._block(codes[at - lead : at + _BLOCK], lead)
        return total, n

    def _block(self, codes: np.ndarray, lead: int) -> np.ndarray:
        grams = gram_hashes(codes, self.order)
        rows = self.find(grams[0])
        p = self.logp[rows]
        p = np.where(np.isnan(p), self.floor, p)
        for h in grams[1:]:
            if not len(h):
                break
            here = self.find(h)
            own = self.logp[here]
            lower = p[len(p) - len(h) :] + self.back[rows[:-1]]
            p = np.concatenate([p[: len(p) - len(h)], np.where(np.isnan(own), lower, own)])
            rows = here
        return p[lead:].sum(axis=0, dtype=np.float64)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score in 0..1, rejected); a text without letters is 'und', 0 and rejected."""
        codes = letter_codes(text) if text else np.empty(0, np.uint32)
        if not len(codes) or not self.langs:
            return "und", 0.0, True
        total, n = self.score(codes)
        h = -total / n
        best = int(np.argmin(h))
        gap = (h[best] - h) * n**0.5 * self.temper
        score = float(1.0 / np.exp(gap).sum())
        limit = self.mean[best] + self.limit_z[best] * np.sqrt(self.spread[best] + self.per_char[best] / n) if self.mean is not None else np.inf
        return self.langs[best], score, bool(h[best] > limit)


def _kneser_ney(counts, order: int) -> Model:
    """counts: pandas (lang, n, h, ctx, low, c), summed over all training rows."""
    import pandas as pd

    langs = sorted(counts["lang"].unique())
    keys = np.unique(counts["h"].to_numpy().view(np.uint64))
    logp = np.full((len(keys) + 1, len(langs)), np.nan, np.float32)
    back = np.zeros((len(keys) + 1, len(langs)), np.float32)
    floor = np.zeros(len(langs), np.float32)
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        lower: pd.Series | None = None
        for n in range(1, order + 1):
            g = own[own["n"] == n].set_index("h")
            if n < order:  # below the top a gram counts once for each character that stands before it
                longer = own[own["n"] == n + 1]
                k = longer.groupby("low").size().reindex(g.index).fillna(0)
                g = g.assign(c=k.where(k > 0, 1))
            d = (g["c"] == 1).sum() / max(1, (g["c"] == 1).sum() + 2 * (g["c"] == 2).sum())
            d = min(max(d, 0.1), 0.9)
            if n == 1:
                vocabulary = len(g) + 1
                total = g["c"].sum()
                left = d * len(g) / total
                p = (g["c"] - d) / total + left / vocabulary
                floor[i] = np.log(left / vocabulary)
            else:
                total = g.groupby("ctx")["c"].transform("sum")
                kinds = g.groupby("ctx")["c"].transform("size")
                weight = d * kinds / total
                p = (g["c"] - d) / total + weight * lower.reindex(g["low"]).to_numpy()
                at = np.searchsorted(keys, g["ctx"].to_numpy().view(np.uint64))
                back[at, i] = np.log(weight.to_numpy())
            logp[np.searchsorted(keys, g.index.to_numpy().view(np.uint64)), i] = np.log(p.to_numpy())
            lower = p
    return Model(langs, order, keys, logp, back, floor)


def _bounded(rows: DataFrame, per_lang: int, salt: int) -> DataFrame:
    """About per_lang different texts of each language, chosen by a hash of the text: whole texts, each once, all of a rare
    language. Only chosen texts are shuffled, copies combined before."""
    n = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n"))
    share = F.lit(float(per_lang)) / F.col("n")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "text"), 11).cast("double") / F.lit(float(2**53))
    few = n.limit(MANY_LANGUAGES + 1).count() <= MANY_LANGUAGES
    return rows.join(F.broadcast(n) if few else n, "lang").where(draw < share).groupBy("text", "lang").agg(F.count(F.lit(1)).alias("copies")).select("text", "lang")


def fit(train: DataFrame, calibrate: DataFrame, order: int = ORDER, per_lang: int = DOCS_PER_LANGUAGE) -> Model:
    """A model from (text, lang) rows; rows with a null in either are left out. No rows: a model that knows no language."""
    usable = lambda df: df.select("text", "lang").where("text is not null and lang is not null")
    grams = _bounded(usable(train), per_lang, 1).mapInArrow(_count_grams(order), "lang string, n int, h long, ctx long, low long, c long")
    counts = grams.groupBy("lang", "n", "h", "ctx", "low").agg(F.sum("c").alias("c")).toPandas()
    model = _kneser_ney(counts, order)
    model.index()
    seen = _bounded(usable(calibrate), per_lang, 2).mapInArrow(_entropies(model), "lang string, n long, h array<double>").toPandas()
    _calibrate(model, seen)
    return model


def _entropies(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, lang in zip(b.column(0), b.column(1), strict=True):
                codes = letter_codes(t.as_py())
                if len(codes) and model.langs:
                    total, n = model.score(codes)
                    rows.append((lang.as_py(), n, list(-total / n)))
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "n", "h"), r, strict=True)) for r in rows], schema=pa.schema([("lang", pa.string()), ("n", pa.int64()), ("h", pa.list_(pa.float64()))]))

    return run


def _figures(own: np.ndarray, length: np.ndarray) -> tuple[float, float, float, float]:
    """Mean, its variance between documents and per character, and the limit, from cross-entropies and lengths."""
    long = length >= np.median(length)
    mean = np.median(own[long])
    off = own - mean
    spread = (1.4826 * np.median(np.abs(off[long]))) ** 2
    short = ~long if (~long).any() else long
    per_char = max(1.0, np.median(off[short] ** 2 * length[short]) / 0.455)
    z = off / np.sqrt(spread + per_char / length)
    size = np.log1p(np.abs(z))
    low, high = np.quantile(size, [0.25, 0.75])
    inner = z[size <= high + FENCE * max(high - low, 0.1)]
    return mean, spread, per_char, max(REJECT_Z, REJECT_MARGIN * np.quantile(inner, REJECT_QUANTILE))


def _calibrate(model: Model, seen) -> None:
    """Mean and spread of each language's own cross-entropy, robust to mislabelled rows, and the score's temperature."""
    k = len(model.langs)
    model.limit_z = np.full(k, REJECT_Z)
    model.mean, model.spread, model.per_char = np.full(k, np.inf), np.zeros(k), np.zeros(k)
    if not len(seen):
        return
    h, n = np.array(seen["h"].tolist()), seen["n"].to_numpy().astype(float)
    truth = seen["lang"].map({x: i for i, x in enumerate(model.langs)}).fillna(-1).to_numpy().astype(int)
    best = h.argmin(axis=1)
    won = truth == best  # a row that another language fits better is mislabelled, or junk
    figures = []
    for i in range(k):
        if (won & (truth == i)).sum() >= LEAST_TEXTS:
            model.mean[i], model.spread[i], model.per_char[i], model.limit_z[i] = _figures(h[won & (truth == i), i], n[won & (truth == i)])
            figures.append(i)
    few = [i for i in range(k) if i not in figures]
    pool = won if won.sum() >= LEAST_TEXTS else truth >= 0
    if few and pool.any():
        pooled = _figures(h[pool, truth[pool]], n[pool])
        for i in few:
            model.mean[i], model.spread[i], model.per_char[i], model.limit_z[i] = pooled
    known = truth >= 0
    if known.any() and k > 1:
        gap = (h[known].min(axis=1, keepdims=True) - h[known]) * np.sqrt(n[known])[:, None]
        wide = np.array([0.5, 1, 2, 4, 8, 16, 32])
        loss = [-np.mean((t * gap[np.arange(known.sum()), truth[known]]) - np.log(np.exp(t * gap).sum(axis=1))) for t in wide]
        model.temper = float(wide[int(np.argmin(loss))])


def _shared(df: DataFrame, model: Model):
    return df.sparkSession.sparkContext.broadcast({k: getattr(model, k) for k in Model.__dataclass_fields__})


_loaded: dict[int, Model] = {}


def _load(shared) -> Model:
    """One model a Python worker."""
    if shared not in _loaded:
        m = Model(**shared.value)
        m.index()
        _loaded.clear()
        _loaded[shared] = m
    return _loaded[shared]


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of docs (doc_id, text), whole texts, no shuffle. Null texts and those
    without a letter are 'und', score 0, rejected; repeated rows are predicted alike; other columns are ignored; no rows give
    no rows."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(shared)
        for b in batches:
            out = [m.predict(t.as_py()) for t in b.column(1)]
            lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, all columns as they were, no shuffle. Null texts and those without a
    letter are rejected; repeated rows go or stay together; no rows give no rows."""
    shared = _shared(docs, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(shared)
        for b in batches:
            yield b.filter(pa.array([not m.predict(t.as_py())[2] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit_on_folds(docs: DataFrame) -> Model:
    """Learns from fold 0, calibrates on fold 2; fold 1 is held out."""
    labelled = docs.where("lang is not null and text is not null").select("text", "lang", fold(F.col("doc_id")).alias("fold"))
    return fit(labelled.where("fold = 0"), labelled.where("fold = 2"))
