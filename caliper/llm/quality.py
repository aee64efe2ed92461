"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade <= g) = sigmoid(threshold[g] - w . x) with one weight vector w for all grades and increasing thresholds. x holds
hashed words, heads of words, word shapes and the repeated words of the whole text, the square root of their share each, so
that x has the same length for texts of any length. The fit uses a bounded sample of rated rows; every document is scored.

What parts the grades above the first (toxic words) says nothing of the first (junk), so that one w for both finds few toxic
texts. fit() adds, for each grade g from 2, a link with weights of its own on the rows of grade g - 1 or more, and
P(grade >= g) = P(grade >= g - 1) P(grade >= g | grade >= g - 1). The limit of the last factor comes from rows left out of the
fit. Only these links use the heads of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.shingles import head_hashes, mix
from caliper.sources.scratch import drop, written

BITS = 18
#: Bytes of a word's heads, which words of one stem share.
HEADS = (5, 7)
#: Ratings that the fit may use, and different rated texts; repeated ones are a weight.
MAX_RATED = 4000
#: A document stays if P(grade >= 1), grade 0 being low quality, is this or more.
KEEP_AT = 0.5
#: Share of the rows of grade g or more, left out of the fit, that may lie below the limit of P(grade >= g | grade >= g - 1),
#: g from 2; with fewer such rows, or fewer below, than LEAST_RATED there is no limit. Parts that are left out in turn.
LOST, LEAST_RATED, FOLDS = 0.002, 30, 3
#: Where the places of shapes and of heads begin; words come before.
_SHAPES, _HEADS = 2 ** (BITS - 1), 3 * 2 ** (BITS - 2)
_BLOCK = 1 << 20
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b <= 32 else b for b in range(256))


def _blocks(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        to = len(data) if len(data) - at <= _BLOCK else data.find(b" ", at + _BLOCK)
        to = len(data) if to < 0 else to
        yield data[at:to]
        at = to


def _shares(hashes: np.ndarray, start: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique((hashes >> np.uint64(32)).astype(np.int64) * places >> 32, return_counts=True)
    return (at + start).astype(np.int32), np.sqrt(count / max(1, len(hashes))).astype(np.float32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; words have half of the places, shapes and heads a quarter each; the last place is for the words that
    repeat the one before. Null is the empty text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, shapes = [], []
    for b in _blocks(data.translate(_WORD)):
        words.append(head_hashes(b, (0, *HEADS)))
    for b in _blocks(data.translate(_SHAPE)):
        a = np.frombuffer(b, np.uint8)
        shapes.append(mix(head_hashes(a[np.r_[True, a[1:] != a[:-1]]].tobytes(), (0,))[0]))
    none = np.empty(0, np.uint64)
    word, *heads = (np.concatenate([none, *(w[i] for w in words)]) for i in range(1 + len(HEADS)))
    shape = np.concatenate([none, *shapes])
    repeats = np.sqrt((word[1:] == word[:-1]).sum() / max(1, len(word)))
    last = (np.array([2**BITS - 1], np.int32), np.array([repeats], np.float32))
    parts = [_shares(word, 0, _SHAPES), _shares(shape, _SHAPES, _HEADS - _SHAPES), *(_shares(h, _HEADS, 2**BITS - 1 - _HEADS) for h in heads), last]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  #: one fewer than grades
    upper: list[Ordinal] = field(default_factory=list)  #: two grades each: P(grade >= g | grade >= g - 1) for g from 2
    limits: list[float] = field(default_factory=list)  #: least P(grade >= g | grade >= g - 1) of a kept text, g from 2

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return self.tails_of(*features(text))

    def tails_of(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = _sigmoid(float(self.weights[at] @ value) - self.thresholds)
        for g, link in enumerate(self.upper, 1):
            out[g] = out[g - 1] * link.tails_of(at, value)[0]
        return out

    def keeps(self, tails: np.ndarray, grade: int = 1, keep_at: float = KEEP_AT) -> bool:
        return bool(tails[grade - 1] >= keep_at and all(t >= x * before for t, before, x in zip(tails[1:], tails, self.limits, strict=False)))


def cut_points(theta: np.ndarray) -> np.ndarray:
    """Increasing thresholds from the lowest one and the logarithms of the gaps."""
    return np.r_[theta[0], theta[0] + np.cumsum(np.exp(theta[1:]))]


def loss_and_slopes(z: np.ndarray, theta: np.ndarray, grades: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log likelihood of the grades at scores z, and its derivatives by z and by theta (cut_points)."""
    cut = cut_points(theta)
    below = _sigmoid(np.c_[np.full(len(z), -1e3), cut[None, :] - z[:, None], np.full(len(z), 1e3)])
    i = np.arange(len(z))
    hi, lo = below[i, grades + 1], below[i, grades]
    p = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = share * hi * (1 - hi) / p, share * lo * (1 - lo) / p
    by_cut = np.array([(d_lo * (grades == g + 1) - d_hi * (grades == g)).sum() for g in range(len(cut))])
    by_theta = np.r_[by_cut.sum(), [by_cut[j:].sum() * np.exp(theta[j]) for j in range(1, len(cut))]]
    return float(-(share * np.log(p)).sum()), d_hi - d_lo, by_theta


def fit_arrays(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, l2: float = 3e-5, steps: int = 250, weight: np.ndarray | None = None) -> Ordinal:
    """Full-batch Adam on the mean negative log likelihood. A grade without rows keeps its threshold near its neighbour.
    weight: how often each row stands, once by default."""
    k = n_grades - 1
    w = np.zeros(2**BITS)
    if not rows:
        return Ordinal(w.astype(np.float32), np.arange(k, dtype=float))
    share = np.full(len(rows), 1 / len(rows)) if weight is None else weight / weight.sum()
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    size = np.array([len(r[0]) for r in rows])
    first = np.cumsum(size) - size  # of each row; no row is empty
    count = np.bincount(at, minlength=2**BITS)
    used = np.flatnonzero(count)
    number = np.zeros(2**BITS, np.int32)
    number[used] = np.arange(len(used))
    at = number[at]
    by_feature = np.argsort(at, kind="stable").astype(np.int32)
    row, turned = np.repeat(np.arange(len(rows), dtype=np.int32), size)[by_feature], value[by_feature]
    first_of = np.cumsum(count[used]) - count[used]
    del by_feature
    theta = np.zeros(len(used) + k)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        u = theta[: len(used)].astype(np.float32)
        z = np.add.reduceat(u[at] * value, first).astype(float)
        _, by_z, by_theta = loss_and_slopes(z, theta[len(used) :], grades, share)
        g = np.r_[np.add.reduceat(turned * by_z.astype(np.float32)[row], first_of) + l2 * u, by_theta]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w[used] = theta[: len(used)]
    return Ordinal(w.astype(np.float32), cut_points(theta[len(used) :]))


#: A row's models, by number: 0 is that of all grades, the others are the links' and, for each, those without one of the FOLDS parts.
def _models(n_grades: int) -> list[tuple[int, int]]:
    """(grade g of the link, or 0; part left out, or -1) of each model."""
    return [(0, -1)] + [(g, h) for g in range(2, n_grades) for h in range(-1, FOLDS)]


def _fit_model(n_grades: int):
    """From the rows (model, at, value, grade, n, part) of one model: its weights and thresholds, and of the rows of the part that
    was left out, with the better grade, the probability of that grade."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        number = int(f["model"].iloc[0])
        g, h = _models(n_grades)[number]
        f = f.sort_values(["at", "value", "grade", "n"], kind="stable")  # reruns agree
        rows = [(np.frombuffer(x, np.int32), np.frombuffer(v, np.float32)) for x, v in zip(f["at"], f["value"], strict=True)]
        grades, weight, out = f["grade"].to_numpy().astype(int), f["n"].to_numpy().astype(float), (f["part"] == h).to_numpy()
        if g:
            grades, k = (grades >= g).astype(int), 2
        else:
            rows, k = [(x[keep], v[keep]) for x, v in rows for keep in [(x < _HEADS) | (x == 2**BITS - 1)]], n_grades
        own = np.flatnonzero(~out)
        model = fit_arrays([rows[i] for i in own], grades[own], k, weight=weight[own])
        left = [float(model.tails_of(*rows[i])[0]) for i in np.flatnonzero(out & (grades == 1))]
        return pd.DataFrame({"model": [number], "weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tolist()], "left": [left]})

    return run


def fit_calibrated(rated: DataFrame, n_grades: int) -> Ordinal:
    """A model of the rows (at, value, grade, n) of rated_features. The limit of a link comes from what each of FOLDS parts of its
    rows gets under a link fitted on the others; equal texts share a part. Each model is one task's work on the bounded
    sample; weights and thresholds come to the driver."""
    rated = written(rated, "rated-features")
    count = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    if not count:
        return fit_arrays([], np.empty(0, int), n_grades)
    last = 1
    while last < n_grades - 1 and min(sum(count.get(x, 0) for x in range(last + 1, n_grades)), count.get(last, 0)) >= LEAST_RATED:
        last += 1
    models = [(i, g) for i, (g, _) in enumerate(_models(n_grades)) if g <= last]
    taken = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("model"), F.lit(g).alias("g")) for i, g in models]), lambda m: (m["g"] == 0) | (F.col("grade") >= m["g"] - 1)))
    part = (F.crc32(F.concat("at", "value")) % FOLDS).cast("int").alias("part")
    rows = rated.select(taken.alias("m"), "at", "value", "grade", "n", part).select("m.model", "at", "value", "grade", "n", "part")
    fits = rows.repartitionByRange(len(models), "model").groupBy("model").applyInPandas(_fit_model(n_grades), "model int, weights binary, thresholds array<double>, left array<double>").toArrow()
    drop(rated)
    by = {number: (Ordinal(np.frombuffer(w, np.float32), np.array(t)), left) for number, w, t, left in zip(*(fits[c].to_pylist() for c in ("model", "weights", "thresholds", "left")), strict=True)}
    out = by[0][0]
    for i, (g, h) in enumerate(_models(n_grades)):
        if 2 <= g <= last and h < 0:
            out.upper.append(by[i][0])
            out.limits.append(float(np.quantile(np.concatenate([by[i + 1 + x][1] for x in range(FOLDS)]), LOST)))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [features(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes() for x, _ in got], pa.binary()), pa.array([y.tobytes() for _, y in got], pa.binary()), b.column(1), b.column(2)], names=["at", "value", "grade", "n"])


def rated_features(docs: DataFrame, ratings: DataFrame, n_grades: int, max_rated: int = MAX_RATED) -> DataFrame:
    """(at, value, grade, n): at most max_rated rated texts as features, chosen by a hash, and how often each stands so."""
    usable = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).where(F.col("grade").between(0, n_grades - 1) & F.col("doc_id").isNotNull())
    counted = usable.groupBy("doc_id", "grade").agg(F.count(F.lit(1)).alias("n"))
    chosen = counted.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rated)
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text", "grade").agg(F.sum("n").alias("n"))
    found = rated.mapInArrow(_extract, "at binary, value binary, grade int, n long")
    return found.orderBy(F.xxhash64("at", "value"), "grade", "n").limit(max_rated)


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, max_rated: int = MAX_RATED) -> Ordinal:
    """docs (doc_id, text), ratings (doc_id, grade int from 0). At most max_rated different ratings, chosen by a hash of the
    id, and as many different texts are used, as features; ratings with a null in either column or of another grade
    are left out, repeated ratings and repeated texts count as often as they stand. A rated null text is the empty one. No
    ratings: a model that gives every text the same tails."""
    return fit_calibrated(rated_features(docs, ratings, n_grades, max_rated), n_grades)


def scored(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, expected_grade, tails, kept) for each row of docs (doc_id, text); null and empty texts have the score of an
    empty text, repeated rows are scored each and alike, no rows give no rows; kept is what selected() decides. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = [shared.value.tails(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([t.tolist() for t in tails], pa.list_(pa.float64())), pa.array([shared.value.keeps(t) for t in tails], pa.bool_())], names=["doc_id", "expected_grade", "tails", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tails array<double>, kept boolean")


def selected(docs: DataFrame, model: Ordinal, grade: int = 1, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs with P(grade or better) >= keep_at and the model's limits of the other tails, all columns as they
    were. Null and empty texts are judged as the empty text, repeated rows alike; no rows give no rows. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.keeps(shared.value.tails(t.as_py()), grade, keep_at) for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels (doc_id, quality, toxic): 0 low quality, 1 good but toxic, 2 good. A null quality has no
    grade, a null toxic counts as not toxic."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))
