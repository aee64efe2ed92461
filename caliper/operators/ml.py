"""Clusters, projections and model inference on feature columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from caliper.functions.stats import seeded_order
from caliper.sources.scratch import drop, written

#: Features are taken as integers, in units of 1 / UNITS, so that sums and distances are the same on every cluster.
UNITS = 4096
#: Rows of a block of Lloyd's steps.
BLOCK = 2048


@dataclass
class KMeansModel:
    """centers [k, width] in units of 1 / UNITS, and the summed squared distance of the rows it was fitted on, in their square."""

    centers: np.ndarray
    cost: int
    costs: list[int]


def _units(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * UNITS)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            b = batch.slice(at, BLOCK)
            yield b, _units(b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1))


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances in doubles, exact below 2^53."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(axis=1)


def _lloyd_sums(restarts: np.ndarray):
    """One row a task: for each restart its clusters' sums and counts and the cost, one after the other."""
    n, k, width = restarts.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, cost = np.zeros((n, k, width)), np.zeros((n, k)), np.zeros(n)
        for _, x in _blocks(batches, 0):
            for r in range(n):
                d = _distances(x, restarts[r])
                own = d.argmin(axis=1)
                np.add.at(sums[r], own, x)
                counts[r] += np.bincount(own, minlength=k)
                cost[r] += d[np.arange(len(x)), own].sum()
        flat = np.concatenate([sums.reshape(-1), counts.reshape(-1), cost]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.int64()))], names=["sums"])

    return run


def _nearest(centers: np.ndarray, names: list[str]):
    """From rows whose last column is the features: the other columns and the nearest center."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches, -1):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_distances(x, centers).argmin(axis=1), pa.int32())], names=names)

    return run


def fit_kmeans(df: DataFrame, features: str, k: int, key: Column, seed: int = 42, n_init: int = 5, steps: int = 20) -> KMeansModel:
    """The cheapest of n_init fits of Lloyd's algorithm, the first of several.

    Restart r begins with the k rows that come first in a seeded order of `key` (unique), seed + r; fewer rows, fewer centers. All
    restarts go together: a step is one scan in which each task adds up its blocks for all of them, and the sums are added up
    by Spark before k x width x n_init numbers come to the driver. A center is the floor of its rows' mean and stays if it has
    none. Fits end after `steps` steps or when no center moves. Rows are lists of one length without NULL; below 2^25 in absolute
    value by UNITS. The costs are those of the final centers."""
    rows = df.select(F.col(features).cast("array<double>").alias("x"), key.alias("__key"))
    starts = [[r["x"] for r in rows.orderBy(seeded_order(F.col("__key"), seed + i), "__key").limit(k).collect()] for i in range(n_init)]
    if not starts[0]:
        raise ValueError("no rows to fit on")
    restarts = _units(np.array(starts))
    n, k, width = restarts.shape
    x = written(rows.select("x"), "kmeans-rows")
    for step in range(steps + 1):
        sums = x.mapInArrow(_lloyd_sums(restarts), "sums array<bigint>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(n * (k * width + k + 1), np.int64)
        flat[sums["at"].to_numpy()] = sums["v"].to_numpy()
        total, count, cost = np.split(flat, [n * k * width, n * k * (width + 1)])
        count = count.reshape(n, k, 1)
        means = np.floor_divide(total.reshape(n, k, width), np.maximum(count, 1))
        after = np.where(count > 0, means, restarts).astype(float)
        if step == steps or (after == restarts).all():
            break
        restarts = after
    drop(x)
    best = int(cost.argmin())
    return KMeansModel(restarts[best], int(cost[best]), cost.tolist())


def with_nearest_center(df: DataFrame, features: str, centers: np.ndarray, name: str = "cluster") -> DataFrame:
    """df with the index of each row's nearest center (in units of 1 / UNITS), the lowest of several."""
    schema = StructType([*df.schema.fields, StructField(name, IntegerType())])
    return df.select("*", F.col(features).cast("array<double>").alias("__x")).mapInArrow(_nearest(centers, schema.names), schema)


def kmeans_labels(df: DataFrame, features: str, k: int, key: Column, seed: int = 42, n_init: int = 5, steps: int = 20, name: str = "cluster") -> DataFrame:
    """df with the cluster of each row under fit_kmeans. Labels are not comparable between libraries."""
    return with_nearest_center(df, features, fit_kmeans(df, features, k, key, seed, n_init, steps).centers, name)


def _vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))


@dataclass
class Projection:
    """Two principal components [width, 2] of centered features, and the mean [width]."""

    components: np.ndarray
    mean: np.ndarray


def fit_pca_2d(df: DataFrame, features: str) -> Projection:
    """Each component's sign is such that its entry of largest size, the first of several, is positive."""
    ready = _vectors(df, features)
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(ready)
    model: PCAModel = PCA(k=2, inputCol="__c", outputCol="__p").fit(scaler.transform(ready))
    pc = model.pc.toArray()
    return Projection(pc * np.sign(pc[np.abs(pc).round(9).argmax(axis=0), range(2)]), scaler.mean.toArray())


def projected(df: DataFrame, features: str, onto: Projection, names: tuple[str, str] = ("pc1", "pc2")) -> DataFrame:
    """df with the two coordinates of its centered features, by column expressions."""
    centered = F.zip_with(F.col(features).cast("array<double>"), F.array(*map(F.lit, onto.mean.tolist())), lambda a, b: a - b)
    dot = lambda i: F.aggregate(F.zip_with("__c", F.array(*map(F.lit, onto.components[:, i].tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("__c", centered).withColumns({n: dot(i) for i, n in enumerate(names)}).drop("__c")


def pca_2d(df: DataFrame, features: str, names: tuple[str, str] = ("pc1", "pc2")) -> DataFrame:
    """df with the first two principal components of the centered features, with the signs of fit_pca_2d."""
    return projected(df, features, fit_pca_2d(df, features), names)


def shared_pca(labeled: DataFrame, unlabeled: DataFrame, features: str) -> DataFrame:
    """Both tables in one projection, tagged by `origin`."""
    both = labeled.withColumn("origin", F.lit("labeled")).unionByName(unlabeled.withColumn("origin", F.lit("unlabeled")))
    return pca_2d(both, features)


def predict_batches(df: DataFrame, predictor: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """The predictor's rows for each Arrow batch of df; nothing passes the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield predictor(f)

    return df.mapInPandas(run, schema)


def peak_predictor(f: pd.DataFrame) -> pd.DataFrame:
    """A predictor without weights for tests and examples: position and value of the largest of `embedding`."""
    v = [np.asarray(x, dtype=float) for x in f["embedding"]]
    return pd.DataFrame({"vec_id": f["vec_id"], "at": [int(x.argmax()) for x in v], "most": [float(x.max()) for x in v]})
