"""Fitted models as files: format("models").

A model is named tensors and a configuration. Each part of it is a file of records, a line of JSON (name, shape) and the values
after it, 8 bytes each; the manifest holds the configuration and where each tensor stands. A model is there when its manifest
is: a write that fails leaves nothing, and one that replaces a model leaves the old one until the new one is complete.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from caliper.sources.images import CommittedWriter, _open, committed

SCHEMA = "name string, shape array<int>, values array<double>"


class _Writer(CommittedWriter):
    def header(self) -> dict:
        return {"config": json.loads(self.options.get("config", "{}"))}

    def part(self, batches: Iterator[pa.RecordBatch], out) -> list:
        note, at = [], 0
        for b in batches:
            for name, shape, values in zip(b.column("name").to_pylist(), b.column("shape").to_pylist(), b.column("values"), strict=True):
                data = values.values.to_numpy(zero_copy_only=False).astype("<f8").tobytes()
                if len(data) != 8 * prod(shape):
                    raise ValueError(f"tensor {name} has {len(data) // 8} values and the shape {shape}")
                line = json.dumps({"name": name, "shape": shape}).encode() + b"\n"
                out.write(line)
                out.write(data)
                note.append([name, shape, at + len(line), len(data)])
                at += len(line) + len(data)
        return note


@dataclass
class Tensor(InputPartition):
    file: str
    name: str
    shape: list
    offset: int
    bytes: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]

    def partitions(self) -> Sequence[InputPartition]:
        manifest = committed(self.path)
        if manifest is None:
            raise FileNotFoundError(f"no model in {self.path}")
        return [Tensor(p["file"], *n) for p in manifest["parts"] for n in p["note"]] or [Tensor("", "", [], 0, 0)]

    def read(self, partition: Tensor) -> Iterator[tuple]:
        if partition.file:
            files, root = _open(self.path)
            with files.open_input_file(f"{root}/{partition.file}") as f:
                yield partition.name, partition.shape, np.frombuffer(f.read_at(partition.bytes, partition.offset), "<f8").tolist()


class Models(DataSource):
    @classmethod
    def name(cls) -> str:
        return "models"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool):
        return _Writer(self.options, schema, overwrite)


def save_model(tensors: DataFrame, config: Mapping, path: str, overwrite: bool = False) -> None:
    """Store tensors (name, shape, values), each name once, with a configuration that JSON can hold. Fails if there is a model
    at the path, unless it is to be replaced."""
    tensors.sparkSession.dataSource.register(Models)
    mode = "overwrite" if overwrite else "append"
    tensors.select("name", "shape", "values").write.format("models").mode(mode).option("config", json.dumps(config)).save(path)


def tensor_table(spark: SparkSession, tensors: Mapping[str, np.ndarray]) -> DataFrame:
    """Tensors of the driver, as a fit leaves them, as a table for save_model."""
    return spark.createDataFrame([(k, list(v.shape), v.astype(float).reshape(-1).tolist()) for k, v in tensors.items()], SCHEMA)


def load_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(name, shape, values) of a stored model."""
    spark.dataSource.register(Models)
    return spark.read.format("models").load(path)


def load_model(spark: SparkSession, path: str) -> tuple[dict, dict[str, np.ndarray]]:
    """The configuration and the tensors of a stored model that fits into the driver."""
    manifest = committed(path)
    if manifest is None:
        raise FileNotFoundError(f"no model in {path}")
    return manifest["config"], {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in load_tensors(spark, path).collect()}
