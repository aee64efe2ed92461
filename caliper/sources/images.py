"""Stored images as a data source: format("rasters").

A container holds encoded images one after the other and, at its end, an index of their ids, sizes and places. Tasks read byte
ranges: each takes the images that begin in its range, after the filters that were pushed down have been tested on the index,
and reads and decodes pixels only if the requested schema has them. A write becomes visible as a whole: parts are written under
a folder of their own and count only when the manifest, which is written last, names them. A commit clears what earlier jobs left,
such as parts of tasks that were killed while their job was undone; a folder has one writing job at a time.
"""

from __future__ import annotations

import json
import operator
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "image_id bigint, height int, width int, bands int, pixels binary"
#: Fixed values of the PNG format.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
BANDS_OF_COLOR_TYPE = {0: 1, 2: 3, 4: 2, 6: 4}
MANIFEST = "_manifest.json"
RANGE_BYTES = 64 << 20


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of pixels [height, width, bands], bands being 1 to 4; rows as differences to the row above."""
    h, w, bands = pixels.shape
    kind = {b: k for k, b in BANDS_OF_COLOR_TYPE.items()}[bands]
    rows = pixels.reshape(h, w * bands).astype(np.uint8)
    data = np.full((h, w * bands + 1), 2, np.uint8)
    data[:, 1:] = rows - np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data.tobytes())) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """[height, width, bands] of an 8-bit PNG without palette and interlace; ValueError for anything else."""
    if not data.startswith(PNG_SIGNATURE):
        raise ValueError("not a PNG")
    at, body, size = len(PNG_SIGNATURE), [], None
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(name + part)) != data[at + 8 + n : at + 12 + n]:
            raise ValueError(f"chunk {name!r} is damaged")
        if name == b"IHDR":
            w, h, depth, kind, *rest = struct.unpack(">IIBBBBB", part)
            if depth != 8 or kind not in BANDS_OF_COLOR_TYPE or any(rest):
                raise ValueError("only 8-bit images without palette and interlace")
            size = h, w, BANDS_OF_COLOR_TYPE[kind]
        elif name == b"IDAT":
            body.append(part)
        at += 12 + n
    if size is None:
        raise ValueError("no header")
    h, w, bands = size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, w * bands + 1)
    out = np.zeros((h + 1, w * bands), np.uint8)
    for y in range(h):
        out[y + 1] = _unfiltered(int(lines[y, 0]), lines[y, 1:], out[y], bands)
    return out[1:].reshape(h, w, bands)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, bands: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, bands), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"unknown row filter {kind}")
    out, up = [0] * len(line), above.tolist()
    for i, v in enumerate(line.tolist()):
        left, corner = (out[i - bands], up[i - bands]) if i >= bands else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            guess = min((left, up[i], corner), key=lambda x: abs(p - x))
        out[i] = (v + guess) & 255
    return np.array(out, np.uint8)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def committed(path: str) -> dict | None:
    """What the manifest of a folder says; None before a commit."""
    files, root = _open(path)
    at = f"{root}/{MANIFEST}"
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(at) as f:
        return json.loads(f.read())


def publish(path: str, manifest: dict) -> None:
    """Put the manifest in place by a rename: readers see the old state or the new one."""
    files, root = _open(path)
    part = f"{root}/_manifest-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as f:
        f.write(json.dumps(manifest).encode())
    files.move(part, f"{root}/{MANIFEST}")


@dataclass
class Written(WriterCommitMessage):
    file: str
    note: list


class CommittedWriter(DataSourceArrowWriter):
    """Writes parts that only a manifest makes visible. Subclasses write one part and say what the manifest has to know of it."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.options, self.schema = options["path"], dict(options), schema
        if not overwrite and committed(self.path) is not None:
            raise ValueError(f"{self.path} already exists")
        self.job = uuid.uuid4().hex

    def part(self, batches: Iterator[pa.RecordBatch], out) -> list:
        raise NotImplementedError

    def header(self) -> dict:
        return {}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _open(self.path)
        name = f"{self.job}/{uuid.uuid4().hex}"
        files.create_dir(f"{root}/{self.job}", recursive=True)
        with files.open_output_stream(f"{root}/{name}") as out:
            note = self.part(iterator, out)
        return Written(name, note)

    def commit(self, messages: Sequence) -> None:
        parts = [{"file": m.file, "note": m.note} for m in messages if m is not None]
        publish(self.path, self.header() | {"parts": parts})
        files, root = _open(self.path)
        for f in files.get_file_info(fs.FileSelector(root)):
            if f.type == fs.FileType.Directory and f.base_name != self.job:
                files.delete_dir(f.path)

    def abort(self, messages: Sequence) -> None:
        self._delete(self.job)

    def _delete(self, job: str) -> None:
        files, root = _open(self.path)
        if files.get_file_info(f"{root}/{job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{job}")


class _Writer(CommittedWriter):
    def part(self, batches, out) -> list:
        index, at = [], 0
        for b in batches:
            for image_id, h, w, bands, raw in zip(*(b.column(c).to_pylist() for c in ("image_id", "height", "width", "bands", "pixels")), strict=True):
                data = encode_png(np.frombuffer(raw, np.uint8).reshape(h, w, bands))
                out.write(data)
                index.append((image_id, h, w, bands, at, len(data)))
                at += len(data)
        columns = pa.table([pa.array([r[i] for r in index], pa.int64()) for i in range(6)], names=["image_id", "height", "width", "bands", "offset", "bytes"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, columns.schema) as s:
            s.write_table(columns)
        out.write(sink.getvalue())
        out.write(struct.pack("<q", at))
        return []


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.names
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            on_index = len(f.attribute) == 1 and f.attribute[0] in ("image_id", "height", "width", "bands") if hasattr(f, "attribute") else False
            if on_index and type(f) in _TESTS:
                self.filters.append((f.attribute[0], _TESTS[type(f)], f.value))
            elif on_index and isinstance(f, In):
                self.filters.append((f.attribute[0], lambda x, values: np.isin(x, list(values)), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        manifest = committed(self.path)
        if manifest is None:
            raise FileNotFoundError(f"no committed images in {self.path}")
        files, root = _open(self.path)
        out: list[InputPartition] = []
        for p in manifest["parts"]:
            size = files.get_file_info(f"{root}/{p['file']}").size
            out += [Range(p["file"], at, min(at + self.range_bytes, size)) for at in range(0, size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, root = _open(self.path)
        with files.open_input_file(f"{root}/{partition.file}") as f:
            size = f.size()
            (index_at,) = struct.unpack("<q", f.read_at(8, size - 8))
            index = pa.ipc.open_stream(f.read_at(size - 8 - index_at, index_at)).read_all()
            at = index["offset"].to_numpy()
            keep = (at >= partition.start) & (at < partition.end)
            for column, test, value in self.filters:
                keep &= test(index[column].to_numpy(), value)
            chosen = index.filter(pa.array(keep))
            for i in range(0, len(chosen), 64):
                some = chosen.slice(i, 64)
                yield pa.RecordBatch.from_arrays([self._column(c, some, f) for c in self.columns], names=self.columns)

    def _column(self, name: str, index: pa.Table, f) -> pa.Array:
        if name == "image_id":
            return index[name].combine_chunks()
        if name != "pixels":
            return index[name].combine_chunks().cast(pa.int32())
        places = zip(index["offset"].to_pylist(), index["bytes"].to_pylist(), strict=True)
        return pa.array([decode_png(f.read_at(n, at)).tobytes() for at, n in places], pa.binary())


class Rasters(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasters"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool):
        return _Writer(self.options, schema, overwrite)


def write_images(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Store df (image_id, height, width, bands, pixels): pixels are height * width * bands bytes, row after row. Nothing may be
    NULL. Fails if the folder holds images, unless they are to be replaced; they stay readable until the new ones are there."""
    df.sparkSession.dataSource.register(Rasters)
    rows = df.select("image_id", *[F.col(c).cast("int").alias(c) for c in ("height", "width", "bands")], "pixels")
    rows.write.format("rasters").mode("overwrite" if overwrite else "append").save(path)


def read_images(spark: SparkSession, path: str, columns: Sequence[str] = ("image_id", "height", "width", "bands", "pixels"), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The stored images with the given columns; without pixels only the indexes are read. Comparisons of ids and sizes with
    constants are tested on the index, before pixels are read."""
    spark.dataSource.register(Rasters)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wanted = StructType([f for f in StructType.fromDDL(SCHEMA).fields if f.name in columns])
    return spark.read.format("rasters").schema(wanted).option("rangeBytes", str(range_bytes)).load(path)
