"""Audio columns: 8-bit PCM clips, resampled by a polyphase filter, as overlapped log-mel filterbank tensors of fixed shape
with time spans, and segmented by energy with hysteresis.

A clip is a mono WAV file in a binary column. Features are an Arrow stream of rows (tensor fixed_shape_tensor<float>
[FRAMES, MELS], start_s, end_s, frames), the last tensor padded with zeros behind its `frames`. Clips are worked through
in blocks, so that memory does not grow with their length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.blocks import blocks

SOURCE_RATE, RATE = 12_000, 8_000
WIN, HOP, N_FFT, MELS, FRAMES = 200, 80, 256, 32, 64
#: Energies, in dB above the clip's quietest tenth, at which a segment begins and below which it ends.
BEGIN_DB, END_DB = 6.0, 3.0
UNIT = 192
_TAPS = 16
_BLOCK = 1 << 12


def wav(payload: bytes, rate: int = SOURCE_RATE) -> bytes:
    """A mono 8-bit PCM WAV file whose samples are the payload's bytes."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def samples(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) read from a file made by wav(), or any 8-bit mono PCM WAV."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _phases(up: int, down: int) -> np.ndarray:
    """[up, _TAPS] phases of a windowed-sinc low pass at the lower of both rates."""
    n = _TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n) * up
    return np.ascontiguousarray(h.reshape(_TAPS, up).T.astype(np.float32))


_PHASES: dict[tuple[int, int], np.ndarray] = {}


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up/down times its rate: output m is phase (m*down) % up of the filter at input (m*down) // up."""
    if (up, down) not in _PHASES:
        _PHASES[up, down] = _phases(up, down)
    h = _PHASES[up, down]
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(_TAPS - 1, np.float32), x, np.zeros(down, np.float32)]), _TAPS)
    for r in range(min(up, n)):
        k = len(out[r::up])
        out[r::up] = windows[r * down // up :: down][:k] @ h[(r * down) % up][::-1]
    return out


def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, RATE / 2, N_FFT // 2 + 1)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_BANK, _WINDOW = _mel_bank(), np.hanning(WIN).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([frames, MELS] log-mel energies, [frames] energy in dB) of overlapped windows; at least one frame."""
    n = 1 + max(0, -(-(len(y) - WIN) // HOP))
    y = np.concatenate([y, np.zeros((n - 1) * HOP + WIN - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, WIN)[::HOP]
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, _BLOCK):
        w = frames[i : i + _BLOCK] * _WINDOW
        s = np.fft.rfft(w, N_FFT)
        mels[i : i + _BLOCK] = np.log((s.real**2 + s.imag**2).astype(np.float32) @ _BANK + np.float32(1e-6))
        energy[i : i + _BLOCK] = 10 * np.log10((w * w).mean(axis=1) + 1e-9)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that begin where the energy reaches the upper threshold and end before it falls under the lower."""
    floor = np.partition(energy, len(energy) // 10)[len(energy) // 10]
    state = np.where(energy >= floor + BEGIN_DB, 1, np.where(energy < floor + END_DB, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(last >= 0, state[np.maximum(last, 0)], 0)
    edge = np.diff(np.r_[0, on, 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def tensors(mels: np.ndarray) -> bytes:
    """Arrow stream of fixed-shape tensors with their time spans."""
    n = -(-len(mels) // FRAMES)
    padded = np.zeros((n, FRAMES, MELS), np.float32)
    padded.reshape(-1, MELS)[: len(mels)] = mels
    first = np.arange(n) * FRAMES
    used = np.minimum(FRAMES, len(mels) - first)
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(padded)
    span = (first * HOP / RATE, ((first + used - 1) * HOP + WIN) / RATE)
    batch = pa.RecordBatch.from_arrays([column, pa.array(span[0]), pa.array(span[1]), pa.array(used.astype(np.int32))], names=["tensor", "start_s", "end_s", "frames"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in blocks(b, 1, rows=256):
            n, media = [], []
            for t in part.column(1):
                raw = (t.as_py() or "").encode("utf-8")
                n.append(len(raw))
                media.append(wav(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in blocks(b, b.schema.get_field_index("media"), rows=128, size=1 << 21):
            payloads, streams, spans = [], [], []
            for m in part.column(part.schema.get_field_index("media")):
                rate, payload = samples(m.as_py())
                up = np.gcd(rate, RATE)
                x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
                mels, energy = log_mel(resample(x, RATE // up, rate // up))
                payloads.append(payload)
                streams.append(tensors(mels))
                spans.append([{"start_s": s * HOP / RATE, "end_s": ((e - 1) * HOP + WIN) / RATE} for s, e in segments(energy)])
            span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), pa.array(streams, pa.binary()), pa.array(spans, span)], names=[*part.schema.names, "payload", "features", "segments"])


def to_clips(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row of docs (doc_id, text): the UTF-8 text, padded by spaces to a positive multiple
    of 192 bytes, as the samples of a WAV file. Null is the empty text; other columns are ignored; no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def with_features(clips: DataFrame) -> DataFrame:
    """clips (.., media) with payload (the samples read back), features (Arrow stream of tensors) and segments. Rows with a
    null media are left out; equal media give equal features; repeated rows are kept each. Columns of clips that bear one of
    these names are replaced. No clips give no rows. No shuffle."""
    kept = clips.where(F.col("media").isNotNull()).drop("payload", "features", "segments")
    extra = "payload binary, features binary, segments array<struct<start_s:double,end_s:double>>"
    return kept.mapInArrow(_features, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, {extra}")
