"""Media columns: 8-bit audio, and features of it.

A payload is stored as the samples of a mono 8-bit WAV file in a binary column.
Features come from the stored bytes: a polyphase filter resamples them, overlapped
windows give log-mel bands, and an energy curve with two thresholds gives segments:
a segment holds the frames above the low one around any frame above the high one.
Each segment is a fixed-shape tensor of pooled bands, in half precision, with its time
span; a row's segments are stored as an Arrow IPC stream with a fixed_shape_tensor
column, and digests are taken from what is read back.

Every row is worked on by itself, so equal payloads have equal features, and frames
are taken in blocks, so memory follows the longest payload's samples and not its
frames.

Defined cases: a null text is an empty one, and an empty payload is 64 zero bytes;
null ids and repeated rows are rows like others; silence, or sound of one level, is
one segment; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnp import batches, trim

RATE = 16_000
UP, DOWN = 1, 2
TAPS = 24
WINDOW, HOP, BANDS = 256, 128, 32
BINS = 8
UNIT = 64
HEADER = 44
#: Payloads that are worked on at a time.
ROWS = 256
#: Shares of the range between the 10th and 95th percentile of frame energy.
LOW, HIGH = 0.3, 0.6
LEVEL_DB = 3.0


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """`data` with zero bytes up to a positive multiple of `unit`."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of mono unsigned 8-bit samples."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + n) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n & 0xFFFFFFFF) + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file."""
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a WAV file with its samples after the first header")
    return media[HEADER:]


@lru_cache(maxsize=4)
def _filters(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass, one row for each phase."""
    t = np.arange(taps * up) - (taps * up - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hanning(taps * up + 2)[1:-1]
    return (h / h.sum() * up).reshape(taps, up).T[:, ::-1].astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS, block: int = 1 << 15) -> np.ndarray:
    """`x` at up/down times its rate; each output takes the taps of its own phase."""
    h = _filters(up, down, taps)
    n = -(-len(x) * up // down)
    wide = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(wide, taps)
    out = np.empty(n, np.float32)
    for p in range(up):
        m = np.arange(p, n, up)
        if len(m):
            at = views[(p * down) // up :: down][: len(m)]
            phase = h[(p * down) % up]
            for i in range(0, len(m), block):
                out[m[i : i + block]] = at[i : i + block] @ phase
    return out


@lru_cache(maxsize=4)
def _mel(rate: int, window: int, bands: int) -> np.ndarray:
    """Triangular filters on the mel scale."""

    def mel(f: np.ndarray) -> np.ndarray:
        return 2595 * np.log10(1 + f / 700)

    edges = 700 * (10 ** (np.linspace(0, mel(np.array(rate / 2.0)), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, window // 2 + 1)[:, None]
    left, middle, right = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - left) / (middle - left), (right - f) / (right - middle))).astype(np.float32)


def log_mel(x: np.ndarray, rate: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of the mel bands, energy in dB) of each frame; the last one is filled with zeros."""
    frames = max(1, -(-max(0, len(x) - WINDOW) // HOP) + 1)
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + WINDOW - len(x), np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    shape, mel = np.hanning(WINDOW).astype(np.float32), _mel(rate, WINDOW, BANDS)
    bands, energy = np.empty((frames, BANDS), np.float32), np.empty(frames, np.float32)
    for i in range(0, frames, block):
        part = views[i : i + block] - views[i : i + block].mean(axis=1, keepdims=True)
        spectrum = np.abs(np.fft.rfft(part * shape, axis=1)).astype(np.float32) ** 2
        bands[i : i + block] = np.log10(spectrum @ mel + np.float32(1e-6))
        energy[i : i + block] = 10 * np.log10((part * part).mean(axis=1) + np.float32(1e-8))
    return bands, energy


def segments(energy: np.ndarray) -> np.ndarray:
    """(first, end) frames of each segment, by two thresholds."""
    floor, top = np.quantile(energy, [0.1, 0.95])
    if top - floor < LEVEL_DB:
        return np.array([[0, len(energy)]])
    above = np.zeros(len(energy) + 2, np.int8)
    above[1:-1] = energy > floor + LOW * (top - floor)
    edges = np.flatnonzero(np.diff(above)).reshape(-1, 2)
    loud = np.concatenate([[0], np.cumsum(energy > floor + HIGH * (top - floor))])
    return edges[loud[edges[:, 1]] > loud[edges[:, 0]]]


def features(payload: bytes, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """(spans in seconds, tensors of BINS x BANDS) of the segments of 8-bit samples."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - np.float32(128)) / np.float32(128)
    rate = rate * UP // DOWN
    bands, energy = log_mel(resample(x), rate)
    found = segments(energy)
    total = np.concatenate([np.zeros((1, BANDS)), np.cumsum(bands, axis=0, dtype=np.float64)])
    size = (found[:, 1] - found[:, 0])[:, None]
    lo = found[:, :1] + np.arange(BINS) * size // BINS
    hi = np.maximum(lo + 1, found[:, :1] + (np.arange(BINS) + 1) * size // BINS)
    tensors = (total[hi] - total[lo]) / (hi - lo)[:, :, None]
    return found * (HOP / rate), tensors.astype(np.float32)


def tensor_stream(spans: np.ndarray, tensors: np.ndarray) -> bytes:
    """An Arrow IPC stream: start, end and a fixed-shape tensor for each segment."""
    kind = pa.fixed_shape_tensor(pa.float16(), [BINS, BANDS])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.astype(np.float16).ravel()), BINS * BANDS)
    table = pa.record_batch([pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.ExtensionArray.from_storage(kind, flat)], names=["start", "end", "bands"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_batch(table)
    return sink.getvalue().to_pybytes()


def read_stream(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(spans, tensors) of such a stream."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    spans = np.column_stack([table["start"].to_numpy(), table["end"].to_numpy()])
    flat = table["bands"].chunk(0).storage.flatten().to_numpy() if len(spans) else np.zeros(0, np.float16)
    return spans, flat.reshape(len(spans), BINS, BANDS)


def write_media(docs: DataFrame, out: str, text: str = "text", key: str = "doc_id") -> None:
    """doc_id, n_bytes and media of each row, as Parquet."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in batches(it):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([wav(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim.mapInArrow(run, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(out)


def described(media: DataFrame) -> DataFrame:
    """Checksums of media(doc_id, n_bytes, media), and `segments`: each row's tensors with their time spans."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for whole in it:
            for k in range(0, whole.num_rows, ROWS):
                b, rows = whole.slice(k, ROWS), []
                for stored in b.column("media").to_pylist():
                    payload = samples(stored)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), tensor_stream(*features(payload))))
                columns = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "segments"]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", *names])
        trim()

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segments binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def write_features(media: DataFrame, out: str) -> None:
    """`described` rows, as Parquet."""
    described(media).write.option("compression", "zstd").parquet(out)


def digests(found: DataFrame) -> DataFrame:
    """Stored rows of `described` with `feature`, the number, shape and checksum of the tensors that they hold, in place of `segments`."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            marks = []
            for data in b.column("segments").to_pylist():
                spans, tensors = read_stream(data)
                mark = hashlib.sha256(tensors.astype("<f2").tobytes() + np.rint(spans * 1000).astype("<i4").tobytes()).hexdigest()[:32]
                marks.append(f"{len(spans)}x{BINS}x{BANDS}:{mark}")
            kept = [c for c in b.schema.names if c != "segments"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(marks, pa.string())], [*kept, "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return found.mapInArrow(run, schema)
