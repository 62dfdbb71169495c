"""Audio features of media columns.

Bytes are kept as the samples of a mono 8-bit PCM WAV file; features are computed from the file that was stored:

- polyphase resampling: a windowed-sinc low pass split into phases, so that only samples that are kept are computed;
- log-mel filterbanks over overlapped Hann windows, as tensors of one fixed shape (frames, bands), each with its time span;
- segments by energy with hysteresis: a segment begins at the upper threshold and ends below the lower one.

Texts become files in one pass, and the files are a table of the shared folder. Features are a second pass over it, which
stores the tensors in Parquet files of the shared folder, as a column of Arrow's fixed-shape tensor type beside their spans;
each document's row names the file and the row group that it wrote, so files of lost attempts are never read. A third pass
reads tensors back. Nothing is shuffled. Arithmetic is in double precision, and tensors hold fixed-point numbers, so that
equal texts have equal values where the CPUs add alike; sums of unlike ones
may differ in their last bits, which rounding to a 64th makes rare and does not rule out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, saved, shared_dir, text_bytes

RATE, UP, DOWN = 16_000, 1, 2
WINDOW, HOP, FFT, BANDS = 200, 80, 256, 40
#: Frames of one tensor; payloads are padded to a multiple of BLOCK bytes.
FRAMES, BLOCK = 64, 576
#: Steps of a tensor's values in one unit of the natural logarithm, and the type that holds them.
LEVELS = 64
TENSOR = pa.fixed_shape_tensor(pa.int16(), (FRAMES, BANDS))
_SPAN = pa.struct([("start", pa.float64()), ("stop", pa.float64())])
_SEGMENT = pa.struct([("start", pa.float64()), ("stop", pa.float64()), ("energy", pa.float64())])
#: Seconds between two frames.
SECONDS = HOP / (RATE * UP / DOWN)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of unsigned 8-bit mono samples (an even number)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def samples_of(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of such a file, chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        if kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def _phases(up: int, down: int, taps: int = 16) -> np.ndarray:
    """Row r: the filter's taps for outputs that lie r / up between two samples."""
    n = taps * up
    t = np.arange(-n, n + up) / up
    cut = min(1.0, up / down)
    h = cut * np.sinc(cut * t) * np.where(np.abs(t) <= taps, 0.5 + 0.5 * np.cos(np.pi * t / (taps + 1)), 0)
    rows = h.reshape(-1, up).T[:, ::-1]
    return np.ascontiguousarray(rows / rows.sum(axis=1, keepdims=True))


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up / down times its rate; edges are held."""
    h = _phases(up, down)
    width = h.shape[1]
    padded = np.concatenate([np.full(width // 2, x[:1]), x, np.full(width, x[-1:])])
    n = -(-len(x) * up // down)
    out = np.empty(n)
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    for first in range(min(up, n)):
        at = np.arange(first, n, up, dtype=np.int64) * down
        base, r = at // up, int(at[0] % up)
        step = down
        out[first::up] = windows[base[0] : base[-1] + 1 : step] @ h[r]
    return out


@cache
def _mel(rate: int) -> np.ndarray:
    """Triangles of BANDS bands over the bins of a spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    rise = (f[:, None] - edge[None, :-2]) / (edge[1:-1] - edge[:-2])
    fall = (edge[None, 2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


_HANN = np.hanning(WINDOW)


def log_mel(x: np.ndarray, rate: int, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows of overlapped windows, and their energy in decibels. A signal shorter than a window is padded with zeros."""
    if len(x) < WINDOW:
        x = np.pad(x, (0, WINDOW - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    mel, energy, bank = np.empty((len(frames), BANDS)), np.empty(len(frames)), _mel(rate)
    for a in range(0, len(frames), step):
        part = frames[a : a + step] * _HANN
        power = np.abs(np.fft.rfft(part, FFT, axis=1)) ** 2
        mel[a : a + step] = np.log(power @ bank + 1e-6)
        energy[a : a + step] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / WINDOW + 1e-10)
    return mel, energy


def segments(energy: np.ndarray, low: float = 40, high: float = 60) -> list[tuple[int, int]]:
    """Frame ranges that begin at the percentile `high` of the energies and end below the percentile `low`."""
    lo, hi = np.percentile(energy, [low, high])
    event = np.where(energy >= hi, 1, np.where(energy < lo, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.concatenate([[False], (last >= 0) & (event[last] == 1), [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray) -> np.ndarray:
    """Consecutive tensors of shape (FRAMES, BANDS) in LEVELS steps; the last is filled up with its lowest value."""
    n = -(-len(mel) // FRAMES)
    out = np.full((n * FRAMES, BANDS), mel.min())
    out[: len(mel)] = mel
    return np.round(out * LEVELS).astype(np.int16).reshape(n, FRAMES, BANDS)


def spans(frames: int) -> list[dict[str, float]]:
    """Start and stop in seconds of each tensor of so many frames."""
    return [{"start": k * SECONDS, "stop": min(frames, k + FRAMES) * SECONDS} for k in range(0, frames, FRAMES)]


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A kept table id_col, n_bytes, media: each text's bytes, padded with 255, as a WAV file. A null text is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        for batch in batches:
            for piece in pieces(batch, 1):
                buf, offsets = text_bytes(piece.column(1))
                data, media = buf.tobytes(), []
                for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                    size = max(1, -(-(b - a) // BLOCK)) * BLOCK
                    media.append(wav(data[a:b] + b"\xff" * (size - (b - a))))
                yield pa.record_batch({"id": piece.column(0), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "media": pa.array(media, pa.binary())})

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return saved(texts.mapInArrow(encode, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col), "audio_media")


def audio_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Features of each stored file, a kept table: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    frames, segments (array of start, stop in seconds, mean energy in decibels), and where its tensors are stored: path,
    row_group, place (the how manieth document of the group), n_tensors.

    Equal files have equal features. Every row stays a row; an empty table gives an empty table.
    """
    kind, folder = media.schema[id_col].dataType.simpleString(), f"{shared_dir(media.sparkSession)}/tensors-{uuid.uuid4().hex}"
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.int64()), ("segments", pa.list_(_SEGMENT))]
    stored = pa.schema([("doc", pa.int32()), ("span", _SPAN), ("mel", TENSOR)])

    def features(batches):
        writer, sink, path, group = None, None, "", 0
        try:
            for batch in batches:
                for piece in pieces(batch, 2):
                    rows, parts, at = [], [], []
                    for raw in piece.column(2):
                        data = raw.as_py()
                        payload, rate = samples_of(data)
                        mel, energy = log_mel(resample((np.frombuffer(payload, np.uint8) - 128.0) / 128), rate * UP // DOWN)
                        found = [{"start": a * SECONDS, "stop": b * SECONDS, "energy": float(energy[a:b].mean())} for a, b in segments(energy)]
                        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), len(mel), found))
                        parts.append(tensors(mel))
                        at += spans(len(mel))
                    if writer is None:
                        where, base = fs.FileSystem.from_uri(folder)
                        where.create_dir(base, recursive=True)
                        name, group = f"{uuid.uuid4().hex}.parquet", 0
                        path, sink = f"{folder}/{name}", where.open_output_stream(f"{base}/{name}")
                        writer = pq.ParquetWriter(sink, stored, compression="zstd", use_dictionary=False)
                    n = [len(p) for p in parts]
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(parts).ravel()), FRAMES * BANDS)
                    own = [pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)), pa.array(at, _SPAN), pa.ExtensionArray.from_storage(TENSOR, flat)]
                    writer.write_table(pa.Table.from_arrays(own, schema=stored), row_group_size=1 << 30)
                    out = {"id": piece.column(0), "n_bytes": piece.column(1)} | {k: pa.array(c, t) for (k, t), c in zip(kinds, zip(*rows, strict=True), strict=True)}
                    yield pa.record_batch(out | {"path": pa.array([path] * len(n)), "row_group": pa.array([group] * len(n), pa.int32()), "place": pa.array(range(len(n)), pa.int32()), "n_tensors": pa.array(n, pa.int32())})
                    group += 1
        finally:
            if writer is not None:
                writer.close()
                sink.close()

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, segments array<struct<start:double,stop:double,energy:double>>"
    out = media.select(F.col(f"`{id_col}`").alias("id"), "n_bytes", "media").mapInArrow(features, f"{schema}, path string, row_group int, place int, n_tensors int")
    return saved(out.withColumnRenamed("id", id_col), "audio_features")


def _stored(batch: pa.RecordBatch):
    """Of each row the tensors (an Arrow array of the fixed-shape type) and their spans, read from its file; a row group is read once for rows that follow one another."""
    file, table, at = None, None, (None, None)
    for path, group, place in zip(*(batch.column(c).to_pylist() for c in ("path", "row_group", "place")), strict=True):
        if path != at[0]:
            where, name = fs.FileSystem.from_uri(path)
            file, at = pq.ParquetFile(where.open_input_file(name)), (path, None)
        if group != at[1]:
            table, at = file.read_row_group(group).combine_chunks(), (path, group)
            doc = table["doc"].to_numpy()
        a, b = np.searchsorted(doc, [place, place + 1])
        own = table.slice(a, b - a)
        yield own["mel"].combine_chunks(), own["span"].combine_chunks()


def stored_tensors(features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each stored tensor of audio_features: id_col, nth (from 0), start, stop (seconds), mel (array of FRAMES x BANDS short, row by row, LEVELS steps to one)."""
    kind = features.schema[id_col].dataType.simpleString()

    def read(batches):
        for batch in batches:
            for i, (mel, span) in enumerate(_stored(batch)):
                yield pa.record_batch({
                    "id": batch.column(0).take(pa.array([i] * len(mel), pa.int32())), "nth": pa.array(range(len(mel)), pa.int32()), "start": span.field("start"), "stop": span.field("stop"),
                    "mel": mel.storage.cast(pa.list_(pa.int16())),
                })

    rows = features.select(F.col(f"`{id_col}`").alias("id"), "path", "row_group", "place")
    return rows.mapInArrow(read, f"id {kind}, nth int, start double, stop double, mel array<short>").withColumnRenamed("id", id_col)


def with_digests(features: DataFrame) -> DataFrame:
    """audio_features and mel_crc32 (long, of the little-endian values of the row's tensors as they are stored) and n_spans (int, how many spans are stored with them)."""

    def read(batches):
        for batch in batches:
            found = [(zlib.crc32(mel.storage.flatten().to_numpy().astype("<i2").tobytes()), len(span)) for mel, span in _stored(batch)]
            yield batch.append_column("mel_crc32", pa.array([c for c, _ in found], pa.int64())).append_column("n_spans", pa.array([n for _, n in found], pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema)
    return features.mapInArrow(read, f"{schema}, mel_crc32 long, n_spans int")
