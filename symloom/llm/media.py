"""Media columns: texts as 8-bit audio, and features of audio.

``store`` keeps the UTF-8 bytes of a text, filled with bytes 255 to a positive multiple of 576, as the samples of a
mono 8-bit PCM WAV file in a binary column. ``features`` reads the stored bytes back and computes

* a rational resampling by UP / DOWN (2 / 3) with a polyphase windowed-sinc filter (only the taps of an output's phase run),
* log-mel energies of overlapped Hann windows (FRAME samples, every HOP), in hundredths and rounded,
* segments by hysteresis: they begin where the frame energy exceeds the upper threshold and last while it stays above
  the lower one; both are offsets in dB from the clip's own mean energy.

Energies are cut into fixed-shape tensors of PATCH frames x MELS (the last is filled with the floor value), each with
its time span. ``write_tensors`` stores them in Parquet files of the shared folder: a row for each patch with an Arrow
fixed-shape tensor column and its span; the first row of a clip also has the clip's values and its segments.
``read_tensors`` reads them back, a row for each clip; in Spark a tensor is an array of PATCH * MELS shorts. The query
stores media, reads them, stores tensors, reads those, and its ``feature`` digests what was read last.

Defined results: a null text counts as empty and becomes 576 bytes of 255. Equal texts give equal values. Frames are
worked on BLOCK at a time, so the memory beyond the clip itself is bounded. Rows that repeat are treated each by itself,
an empty table gives no rows. Only doc_id and text are read; other columns, of any name, don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import drop_at_exit, fresh_path, materialize, prepare, texts_of

UNIT = 576
RATE = 16_000
UP, DOWN, TAPS = 2, 3, 16
FRAME, HOP, MELS, PATCH = 256, 128, 20, 32
UPPER_DB, LOWER_DB = 1.0, -0.5
BLOCK = 2048
FLOOR = 1e-6


def payload_of(text: str) -> tuple[bytes, int]:
    """The filled payload, and the number of bytes that are text."""
    data = text.encode("utf-8", "replace")
    return data + b"\xff" * (UNIT * max(1, -(-len(data) // UNIT)) - len(data)), len(data)


def wav(payload: bytes, rate: int = RATE) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def samples_of(data: bytes) -> tuple[bytes, int]:
    """The 8-bit samples and the rate of a mono PCM WAV file; chunks in any order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is supported")
        elif name == b"data":
            out = data[at + 8 : at + 8 + size]
            if len(out) != size or not rate:
                raise ValueError("broken WAV file")
            return out, rate
        at += 8 + size + size % 2
    raise ValueError("WAV file without data")


def filter_bank(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc low-pass as ``up`` phases of ``taps`` coefficients."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * t) * np.kaiser(n, 6.0)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T.astype(np.float32))


def resample(x: np.ndarray, bank: np.ndarray, down: int = DOWN) -> np.ndarray:
    """Output n is sum_k bank[p, k] x[m - k], with p = n down mod up and m = n down div up."""
    up, taps = bank.shape
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(taps, np.float32)])
    for r in range(up):  # outputs r, r + up, ... have one phase, and their inputs are ``down`` apart
        phase, first = r * down % up, r * down // up
        size = len(range(r, n, up))
        acc = np.zeros(size, np.float32)
        for k in range(taps):
            a = first + taps - 1 - k
            acc += bank[phase, k] * padded[a : a + size * down : down][:size]
        out[r::up] = acc
    return out


def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters over the bins of a real FFT."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(frame, 1 / rate)
    a, b, c = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - a) / (b - a), (c - bins) / (c - b))).T.astype(np.float32)


_tables: dict[tuple, tuple] = {}


def tables(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    if rate not in _tables:
        out = rate * UP / DOWN
        _tables[rate] = filter_bank(), np.hanning(FRAME + 1)[:-1].astype(np.float32), mel_bank(out), out
    return _tables[rate]


def hysteresis(energy: np.ndarray, upper: float, lower: float) -> np.ndarray:
    """(first, past-last) frames of the runs at or above ``lower`` that reach ``upper``."""
    on = np.concatenate(([False], energy >= lower, [False]))
    edge = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    if not len(edge):
        return edge
    high = np.concatenate(([0], np.cumsum(energy >= upper)))
    return edge[high[edge[:, 1]] > high[edge[:, 0]]]


@dataclass
class Features:
    tensors: np.ndarray  # patches x PATCH x MELS, int16 hundredths
    spans: np.ndarray  # patches x 2, seconds
    segments: np.ndarray  # n x 2, seconds

    def digest(self) -> str:
        """Counts, and a hash of tensors, spans and segments (times in microseconds)."""
        h = hashlib.sha256(self.tensors.tobytes())
        for times in (self.spans, self.segments):
            h.update(np.rint(times * 1e6).astype("<i8").tobytes())
        return f"{len(self.tensors)}x{PATCH}x{MELS}:{len(self.segments)}:{h.hexdigest()}"


def analyze(samples: bytes, rate: int) -> Features:
    bank, window, mels, out = tables(rate)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x, bank)
    n = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)]) if (n - 1) * HOP + FRAME > len(y) else y
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
    grid = np.full((-(-n // PATCH) * PATCH, MELS), round(100 * np.log(FLOOR)), np.int16)
    energy = np.empty(n, np.float32)
    for a in range(0, n, BLOCK):
        f = frames[a : a + BLOCK] * window
        spec = np.fft.rfft(f, axis=1)
        power = (spec.real**2 + spec.imag**2).astype(np.float32)
        grid[a : a + len(f)] = np.rint(100 * np.log(power @ mels + FLOOR))
        energy[a : a + len(f)] = 10 * np.log10((f * f).mean(1) + FLOOR)
    step = HOP / out
    mean = float(energy.astype(np.float64).mean())
    segments = hysteresis(energy, mean + UPPER_DB, mean + LOWER_DB) * step
    first = np.arange(0, n, PATCH)
    spans = np.stack([first * step, (np.minimum(first + PATCH, n) - 1) * step + FRAME / out], 1)
    return Features(grid.reshape(-1, PATCH, MELS), spans, segments)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the WAV column, written to the shared folder and reread."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [payload_of(t) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([wav(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    path = fresh_path(docs.sparkSession, "media")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")
    rows.write.option("compression", "zstd").parquet(path)
    drop_at_exit(docs.sparkSession, path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


CLIP = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
_CLIP_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
_TENSOR = pa.fixed_shape_tensor(pa.int16(), (PATCH, MELS))
_SCHEMA = pa.schema([("clip", pa.int64()), *zip(CLIP, _CLIP_KINDS), ("segments", pa.list_(pa.float64())), ("begin", pa.float64()), ("end", pa.float64()), ("tensor", _TENSOR)])


def _patches(first: int, clips: list[tuple], found: list[Features]) -> pa.Table:
    """The rows of some clips; ``first`` is the number of the first one in its file."""
    n = [len(f.spans) for f in found]
    clip = np.repeat(np.arange(len(found)), n)
    head = np.concatenate(([True], clip[1:] != clip[:-1]))
    own = pa.array(np.where(head, clip, 0), mask=~head)  # the clip's values go to its first row
    values = [pa.array(c, t).take(own) for c, t in zip(zip(*clips), _CLIP_KINDS)]
    segments = pa.array([f.segments.ravel() for f in found], pa.list_(pa.float64())).take(own)
    spans = np.concatenate([f.spans for f in found])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([f.tensors for f in found]).ravel()), PATCH * MELS)
    return pa.Table.from_arrays([pa.array(clip + first), *values, segments, pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.ExtensionArray.from_storage(_TENSOR, flat)], schema=_SCHEMA)


#: Samples whose features are held before they are written.
HELD = 8 << 20


def write_tensors(media: DataFrame) -> tuple[DataFrame, str]:
    """Reads ``store``'s column and writes the tensor files: (path, clips) of each, and their folder. Only files that finished
    tasks list count, so tasks that were lost or made again leave no trace."""
    spark = media.sparkSession
    prepare(spark)
    home = fresh_path(spark, "tensors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(home)
        fs.create_dir(at, recursive=True)
        name, writer, done, size = f"{at}/{uuid.uuid4().hex}.parquet", None, 0, 0
        clips: list[tuple] = []
        found: list[Features] = []

        def flush() -> None:
            nonlocal writer, done, size
            if clips:
                writer = writer or pq.ParquetWriter(name, _SCHEMA, filesystem=fs, compression="zstd")
                writer.write_table(_patches(done, clips, found))
                done, size = done + len(clips), 0
                clips.clear()
                found.clear()

        for b in batches:
            for doc, n, data in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media")):
                data = data.as_py()
                payload, rate = samples_of(data)
                clips.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest()))
                found.append(analyze(payload, rate))
                size += len(payload)
                if size >= HELD:
                    flush()
        flush()
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "clips": [done]})

    files = materialize(media.select("doc_id", "n_bytes", "media").mapInArrow(run, "path string, clips long"), "tensor-files")
    if files.limit(1).count():
        drop_at_exit(spark, home)
    return files, home


def _clips(fs: pafs.FileSystem, path: str, told: int) -> Iterator[tuple[dict, Features]]:
    """The clips of one tensor file, patch rows put together again."""
    seen, head, parts = 0, None, []

    def made() -> tuple[dict, Features]:
        tensors, spans = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return head, Features(tensors, spans, np.array(head["segments"]).reshape(-1, 2))

    with fs.open_input_file(path) as f:
        for b in pq.ParquetFile(f).iter_batches(batch_size=1024):
            clip = b.column("clip").to_numpy()
            tensor = b.column("tensor").storage.flatten().to_numpy().reshape(-1, PATCH, MELS)
            spans = np.stack([b.column("begin").to_numpy(), b.column("end").to_numpy()], 1)
            starts = np.flatnonzero(np.concatenate(([True], clip[1:] != clip[:-1])))
            for a, e in zip(starts.tolist(), [*starts[1:].tolist(), len(clip)]):
                if clip[a] == seen:  # a new clip
                    if head is not None:
                        yield made()
                    head, parts, seen = {c: b.column(c)[a].as_py() for c in (*CLIP, "segments")}, [], seen + 1
                parts.append((tensor[a:e], spans[a:e]))
    if head is not None:
        yield made()
    if seen != told:
        raise ValueError(f"{path}: {seen} clips, {told} were written")


def _read(files: DataFrame, home: str, schema: str, of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(home)
        for b in batches:
            for path, told in zip(b.column("path").to_pylist(), b.column("clips").to_pylist()):
                held, size = [], 0
                for clip in _clips(fs, path, told):
                    held.append(clip)
                    size += clip[0]["payload_bytes"]
                    if size >= HELD or len(held) == 512:
                        yield of(held)
                        held, size = [], 0
                if held:
                    yield of(held)

    n = files.count()
    return files.repartitionByRange(max(1, min(n, 4096)), "path").mapInArrow(run, schema)


_CLIP_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def read_tensors(files: DataFrame, home: str) -> DataFrame:
    """The clips of tensor files with their segments and patches: the operator's whole output."""
    span = [("begin", pa.float64()), ("end", pa.float64())]
    kinds = [*_CLIP_KINDS, pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("tensor", pa.list_(pa.int16()))]))]

    def of(clips: list[tuple[dict, Features]]) -> pa.RecordBatch:
        rows = []
        for head, f in clips:
            segments = [{"begin": x, "end": y} for x, y in f.segments.tolist()]
            patches = [{"begin": x, "end": y, "tensor": t.ravel()} for (x, y), t in zip(f.spans.tolist(), f.tensors)]
            rows.append((*(head[c] for c in CLIP), segments, patches))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [*CLIP, "segments", "patches"])

    return _read(files, home, _CLIP_SCHEMA + ", segments array<struct<begin double, end double>>, patches array<struct<begin double, end double, tensor array<short>>>", of)


def features(media: DataFrame) -> DataFrame:
    """The clips of ``store``'s column with segments and patches, by way of tensor files."""
    return read_tensors(*write_tensors(media))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row; n_patches
    and n_segments as well. The features are those of the stored tensors."""

    def of(clips: list[tuple[dict, Features]]) -> pa.RecordBatch:
        rows = [(*(head[c] for c in CLIP), f.digest(), len(f.tensors), len(f.segments)) for head, f in clips]
        kinds = (*_CLIP_KINDS, pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [*CLIP, "feature", "n_patches", "n_segments"])

    return _read(*write_tensors(store(docs)), _CLIP_SCHEMA + ", feature string, n_patches long, n_segments long", of)
