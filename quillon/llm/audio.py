"""Audio media columns: samples stored losslessly, polyphase resampling, log-mel frames, energy segments, fixed-shape tensors.

`media` holds RIFF/WAVE images (8-bit unsigned PCM, one channel). A signal is resampled by UP/DOWN with a windowed-sinc filter
split into UP phases, framed with half overlap, and turned into log-mel energies. Frames are stored as an Arrow record batch
whose `mel` column is a fixed_shape_tensor of (ROWS, MELS) float32 with the time span of each tensor; the last is padded with
zeros. Rows without doc_id keep none. Memory is that of a batch slice or of the longest row. A segment begins where energy rises above the signal's mean by `ON` dB and ends where it falls below the mean by `OFF`."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, named, nameless, small_batches
from .textbatch import as_bytes, text_slices

RATE, UP, DOWN, TAPS = 16_000, 5, 8, 12
FRAME, HOP, MELS, ROWS = 256, 128, 32, 64
ON, OFF, BLOCK = 1.0, 1.0, 4096


def wav(samples: bytes, rate: int = RATE) -> bytes:
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def wav_samples(image: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a RIFF/WAVE image with 8-bit mono PCM."""
    if image[:4] != b"RIFF" or image[8:12] != b"WAVE":
        raise ValueError("not a WAVE image")
    at, rate = 12, 0
    while at + 8 <= len(image):
        name, size = struct.unpack("<4sI", image[at : at + 8])
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", image[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        if name == b"data":
            return image[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def _phases() -> np.ndarray:
    """(UP, TAPS) low-pass filter, row p for outputs whose position is p mod UP."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS)
    return np.ascontiguousarray((h / h.sum() * UP).reshape(TAPS, UP).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x at rate UP/DOWN; ceil(len(x) * UP / DOWN) samples."""
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate((np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)))
    out, windows = np.empty(n, np.float32), np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    for k in range(min(UP, n)):  # outputs k, k + UP, ... read inputs that are DOWN apart through one phase
        out[k::UP] = windows[k * DOWN // UP :: DOWN][: len(out[k::UP])] @ _phases()[k * DOWN % UP]
    return out


@cache
def _mel() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(0, mel(top), MELS + 2) / 2595) - 1) / top * (FRAME // 2)
    bins, low, mid, high = np.arange(FRAME // 2 + 1)[:, None], edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, MELS) float32, rounded to 1/64; one frame at least, the end padded with zeros."""
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    padded = np.concatenate((x, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(x)), np.float32)))
    windows, window = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP], np.hanning(FRAME).astype(np.float32)
    out = np.empty((frames, MELS), np.float32)
    for k in range(0, frames, BLOCK):
        power = np.abs(np.fft.rfft(windows[k : k + BLOCK] * window, axis=1)).astype(np.float32) ** 2
        out[k : k + BLOCK] = 10 * np.log10(power @ _mel() + 1e-6)
    return np.round(out * 64) / 64


def segments(energy: np.ndarray) -> np.ndarray:
    """(n, 2) frame ranges where a hysteresis gate on energy is open."""
    mean = energy.mean()
    event = np.where(energy > mean + ON, 1, np.where(energy < mean - OFF, 0, -1))
    last = np.maximum.accumulate(np.where(event >= 0, np.arange(len(event)), -1))
    state = np.where(last >= 0, event[np.maximum(last, 0)], 0)
    return np.flatnonzero(np.diff(np.concatenate(([0], state, [0])))).reshape(-1, 2)


@cache
def _schema() -> pa.Schema:
    return pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("mel", pa.fixed_shape_tensor(pa.float32(), (ROWS, MELS)))])


def tensor_ipc(mel: np.ndarray) -> bytes:
    """The frames as an Arrow IPC stream of fixed-shape tensors with their time spans."""
    n, step = -(-len(mel) // ROWS), HOP / (RATE * UP / DOWN)
    full = np.zeros((n * ROWS, MELS), np.float32)
    full[: len(mel)] = mel
    start = np.arange(n) * ROWS * step
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, ROWS, MELS))
    batch = pa.record_batch([pa.array(start), pa.array(np.minimum(start + ROWS * step, len(mel) * step)), tensor], schema=_schema())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _schema()) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensors(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(tensors of shape (n, ROWS, MELS), spans of shape (n, 2)) of a stored stream."""
    table = pa.ipc.open_stream(image).read_all()
    return table["mel"].combine_chunks().to_numpy_ndarray(), np.stack([table["start_s"], table["end_s"]], 1)


def store_audio(docs: DataFrame, unit: int = 192) -> DataFrame:
    """doc_id, n_bytes, media of every row: the UTF-8 text (null: empty), padded with spaces to a positive multiple of unit, as samples."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in text_slices(pdf, "text"):
                raw = [as_bytes(t) for t in some["text"]]
                media = [wav(b.ljust(max(unit, -(-len(b) // unit) * unit))) for b in raw]
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "nameless": some["nameless"].to_numpy(), "n_bytes": [len(b) for b in raw], "media": media})

    small_batches(docs.sparkSession)
    return materialize(named(nameless(docs).mapInPandas(encode, "doc_id long, nameless boolean, n_bytes long, media binary")), "media")


def audio_features(media: DataFrame) -> DataFrame:
    """Features of the stored images (doc_id, n_bytes, media): payload, n_frames, spans (segments in seconds) and tensors (an Arrow IPC stream) of each row."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = HOP / (RATE * UP / DOWN)
        for pdf in batches:
            for some in text_slices(pdf, "media"):
                rows = []
                for image in some["media"]:
                    payload, _ = wav_samples(bytes(image))
                    mel = log_mel(resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128))
                    spans = [{"start_s": a * step, "end_s": b * step} for a, b in segments(mel.mean(1)).tolist()]
                    rows.append((payload, len(mel), spans, tensor_ipc(mel)))
                yield pd.concat([some.reset_index(drop=True), pd.DataFrame(rows, columns=["payload", "n_frames", "spans", "tensors"])], axis=1)

    schema = "doc_id long, nameless boolean, n_bytes long, media binary"
    return named(nameless(media, "n_bytes", "media").mapInPandas(decode, schema + ", payload binary, n_frames long, spans array<struct<start_s: double, end_s: double>>, tensors binary"))


def store_features(media: DataFrame) -> DataFrame:
    """The features of stored media as a table of their own: digests of payload and media, n_frames, spans and the tensors with their time spans."""
    f = audio_features(media)
    return materialize(f.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "n_frames", "spans", "tensors",
    ), "audio-features")


def document_audio(docs: DataFrame) -> DataFrame:
    """Media and features of every row are stored; the feature digest is taken from the stored tensors."""
    kept = store_features(store_audio(docs))
    return kept.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", "n_frames", F.size("spans"), F.sha2("tensors", 256)).alias("feature"))
