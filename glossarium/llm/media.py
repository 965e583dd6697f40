"""Media columns: WAV files, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, ship, slices, table

RATE = 8000
FRAME = 512
HOP = 256
#: Frequency bins 1.. are cut into these bands; each frame's peak is looked for in every band.
BANDS = (1, 16, 40, 88, 160, 257)
FAN_OUT = 3


def pad64(data: bytes) -> bytes:
    """``data`` with bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def write_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectrogram(samples: bytes) -> np.ndarray:
    """Magnitudes, frames by FRAME/2+1 bins, of Hann-windowed frames every HOP samples; the last is padded with
    silence (128)."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128.0
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), dtype=np.float32)])
    frames, hann = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP], np.hanning(FRAME).astype(np.float32)
    out = np.empty((len(frames), FRAME // 2 + 1), np.float32)
    for at in range(0, len(frames), 4096):  # a long text's windowed frames never stand in memory together
        out[at : at + 4096] = np.abs(np.fft.rfft(frames[at : at + 4096] * hann, axis=1))
    return out


def peak_pairs(spec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes of peak pairs. A frame's peak in a band is its loudest bin, kept if no quieter than
    that band's mean over the file; every kept peak is paired with the peak of its band in each of the next
    FAN_OUT frames. hash = bin << 20 | other bin << 8 | band << 4 | frames between."""
    times, hashes = [], []
    for band, (lo, hi) in enumerate(zip(BANDS, BANDS[1:])):
        part = spec[:, lo:hi]
        best = part.argmax(axis=1)
        level = part[np.arange(len(part)), best]
        kept = level >= level.mean(dtype=np.float64) - 1e-3
        best = best + lo
        for gap in range(1, min(FAN_OUT, len(spec) - 1) + 1):
            at = np.flatnonzero(kept[:-gap] & kept[gap:])
            times.append(at)
            hashes.append(best[at] << 20 | best[at + gap] << 8 | band << 4 | gap)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, h = np.concatenate(times).astype(np.int32), np.concatenate(hashes).astype(np.int32)
    order = np.lexsort((h, t))
    return t[order], h[order]


_SCHEMA = (
    "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "peak_time array<int>, peak_hash array<int>"
)


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: dict[str, list] = {k: [] for k in ("n", "media", "size", "sha", "crc", "t", "h")}
        for text in batch.column("text"):
            data = text.as_buffer()
            data = data.to_pybytes() if data is not None else b""
            media = write_wav(pad64(data))
            back = read_wav(media)
            t, h = peak_pairs(spectrogram(back))
            for k, v in zip(out, (len(data), media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), t, h)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(out["n"], pa.int64()),
                pa.array(out["media"], pa.binary()),
                pa.array(out["size"], pa.int64()),
                pa.array(out["sha"], pa.string()),
                pa.array(out["crc"], pa.int64()),
                pa.array(out["t"], pa.list_(pa.int32())),
                pa.array(out["h"], pa.list_(pa.int32())),
            ],
            names=["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "peak_time", "peak_hash"],
        )


def media_column(docs: DataFrame) -> DataFrame:
    """Store each text's UTF-8 bytes as an 8-bit mono WAV file and fingerprint what is read back.

    Row by row, without a shuffle. Null and empty texts give 64 zero samples; equal texts give equal rows; an
    empty table gives none; further columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    return doc_text(docs).mapInArrow(_media, _SCHEMA)


def op10_media(spark, sf_dir: str) -> DataFrame:
    m = media_column(table(spark, sf_dir, "documents"))
    code = F.to_json(F.struct(F.col("peak_time").alias("t"), F.col("peak_hash").alias("h")))
    return m.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.sha2(code.cast("binary"), 256).alias("feature"),
        F.size("peak_hash").alias("n_fingerprints"),
    )
