"""Media columns: texts as 8-bit WAV samples, short-time Fourier features and peak-pair fingerprints.

Stored form: a mono, 8-bit, 8 kHz WAV file whose samples are the payload bytes, written and read by
the wave module. The payload is the text's UTF-8 followed by bytes 255 up to a positive multiple of
BLOCK. Features: a Hann-windowed short-time Fourier transform of the samples read back, its
spectral peaks (the strongest bin of each of four bands, if above the frame's mean), and pairs of a
peak with the peaks of all bands, its own included, of the next FAN frames, coded as (f1, f2, dt) at
time t. The samples are followed by silence up to the end of the last frame, so each byte is in one.

Cases: a null text counts as empty and an empty payload is one BLOCK of 255. Texts of any length
are transformed in pieces of FRAMES frames. Equal texts give equal values. An empty table gives an
empty result. Only the id and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

BLOCK = 576
RATE = 8000
WINDOW = 256
HOP = 192
FRAMES = 4096
FAN = 3
#: Bits of a code in a time-coded number.
TIME_SHIFT = 20
#: Edges of the bands, in bins of the transform.
BANDS = (1, 9, 25, 57, 129)


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


#: A Hann window is 0 at its ends; without these, the first and the last byte count.
_HANN = np.hanning(WINDOW + 2)[1:-1].astype(np.float32)


def _frames(samples: np.ndarray, at: int, n: int) -> np.ndarray:
    """n windowed frames of the samples from frame `at` on; silence, the middle of the 8-bit range, follows the last sample."""
    first, last = at * HOP, (at + n - 1) * HOP + WINDOW
    part = samples[first:last] - np.float32(127.5)
    part = np.pad(part, (0, last - first - len(part)))
    return np.lib.stride_tricks.sliding_window_view(part, WINDOW)[::HOP] * _HANN


def _peaks(samples: np.ndarray) -> np.ndarray:
    """Strongest bin of each band and frame; 0 where no bin stands out. Shape: frames x bands."""
    count = max(1, 1 + -(-(len(samples) - WINDOW) // HOP))
    out = np.zeros((count, len(BANDS) - 1), dtype=np.int32)
    for at in range(0, count, FRAMES):
        n = min(FRAMES, count - at)
        # rounded, so that the last bits of the transform decide nothing
        power = np.round(np.abs(np.fft.rfft(_frames(samples, at, n), axis=1)), 3)
        mean = power[:, 1:].mean(axis=1)
        for b, (lo, hi) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            best = power[:, lo:hi].argmax(axis=1)
            out[at : at + n, b] = np.where(power[np.arange(n), lo + best] > mean, lo + best, 0)
    return out


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): a code is f1 << 12 | f2 << 4 | dt, in the order of time, code."""
    peaks = _peaks(np.frombuffer(samples, dtype=np.uint8).astype(np.float32))
    times, codes = [], []
    for dt in range(1, FAN + 1):
        first, second = peaks[:-dt], peaks[dt:]
        t, i, j = np.nonzero((first[:, :, None] > 0) & (second[:, None, :] > 0))
        times.append(t)
        codes.append((first[t, i] << 12) | (second[t, j] << 4) | dt)
    t, c = np.concatenate(times).astype(np.int64), np.concatenate(codes).astype(np.int64)
    order = np.lexsort((c, t))
    return t[order], c[order]


_PAIR = StructType([StructField("time", IntegerType()), StructField("code", IntegerType())])
_COMMON = [
    StructField("n_bytes", LongType()),
    StructField("payload_bytes", LongType()),
    StructField("payload_sha256", StringType()),
    StructField("tail_crc32", LongType()),
    StructField("media_bytes", LongType()),
    StructField("media_sha256", StringType()),
]


def _media(text: str | None) -> tuple[dict, bytes, np.ndarray, np.ndarray]:
    stored = to_wav(payload(text))
    back = read_wav(stored)
    row = {
        "n_bytes": len((text or "").encode("utf-8", "surrogatepass")),
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-32:]),
        "media_bytes": len(stored),
        "media_sha256": hashlib.sha256(stored).hexdigest(),
    }
    return (row, stored, *fingerprint(back))


def _digests(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        row, _, t, c = _media(text)
        rows.append(row | {"feature": f"{len(t)}:{hashlib.sha256(np.stack([t, c]).tobytes()).hexdigest()}", "pairs": t << TIME_SHIFT | c})
    return pd.DataFrame(rows, columns=[*(f.name for f in _COMMON), "feature", "pairs"])


def _columns(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        row, stored, t, c = _media(text)
        rows.append(row | {"media": stored, "pairs": [{"time": int(a), "code": int(b)} for a, b in zip(t, c, strict=True)]})
    return pd.DataFrame(rows, columns=[*(f.name for f in _COMMON), "media", "pairs"])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sizes and digests, media, pairs): the WAV file and its time-coded fingerprint array."""
    out = StructType([*_COMMON, StructField("media", BinaryType()), StructField("pairs", ArrayType(_PAIR))])
    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(_columns, out)(F.col(text_col)).alias("m")).select("doc_id", "m.*")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As media_columns, without the file, with `feature` (number of pairs and SHA-256 of the pair array) and each pair as one number, time << TIME_SHIFT | code."""
    out = StructType([*_COMMON, StructField("feature", StringType()), StructField("pairs", ArrayType(LongType()))])
    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(_digests, out)(F.col(text_col)).alias("m")).select("doc_id", "m.*")
