"""Media columns: bytes stored losslessly as WAV, with time-coded spectral fingerprints.

The payload is written and read back by the wave module as mono 8-bit samples.
Features come from the samples that were read back: a short-time Fourier
transform with a Hann window over frames without their mean, the strongest bin
of each frequency band in each frame, of those the strongest of the frame and
all that exceed twice its mean as peaks, and hashes of peak pairs
(anchor bin, target bin, distance in frames) coded by the anchor's frame.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from placekeep.llm.common import map_rows

BLOCK = 192
RATE = 8000
FRAME, HOP = 128, 64
#: Edges of the frequency bands, in bins of the transform.
BANDS = (2, 4, 8, 16, 32, 65)
#: Each anchor is paired with the peaks of so many frames after its own.
REACH = 2
_WINDOW = np.hanning(FRAME).astype(np.float32)
#: Frames transformed at once; it bounds memory and leaves results as they are.
_CHUNK = 512


def to_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with spaces up to a positive multiple of 192, and the unpadded length."""
    raw = (text or "").encode("utf-8")
    return raw + b" " * (-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of the spectral peaks, in order of time and frequency."""
    # Silence at either end puts every sample into two frames.
    x = np.pad(samples.astype(np.float32) - 128.0, FRAME - HOP)
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for at in range(0, n, _CHUNK):
        own = frames[at : at + _CHUNK]
        power = np.abs(np.fft.rfft((own - own.mean(1, keepdims=True)) * _WINDOW, axis=1))
        mean = power.mean(1)
        best = np.stack([power[:, a:b].argmax(1) + a for a, b in zip(BANDS, BANDS[1:])], 1)
        height = np.take_along_axis(power, best, 1)
        # The strongest counts in any frame that isn't constant, so that neighbouring frames always make a pair.
        t, band = np.nonzero((height > 2.0 * mean[:, None]) | (height == height.max(1, keepdims=True)) & (height > 0))
        times.append(t + at)
        bins.append(best[t, band])
    return np.concatenate(times), np.concatenate(bins)


def pair_hashes(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor frame and hash of each pair of a peak with one in the following frames."""
    out_t, out_h = [], []
    for dt in range(1, REACH + 1):
        first, last = np.searchsorted(t, t + dt, "left"), np.searchsorted(t, t + dt, "right")
        count = last - first
        anchor = np.repeat(np.arange(len(t)), count)
        target = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        out_t.append(t[anchor])
        out_h.append((f[anchor] << 14) | (f[target] << 4) | dt)
    at, code = np.concatenate(out_t), np.concatenate(out_h)
    order = np.lexsort((code, at))
    return at[order], code[order]


def describe(text: str | None) -> tuple:
    payload, n_bytes = to_payload(text)
    media = write_wav(payload)
    back = read_wav(media)
    t, f = peaks(np.frombuffer(back, np.uint8))
    at, code = pair_hashes(t, f)
    mark = xxhash.xxh64_hexdigest(at.astype("<i4").tobytes() + code.astype("<i4").tobytes())
    return n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(t)}:{len(at)}:{mark}", at.astype(np.int32), code.astype(np.int32)


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as a WAV and fingerprint it.

    Null texts count as empty; an empty payload is 192 spaces. Equal texts give
    equal values. ``pair_times`` and ``pair_hashes`` are arrays of equal length,
    ordered by time; they are empty only for constant payloads.
    ``keep_media`` adds the stored bytes as ``media``. Repeated rows are kept,
    other columns ignored.
    """

    def run(batch: pa.RecordBatch) -> list:
        rows, stored = [], []
        for text in batch.column(1).to_pylist():
            rows.append(describe(text))
            if keep_media:
                stored.append(write_wav(to_payload(text)[0]))
        return [batch.column(0), *([list(c) for c in zip(*rows)] if rows else [[]] * 9), *([stored] if keep_media else [])]

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pair_times array<int>, pair_hashes array<int>"
    return map_rows(docs.select(id_col, text_col), run, schema + (", media binary" if keep_media else ""))
