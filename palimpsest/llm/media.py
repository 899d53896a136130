"""Operator 6: media columns in WAV form with spectral-peak fingerprints.

A payload becomes a mono WAV file of unsigned 8-bit samples (one byte, one
sample), so storage is lossless. The stored bytes are read back by the ``wave``
module; features come from what was read. A short-time Fourier transform (Hann
window) gives magnitudes. The signal has one hop of silence before it and at
least one after it, up to a whole hop, so every sample lies in two frames. Peaks
are all bins that exceed their neighbours in time and frequency; each peak is
paired with the next peak of its frame and with the next ``FAN`` peaks from its
own bin of the next frame on, within a time span, and every pair is one 64-bit
code

    start frame << 32 | first bin << 20 | second bin << 8 | frames between

The codes of a file form its time-coded array, in ascending order.

Null counts as empty; an empty payload is 64 zero bytes.
Long payloads are transformed in blocks of frames, so memory stays bounded.
Equal payloads give equal columns.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import arrow_map, as_batches, texts

#: Payloads are padded with bytes 0 to a positive multiple of this.
UNIT = 64
RATE, FRAME, HOP = 8000, 256, 128
#: Frames transformed at once, and peaks that each peak is paired with, within so many frames.
BLOCK, FAN, SPAN = 4096, 3, 63
_WINDOW = np.hanning(FRAME)


def padded(data: bytes) -> bytes:
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data + bytes(size - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono file of 8-bit samples")
        return w.readframes(w.getnframes())


def frames_of(n: int) -> int:
    """Frames of so many samples; the first starts a hop before them, the last ends a hop after them or later."""
    return -(-n // HOP) + 1


def spectrogram(samples: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first frame, magnitudes) in blocks; a block repeats its neighbours' edge frames so that peaks can be compared across."""
    signal = np.zeros(FRAME + HOP * (frames_of(len(samples)) - 1))
    signal[HOP : HOP + len(samples)] = samples.astype(np.float64) - 128.0
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    for at in range(0, len(frames), BLOCK):
        low = max(0, at - 1)
        # rounded, so that equal frames have equal magnitudes
        yield low, np.round(np.abs(np.fft.rfft(frames[low : at + BLOCK + 1] * _WINDOW, axis=1)), 6)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, by frame and then bin: all bins above the mean's that exceed both neighbours in time and in frequency (of equal ones, the first)."""
    times, bins = [], []
    for low, mag in spectrogram(samples):
        mag = mag[:, 1:]  # without the mean
        around = np.full((mag.shape[0] + 2, mag.shape[1] + 2), -1.0)
        around[1:-1, 1:-1] = mag
        good = (mag > 1e-6) & (mag > around[:-2, 1:-1]) & (mag >= around[2:, 1:-1]) & (mag > around[1:-1, :-2]) & (mag >= around[1:-1, 2:])
        row, place = np.nonzero(good)
        frame = low + row
        # edge frames repeated from a neighbouring block are judged there
        first = low if low == 0 else low + 1
        own = (frame >= first) & (frame < first + BLOCK)
        times.append(frame[own])
        bins.append(place[own] + 1)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """The time-coded array of a sample row."""
    return paired(*peaks(samples))


def paired(t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The codes of all pairs of peaks given by frame and bin, in ascending order."""
    order = t << 12 | f
    after = np.searchsorted(order, (t + 1) << 12 | f)
    codes = []
    for following, k in ((np.arange(1, len(t) + 1), 0), *((after, k) for k in range(FAN))):
        start = np.flatnonzero(following + k < len(t))
        mate = following[start] + k
        if following is not after:  # in the same frame
            start, mate = start[t[mate] == t[start]], mate[t[mate] == t[start]]
        dt = t[mate] - t[start]
        near = dt <= SPAN
        start, mate, dt = start[near], mate[near], dt[near]
        codes.append((t[start] << 32) | (f[start] << 20) | (f[mate] << 8) | dt)
    return np.sort(np.concatenate(codes)).astype(np.int64)


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_files: bool = False, keep_codes: bool = False) -> DataFrame:
    """Per row: id, n_bytes (unpadded), payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), media_bytes, media_sha256, feature.

    ``feature`` is ``peaks:pairs:SHA-256 of the time-coded array`` (all peaks; pairs are the array's codes). With
    ``keep_codes`` the array itself follows as fingerprint, with ``keep_files``
    the WAV file as media.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            prints: list[np.ndarray] = []
            for t in texts(b, text_col):
                stored = to_wav(padded(t or b""))
                payload = from_wav(stored)
                found = peaks(np.frombuffer(payload, np.uint8))
                codes = paired(*found)
                rows.append((
                    len(t or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(),
                    f"{len(found[0])}:{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()}", stored if keep_files else None,
                ))
                prints.append(codes if keep_codes else codes[:0])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")
            out = {id_col: (b.column(b.schema.get_field_index(id_col)), pa.int64())} | {n: ([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
            if not keep_files:
                del out["media"]
            if keep_codes:
                out["fingerprint"] = (prints, pa.list_(pa.int64()))
            yield from as_batches(out)

    return arrow_map(df, (id_col, text_col), run, f"`{id_col}` long, {SCHEMA}" + (", media binary" if keep_files else "") + (", fingerprint array<long>" if keep_codes else ""))
