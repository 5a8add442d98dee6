"""Media columns: payloads as WAV samples, and spectral-peak pair fingerprints as time-coded arrays.

A media column holds whole WAV files (PCM, one channel, 8 bits a sample), written and read by the ``wave``
module. Features come from short-time Fourier transforms: in each frame the strongest local peaks, and for each
peak pairs with the strongest peak of each of the next frames, stored as the pair's time and its code (both bands
and the distance). Media and fingerprints are tables in the shared folder; digests are taken from what is read back.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import keep, slices, texts_of, tidied

UNIT, FILL, TAIL, RATE = 192, b"\x20", 16, 8000
FRAME, HOP, PEAKS, AHEAD = 192, 96, 3, 3
#: Frames transformed at a time.
FRAMES = 4096
_WINDOW = np.hanning(FRAME + 1)[:FRAME]


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is read here")
        return f.readframes(f.getnframes())


def spectral_peaks(samples: np.ndarray) -> np.ndarray:
    """Bands of each frame's strongest local peaks, the strongest first; -1 where there are fewer."""
    count = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    found = []
    for low in range(0, count, FRAMES):
        high = min(count, low + FRAMES)
        part = samples[low * HOP : (high - 1) * HOP + FRAME].astype(np.float64) - 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        inner = power[:, 1:-1]
        peak = (inner > power[:, :-2]) & (inner >= power[:, 2:])
        level = np.where(peak, np.round(inner, 3), -1.0)
        best = np.argsort(-level, axis=1, kind="stable")[:, :PEAKS]
        found.append(np.where(np.take_along_axis(level, best, 1) > 0, best + 1, -1))
    return np.concatenate(found) if found else np.zeros((0, PEAKS), np.int64)


def peak_pairs(peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of pairs of each peak with the strongest peaks of the AHEAD next frames, by time and code.

    A code is band << 16 | later band << 8 | frames between them.
    """
    times, codes = [], []
    for gap in range(1, AHEAD + 1):
        first, then = peaks[:-gap], peaks[gap:, :1]
        frame, k = np.nonzero((first > 0) & (then > 0))
        times.append(frame)
        codes.append(first[frame, k] << 16 | then[frame, 0] << 8 | gap)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


#: Bytes of texts and media that are held at a time; a larger one stands alone.
SLICE = 1 << 23


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, filled up to a positive multiple of UNIT, as a WAV file."""

    @tidied
    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for low, high in slices([len(x) for x in texts], SLICE):
                media = [to_wav(x + FILL * (-len(x) % UNIT if x else UNIT)) for x in texts[low:high]]
                sizes = pa.array([len(x) for x in texts[low:high]], pa.int64())
                yield pa.record_batch([batch.column(0)[low:high], sizes, pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FINGERPRINTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, peak_times array<int>, peak_codes array<int>"
)
DIGESTS = FINGERPRINTS.replace("peak_times array<int>, peak_codes array<int>", "feature string")
_KINDS = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _columns(rows: list[list], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.record_batch([pa.array(x, _KINDS[t]) for x, t in zip(zip(*rows), kinds)], names=names)


def media_features(stored: DataFrame) -> DataFrame:
    """What the stored WAV files hold, from their bytes, and their peak pairs as time-coded arrays.

    A frame of silence has no peaks. A null medium has nulls in all columns but doc_id and n_bytes.
    """

    @tidied
    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc_id, size, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                media = cell.as_py()
                if media is None:
                    rows.append([doc_id, size, *[None] * 7])
                    continue
                payload = from_wav(media)
                times, codes = peak_pairs(spectral_peaks(np.frombuffer(payload, np.uint8)))
                rows.append([doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), times, codes])
                held += len(media)
                if held > SLICE:
                    yield _columns(rows, FINGERPRINTS)
                    rows, held = [], 0
            if rows:
                yield _columns(rows, FINGERPRINTS)

    return stored.mapInArrow(run, FINGERPRINTS)


def digests(found: DataFrame) -> DataFrame:
    """The fingerprints with ``feature`` for their arrays: the pairs' number and the start of the arrays' SHA-256."""

    @tidied
    def run(batches):
        for batch in batches:
            features = []
            for times, codes in zip(batch.column(7), batch.column(8)):
                if not times.is_valid:
                    features.append(None)
                    continue
                said = hashlib.sha256(times.values.to_numpy().tobytes() + codes.values.to_numpy().tobytes())
                features.append(f"{len(times)}:{said.hexdigest()[:32]}")
            yield pa.record_batch([*batch.columns[:7], pa.array(features, pa.string())], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return found.mapInArrow(run, DIGESTS)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The media and their fingerprints, each a table in the shared folder."""
    stored = keep(store_texts(docs, id_col, text_col), "media")
    return stored, keep(media_features(stored), "fingerprints")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, and give digests and features of what is read back; no shuffle.

    A null text is an empty one: UNIT fill bytes. Null and repeated ids stay; other columns are ignored. Equal
    texts have equal features. Of a very long text the bytes, the medium and its arrays (up to nine pairs for 96
    bytes) are held at once; its spectrum is taken FRAMES frames at a time.
    """
    return digests(store_media(docs, id_col, text_col)[1])
