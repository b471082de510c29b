"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM decoded across blocks, resampled PCM.

A media column holds WAV files (8000 Hz, one channel): mu-law or A-law (one byte a sample) or 4-bit IMA ADPCM (blocks of
``BLOCK`` bytes). Writing and reading keep the stored samples byte for byte. Decoding gives 16-bit PCM: by a table of 256
entries for the laws; for ADPCM all blocks of all clips of a batch are decoded at once, nibble by nibble, since blocks
don't depend on each other. PCM is resampled by linear interpolation in integer arithmetic and stored as a PCM WAV.

Defined results for odd input: a null text is the empty one; a payload is padded with bytes 0 to a positive multiple of
64, so the empty text is one block of zeros; equal texts give equal files and features; bytes that aren't a WAV file of
these three kinds raise ValueError; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of

RATE, BLOCK = 8000, 64
#: WAV format codes.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
#: Clips of a batch are decoded together up to so many bytes.
TOGETHER = 4 << 20


def mulaw_table() -> np.ndarray:
    """16-bit PCM of each mu-law byte (G.711): inverted bits; sign, 3 bits of exponent, 4 of mantissa; bias 132."""
    u = ~np.arange(256, dtype=np.uint8) & 0xFF
    size = ((((u & 15).astype(np.int32) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of each A-law byte (G.711): every other bit inverted; exponent 0 is linear."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    mantissa, exponent = ((a & 15) << 4) + 8, (a >> 4) & 7
    size = np.where(exponent > 0, (mantissa + 256) << np.maximum(exponent - 1, 0), mantissa)
    return np.where(a & 128, size, -size).astype(np.int16)


# The step sizes and index moves of IMA ADPCM.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
        1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
        8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """16-bit PCM of blocks (n, bytes): a 16-bit first sample, a step index (clipped to 0-88), a spare byte, then nibbles, low first."""
    n = len(blocks)
    first = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)
    value = np.where(first > 32767, first - 65536, first).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(data), n), np.int16)
    out[0] = value
    for i, byte in enumerate(data):
        for k, nibble in enumerate((byte & 15, byte >> 4)):
            code = nibble.astype(np.int32)
            step = STEPS[index]
            size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - size, value + size), -32768, 32767)
            index = np.clip(index + MOVES[code & 7], 0, len(STEPS) - 1)
            out[1 + 2 * i + k] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the times of the new rate; whole numbers, rounded down."""
    if not len(pcm):
        return pcm
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    i, part = at // to, at % to
    a, b = pcm[i].astype(np.int64), pcm[np.minimum(i + 1, len(pcm) - 1)].astype(np.int64)
    return ((a * (to - part) + b * part) // to).astype(np.int16)


def wav(form: int, data: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel around stored samples."""
    bits, align = {PCM: (16, 2), ALAW: (8, 1), MULAW: (8, 1), IMA: (4, BLOCK)}[form]
    more = struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1) if form == IMA else b""
    second = rate * BLOCK // (2 * (BLOCK - 4) + 1) if form == IMA else rate * align
    head = struct.pack("<HHIIHH", form, 1, rate, second, align, bits) + more
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """(format, rate, stored samples) of a WAV file that :func:`wav` could have made."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            if form not in (PCM, ALAW, MULAW, IMA):
                raise ValueError(f"format {form} is not read")
            return form, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode(clips: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(rate, 16-bit PCM) of each WAV file; the blocks of all ADPCM clips are decoded together."""
    read = [read_wav(c) for c in clips]
    out: list[tuple[int, np.ndarray] | None] = [None] * len(clips)
    blocks = []
    for i, (form, rate, data) in enumerate(read):
        if form == IMA:
            blocks.append((i, rate, np.frombuffer(data, np.uint8)[: len(data) // BLOCK * BLOCK].reshape(-1, BLOCK)))
        elif form == PCM:
            out[i] = rate, np.frombuffer(data, "<i2").astype(np.int16)
        else:
            out[i] = rate, TABLES[form][np.frombuffer(data, np.uint8)]
    if blocks:
        pcm, at = ima_decode(np.concatenate([b for _, _, b in blocks])), 0
        for i, rate, b in blocks:
            out[i] = rate, pcm[at : at + len(b)].reshape(-1)
            at += len(b)
    return out


def padded(text: bytes, unit: int = BLOCK) -> bytes:
    return text + b"\0" * (max(1, -(-len(text) // unit)) * unit - len(text))


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with the bytes of their rows, about TOGETHER at once."""
    rows = batch.column(column).cast(pa.binary()).to_pylist()
    start, held = 0, 0
    for i, row in enumerate(rows):
        held += len(row or b"")
        if held >= TOGETHER or i + 1 == len(rows):
            yield batch.slice(start, i + 1 - start), rows[start : i + 1]
            start, held = i + 1, 0


def store(docs: DataFrame, form: int = MULAW) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes as the stored samples of a WAV file of ``form``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _runs(batch, "text"):
                media = pa.array([wav(form, padded(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _resampled(pcm: np.ndarray, rate: int, to: int) -> bytes:
    """A WAV file of 16-bit PCM at the rate ``to``."""
    return wav(PCM, resample(pcm, rate, to).astype("<i2").tobytes(), to)


def resampled(media: DataFrame, rate: int = 16000, to: str = "media") -> DataFrame:
    """``media`` (a table with a column media of WAV files) with ``to``: 16-bit PCM at ``rate`` as a WAV file, null where media is null; other columns pass."""
    names = [*[c for c in media.columns if c != to], to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, clips in _runs(batch, "media"):
                there = [i for i, c in enumerate(clips) if c is not None]
                files: list[bytes | None] = [None] * len(clips)
                for i, (r, pcm) in zip(there, decode([clips[i] for i in there]), strict=True):
                    files[i] = _resampled(pcm, r, rate)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:-1]], pa.array(files, pa.binary())], names)

    kept = media if to == "media" else media.withColumn(to, F.lit(None).cast("binary"))
    return media.mapInArrow(run, kept.select(*names).schema)


def features(pcm: np.ndarray) -> str:
    """Samples, peak, root mean square (rounded down), sign changes."""
    x = pcm.astype(np.int64)
    if not len(x):
        return "n=0"
    power = int(np.dot(x, x)) // len(x)
    return f"n={len(x)};peak={int(np.abs(x).max())};rms={int(power ** 0.5)};zc={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def described(media: DataFrame, rate: int = 16000) -> DataFrame:
    """For (doc_id, n_bytes, media): the stored samples read back, their digests, and features of what they decode to.

    Features: of the clip as stored, of the same bytes read as A-law, mu-law and ADPCM, and size and CRC-32 of the PCM of its
    resampled WAV file, as :func:`resampled` makes it. These files live only as long as a part of a batch: they are several
    times the input.
    """
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, clips in _runs(batch, "media"):
                read = [read_wav(c) for c in clips]
                adpcm = decode([wav(IMA, data) for _, _, data in read])
                rows = []
                for clip, (_, _, data), (r, pcm), (_, coded) in zip(clips, read, decode(clips), adpcm, strict=True):
                    other, samples = TABLES[ALAW][np.frombuffer(data, np.uint8)], read_wav(_resampled(pcm, r, rate))[2]
                    text = f"stored:{features(pcm)}|alaw:{features(other)}|adpcm:{features(coded)}|pcm{rate}:n={len(samples) // 2};crc={zlib.crc32(samples)}"
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(clip), hashlib.sha256(clip).hexdigest(), text))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *cols], [k.split()[0] for k in kinds.split(", ")])

    return media.mapInArrow(run, kinds)


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as a mu-law WAV, read back and described."""
    return described(store(documents(spark, sf_dir)))
