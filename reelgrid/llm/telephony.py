"""Telephony audio columns: mu-law, A-law and IMA ADPCM bytes to 16-bit PCM, resampled.

Laws expand by lookup tables of 256 entries. ADPCM blocks are independent, so numpy decodes one
sample position of all blocks of a batch at a time. Media are WAV bytes, whose format code says
how to read the samples. Work is by row within Arrow batches: nothing is shuffled or collected.

A null text is stored as an empty one. Texts of any length are stored whole; equal texts give
equal media. Extra columns of the input are left out of the query's result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm.bpe import batches_of
from reelgrid.llm.tables import documents, schema_with

# WAV format codes.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
RATE, STORED_RATE, BLOCK = 8000, 16000, 64
# IMA ADPCM step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


@functools.cache
def law_table(law: int) -> np.ndarray:
    """16-bit values of the 256 codes."""
    code = np.arange(256, dtype=np.int32)
    if law == MU_LAW:
        code = ~code & 255
        size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
        return np.where(code & 128, -size, size).astype("<i2")
    code ^= 0x55
    part, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype("<i2")


def decode_adpcm(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """PCM of whole blocks, a row each: the header's sample, then two samples a byte, low half first.

    Bytes after the last whole block are left; an index over the table's end counts as its last.
    """
    blocks = data[: len(data) // block * block].reshape(-1, block)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out = np.empty((1 + 2 * (block - 4), len(blocks)), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k, column in enumerate(codes):
        for half, code in enumerate((column & 15, column >> 4)):
            step = STEPS[index]
            change = step >> 3
            change += np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1)
            out[1 + 2 * k + half] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """In whole numbers: linear interpolation, the last sample held; to a lower rate, means over each new sample's time."""
    if rate == to or not len(pcm):
        return pcm.astype("<i2")
    if to < rate:
        sums = np.concatenate(([0], np.cumsum(pcm, dtype=np.int64), [0]))
        at = np.arange(len(pcm) * to // rate + 1, dtype=np.int64) * rate
        i, part = at // to, at % to
        until = sums[i] * to + np.append(pcm, 0).astype(np.int64)[i] * part
        return (np.diff(until) // rate).astype("<i2")
    x = np.append(pcm, pcm[-1]).astype(np.int64)
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    i, part = at // to, at % to
    return ((x[i] * (to - part) + x[i + 1] * part) // to).astype("<i2")


def wav(samples: bytes, code: int, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono WAV file: samples are stored as they are."""
    bits, align = {PCM: (16, 2), IMA_ADPCM: (4, block)}.get(code, (8, 1))
    speed = rate * align if code != IMA_ADPCM else rate * block // (1 + 2 * (block - 4))
    form = struct.pack("<HHIIHHH", code, 1, rate, speed, align, bits, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format code, rate, block size, stored samples)."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("a WAV file needs fmt and data")
    return form[0], form[2], form[4], data


def expand(code: int, samples: bytes, block: int = BLOCK) -> np.ndarray:
    data = np.frombuffer(samples, np.uint8)
    if code == PCM:
        return data.view("<i2")
    return decode_adpcm(data, block).ravel() if code == IMA_ADPCM else law_table(code)[data]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % BLOCK if raw else BLOCK)


def store(docs: DataFrame, code: int = MU_LAW) -> DataFrame:
    """doc_id, n_bytes and media: each text's padded bytes as the samples of a WAV file of that code."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, "text"):
                made = [payload_of(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([wav(p, code) for _, p in made], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def to_pcm(media: DataFrame, column: str = "media", rate: int = STORED_RATE) -> DataFrame:
    """media with column pcm: 16-bit little-endian samples at that rate. Null media give null."""
    keep = media.drop("pcm")
    schema = schema_with(keep, pcm="binary")

    def pcm(x: bytes | None) -> bytes | None:
        if x is None:
            return None
        code, had, block, samples = read_wav(x)
        return resample(expand(code, samples, block), had, rate).tobytes()

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, column):
                made = [pcm(x) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[f.name for f in schema])

    return keep.mapInArrow(run, schema)


def loudness(pcm: np.ndarray) -> str:
    """Root mean square, peak and zero crossings, in whole numbers."""
    wide = pcm.astype(np.int64)
    return f"{math.isqrt(int(np.dot(wide, wide)) // len(wide))},{int(np.abs(wide).max())},{int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))}"


FEATURES = "doc_id {}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"


def features(media: DataFrame) -> DataFrame:
    """Digests of what is stored and read back, and features of it under both laws, as ADPCM blocks and of its PCM, resampled
    and stored as a WAV file too, which is read back as well.

    One stage does both, since PCM is four times as large and would grow the batches between stages.
    """
    schema = FEATURES.format(media.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for whole in batches:
            for b in batches_of(whole, "media"):
                stored = b.column(2).to_pylist()
                read = [read_wav(m) for m in stored]
                blocks = decode_adpcm(np.frombuffer(b"".join(r[3] for r in read), np.uint8))  # of all rows at once
                rows, at = [], 0
                for m, (code, rate, _, payload) in zip(stored, read, strict=True):
                    n = len(payload) // BLOCK
                    adpcm, at = blocks[at : at + n].ravel(), at + n
                    mu, a = expand(MU_LAW, payload), expand(A_LAW, payload)
                    pcm = wav(resample(mu if code == MU_LAW else a, rate, STORED_RATE).tobytes(), PCM, STORED_RATE)
                    kept = read_wav(pcm)[3]
                    feature = f"mulaw={loudness(mu)};alaw={loudness(a)};adpcm={loudness(adpcm)},{zlib.crc32(adpcm.tobytes())};pcm16k={len(kept) // 2},{zlib.crc32(kept)}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, len(pcm), hashlib.sha256(pcm).hexdigest()))
                cols = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as mu-law samples and resampled PCM, read back, with features."""
    return features(store(documents(spark, sf_dir)))


QUERIES = {"op1_telephony": op1_telephony}
ORACLES: dict[str, str] = {}
