"""Telephony audio columns.

mu-law and A-law samples expand by 256-entry look-up tables.  IMA ADPCM blocks
decode sample by sample *across* all blocks at once: the loop runs over the
samples of one block and each step is one numpy operation on every block.
What is decoded is resampled (linear interpolation) and stored as 16-bit PCM.

As a payload store, bytes are the 8-bit samples of a mu-law WAV file: lossless,
since every byte value is a sample.  Bytes are padded with zeros to a positive
multiple of 64.  A null text counts as empty.  Equal texts give equal values.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ship, table, text_buffers

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
RATE = 8000
UNIT = 64


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exp, man = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(exp == 0, man + 8, (man + 0x108) << np.maximum(exp - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()
_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
_TURN = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _ima_step(pred, index, code):
    """One sample of every block: new predictors and step indices."""
    step = _STEPS[index]
    diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    pred = np.clip(np.where(code & 8, pred - diff, pred + diff), -32768, 32767)
    return pred, np.clip(index + _TURN[code], 0, 88)


def ima_decode(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM blocks to 16-bit samples; a short last block counts too."""
    raw = np.frombuffer(data, np.uint8)
    whole = len(raw) // block
    out = [_ima_blocks(raw[: whole * block].reshape(whole, block)).reshape(-1)] if whole else []
    if len(raw) - whole * block >= 4:
        out.append(_ima_blocks(raw[whole * block :].reshape(1, -1)).reshape(-1))
    return np.concatenate(out) if out else np.zeros(0, np.int16)


def _ima_blocks(b: np.ndarray) -> np.ndarray:
    pred = b[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(b[:, 2], 88).astype(np.int32)
    body = b[:, 4:]
    codes = np.empty((len(b), body.shape[1] * 2), np.int32)
    codes[:, 0::2], codes[:, 1::2] = body & 0x0F, body >> 4
    out = np.empty((len(b), 1 + codes.shape[1]), np.int16)
    out[:, 0] = pred
    for i in range(codes.shape[1]):
        pred, index = _ima_step(pred, index, codes[:, i])
        out[:, i + 1] = pred
    return out


def ima_encode(samples: np.ndarray, block: int) -> bytes:
    """16-bit samples to mono IMA ADPCM blocks, across blocks; the last is padded with its last sample."""
    each = (block - 4) * 2 + 1
    n = -(-len(samples) // each)
    if n == 0:
        return b""
    x = np.concatenate([samples, np.repeat(samples[-1:], n * each - len(samples))]).astype(np.int32).reshape(n, each)
    pred, index = x[:, 0].copy(), np.zeros(n, np.int32)
    codes = np.zeros((n, each - 1), np.uint8)
    for i in range(each - 1):
        gap, step = x[:, i + 1] - pred, _STEPS[index]
        code = np.where(gap < 0, 8, 0)
        gap = np.abs(gap)
        for bit in (4, 2, 1):
            take = gap >= step
            code |= np.where(take, bit, 0)
            gap = np.where(take, gap - step, gap)
            step = step >> 1
        codes[:, i] = code
        pred, index = _ima_step(pred, index, code)
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    out[:, 4:] = codes[:, 0::2] | codes[:, 1::2] << 4
    return out.tobytes()


def write_wav(tag: int, body: bytes, rate: int = RATE, block: int = 1) -> bytes:
    bits = {PCM: 16, IMA: 4}.get(tag, 8)
    align = {PCM: 2, IMA: block}.get(tag, 1)
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * align, align, bits, 0)
    pad = b"\0" * (len(body) % 2)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body + pad
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format tag, rate, block size, stored bytes)."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(view):
        name, (size,) = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data" and fmt:
            if fmt[1] != 1:
                raise ValueError("more than one channel")
            return fmt[0], fmt[2], fmt[4], view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """(16-bit samples, rate) of a mono WAV: PCM, A-law, mu-law or IMA ADPCM."""
    tag, rate, block, body = read_wav(media)
    if tag == IMA:
        return ima_decode(bytes(body), block), rate
    if tag == PCM:
        return np.frombuffer(body, "<i2", len(body) // 2), rate
    if tag not in (ALAW, MULAW):
        raise ValueError(f"format {tag}")
    return (MULAW_TABLE if tag == MULAW else ALAW_TABLE)[np.frombuffer(body, np.uint8)], rate


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers: the same bits everywhere."""
    if not len(x) or rate == to:
        return x.astype(np.int16)
    n = -(-len(x) * to // rate)
    at = np.arange(n, dtype=np.int64) * rate
    i = at // to
    wide = np.append(x, x[-1]).astype(np.int64)
    return (wide[i] + (wide[i + 1] - wide[i]) * (at - i * to) // to).astype(np.int16)


def transcode(media: bytes, to: int = 16000) -> bytes:
    """Any supported WAV as resampled 16-bit PCM."""
    x, rate = decode(media)
    return write_wav(PCM, resample(x, rate, to).astype("<i2").tobytes(), to)


def store(payload: bytes) -> bytes:
    """Bytes as the samples of a mu-law WAV."""
    return write_wav(MULAW, payload)


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def feature(media: bytes, to: int = 16000) -> str:
    """Whole-number features: rate, samples, peak, mean size, sign changes, checksum of the resampled PCM."""
    x, rate = decode(media)
    size = np.abs(x.astype(np.int32))
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    pcm = resample(x, rate, to)
    return f"mulaw:{rate}:{len(x)}:{int(size.max())}:{int(size.sum()) // len(x)}:{turns}:{zlib.crc32(pcm.astype('<i2')):08x}"


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_OUT_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = text_buffers(b.column(1))
        rows = []
        for d, s, e in zip(b.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
            media = store(padded(data[s:e].tobytes()))
            back = read_wav(media)[3]
            rows.append((d, e - s, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(media)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)] if rows else [pa.array([], f.type) for f in _OUT], schema=_OUT)


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = text_buffers(b.column(1))
        media = [store(padded(data[s:e].tobytes())) for s, e in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (before padding) and the text stored as mu-law WAV."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(lean(_media), "doc_id long, n_bytes long, media binary")


def transcode_column(df: DataFrame, media_col: str = "media", out_col: str = "pcm", rate: int = 16000) -> DataFrame:
    """Adds a WAV column transcoded to resampled PCM; what isn't such audio gives null."""
    ship(df.sparkSession)

    def one(media):
        if media is None:
            return None
        try:
            return transcode(bytes(media), rate)
        except (ValueError, struct.error):
            return None

    @F.pandas_udf("binary")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(one)

    return df.withColumn(out_col, convert(F.col(f"`{media_col}`")))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as telephony audio, read back, and described."""
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(lean(_digests), _OUT_SQL)

