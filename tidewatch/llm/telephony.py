"""Telephony audio as media columns: mu-law, A-law and block ADPCM in WAV containers.

``store`` wraps a payload, byte for byte, as the samples (or ADPCM blocks) of a WAV file
in a binary column; ``decode`` parses the container, expands companded samples by lookup
table, decodes ADPCM blocks with numpy across all blocks of a batch at once, resamples
to ``rate`` and reports features (and, if asked, the resampled PCM itself).

A null payload counts as empty. Equal payloads give equal media and features. A stored
form that is no such WAV file is an error of that file and raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded, slices

SOURCE_RATE = 8000
BLOCK = 64
#: WAVE format tags (fixed values of the container format).
TAGS = {"adpcm": 0x11, "alaw": 6, "mulaw": 7}
CODECS = ("mulaw", "alaw", "adpcm")
#: IMA ADPCM index steps by code (fixed values of the format).
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
#: IMA ADPCM quantiser steps (fixed values of the format).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])


def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law code."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each A-law code."""
    a = np.arange(256) ^ 0x55
    seg, low = a >> 4 & 7, a & 15
    size = np.where(seg == 0, (low << 4) + 8, (low << 4) + 264 << np.maximum(seg - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (rows of bytes): sample by sample, but all blocks at once."""
    b = np.ascontiguousarray(blocks, np.uint8)
    value = b[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(b[:, 2].astype(np.int64), 88)
    codes = np.empty((len(b), 2 * (b.shape[1] - 4)), np.int64)
    codes[:, 0::2], codes[:, 1::2] = b[:, 4:] & 15, b[:, 4:] >> 4
    out = np.empty((len(b), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for i in range(codes.shape[1]):
        c, step = codes[:, i], STEPS[index]
        move = (step >> 3) + np.where(c & 1, step >> 2, 0) + np.where(c & 2, step >> 1, 0) + np.where(c & 4, step, 0)
        value = np.clip(np.where(c & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[c], 0, 88)
        out[:, i + 1] = value
    return out


def wav(payload: bytes, codec: str) -> bytes:
    """The payload as the data chunk of a mono WAV file."""
    per_block = 2 * (BLOCK - 4) + 1
    if codec == "adpcm":
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, SOURCE_RATE, SOURCE_RATE * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(payload) // BLOCK * per_block
    else:
        fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, SOURCE_RATE, SOURCE_RATE, 1, 8, 0)
        samples = len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, stored bytes) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next(k for k, v in TAGS.items() if v == tag)
        elif name == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == to or not len(pcm):
        return pcm
    n = len(pcm) * to // rate
    at = np.arange(n) * (rate / to)
    lo = at.astype(np.int64)
    a, b = pcm[lo].astype(np.float64), pcm[np.minimum(lo + 1, len(pcm) - 1)]
    return np.rint(a + (b - a) * (at - lo)).astype(np.int16)


def features(codec: str, pcm: np.ndarray, rate: int) -> str:
    """Duration, level, peak, zero crossings and a checksum of resampled PCM."""
    x = pcm.astype(np.float64)
    rms = float(np.sqrt((x * x).mean())) if len(x) else 0.0
    peak = int(np.abs(x).max(initial=0))
    flips = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    return f"{codec} rate={rate} samples={len(pcm)} ms={len(pcm) * 1000 // rate} rms={rms:.3f} peak={peak} crossings={flips} pcm_crc32={zlib.crc32(pcm.astype('<i2').tobytes())}"


def store(df: DataFrame, payload: str = "payload", codec: str = "codec") -> DataFrame:
    """Adds ``media``: the payload as a WAV file of the row's codec."""
    keep = [f for f in df.schema.fields if f.name not in (payload, "media")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["media binary"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, payload):
            media = [wav(bytes(p or b""), c) for p, c in zip(pdf[payload], pdf[codec])]
            yield pdf[[f.name for f in keep]].assign(media=media)

    return bounded(df).mapInPandas(run, schema)


def decode(df: DataFrame, rate: int = 16_000, pcm: bool = False) -> DataFrame:
    """Reads ``media``; adds payload digests, features and, if asked, ``pcm`` (16-bit, resampled)."""
    keep = [f for f in df.schema.fields if f.name != "media"]
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pcm binary" * pcm
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "media"):
            parsed = [unwav(bytes(m)) for m in pdf["media"]]
            blocks = [np.frombuffer(p, np.uint8).reshape(-1, BLOCK) for c, _, p in parsed if c == "adpcm"]
            ends = iter(np.cumsum([len(b) for b in blocks]))
            coded = adpcm(np.concatenate(blocks)) if blocks else None
            rows, at = [], 0
            for (c, had, p), m in zip(parsed, pdf["media"]):
                if c == "adpcm":
                    end = int(next(ends))
                    wave, at = coded[at:end].reshape(-1), end
                else:
                    wave = TABLES[c][np.frombuffer(p, np.uint8)]
                out = resample(wave, had, rate)
                row = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(c, out, rate))
                rows.append(row + ((out.astype("<i2").tobytes(),) if pcm else ()))
            names = [x.split()[0] for x in added.split(", ")]
            yield pd.concat([pdf[[f.name for f in keep]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return bounded(df).mapInPandas(run, schema)


def text_payload(docs: DataFrame, unit: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, codec, payload): UTF-8 text padded with bytes 0 to a positive multiple of ``unit``.

    The codec follows from the payload's checksum, so equal texts get equal media.
    """
    raw = F.encode("text", "UTF-8")
    n = F.octet_length("text").cast("long")
    full = (F.greatest(F.ceil(n / unit), F.lit(1)) * unit).cast("int")
    padded = F.concat(raw, F.unhex(F.repeat(F.lit("00"), (full - n).cast("int"))))
    codec = F.element_at(F.array(*map(F.lit, CODECS)), (F.crc32(raw) % len(CODECS) + 1).cast("int"))
    return docs.select("doc_id", n.alias("n_bytes"), codec.alias("codec"), padded.alias("payload"))
