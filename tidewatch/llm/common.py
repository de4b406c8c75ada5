"""What several of the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Characters of text that a worker looks at together.
SLICE = 1 << 20
#: Most bytes of an Arrow batch, so that a worker and its task hold few texts at once.
BATCH = 4 << 20
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: The bytes that part words: space and 9 to 13.
BREAKS = np.isin(np.arange(256), [32, *range(9, 14)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def words_of(text: str | None) -> list[str]:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``; other Unicode white space is part of a word."""
    # bytes are parted by these six alone, unlike characters
    return [w.decode() for w in text.encode().split()] if text else []


def lowered(text: str | None) -> bytes:
    """The text's UTF-8 with A-Z in lower case; no other character changes."""
    return (text or "").encode().lower()


def slices(batches: Iterator[pd.DataFrame], column: str = "text", size: int = SLICE) -> Iterator[pd.DataFrame]:
    """Consecutive rows of the batches, in frames that begin within ``size`` characters (or bytes) of ``column``."""
    for pdf in batches:
        n = np.fromiter((0 if x is None else len(x) for x in pdf[column]), np.int64, len(pdf))
        block = (np.cumsum(n) - n) // size
        cuts = (np.flatnonzero(np.diff(block)) + 1).tolist()
        if not cuts:
            if len(pdf):
                yield pdf
            continue
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            yield pdf.iloc[a:b].reset_index(drop=True)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH`` bytes: one value for all operators, and never raised."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    size = re.fullmatch(r"(\d+)([kmg]?)b?", conf.get(name).lower())
    if not size or int(size[1]) * 1024 ** "_kmg".index(size[2] or "_") > BATCH:
        conf.set(name, f"{BATCH}b")
    return df


def documents(df: DataFrame) -> DataFrame:
    """(doc_id, text) of a documents table; a null text counts as empty."""
    return bounded(df).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges ``[starts[i], starts[i] + lengths[i])``."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64; long ones are not kept."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = ODD[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = tuple(out)
        if size <= 4 * SLICE:
            _powers[which] = have
    return have[0][:n], have[1][:n]


def rolling(x: np.ndarray, size: int, which: int) -> np.ndarray:
    """Hash of each run of ``size`` values."""
    n = len(x)
    if n < size:
        return np.empty(0, U)
    up, down = powers(which, n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(x * up[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1])


#: A 64-bit value for each byte, so that a word's hash does not hang on small numbers.
_BYTES = mix(np.arange(1, 257).astype(U) * U(ODD[1]))


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts in order, words in each text)."""
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    gap = BREAKS[flat]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    begin = np.cumsum([0, *(len(b) + 1 for b in raw)])
    sizes = np.diff(np.searchsorted(starts, begin))
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        # blocks of whole words keep the powers short
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, side="right")))
        lo, hi = starts[at], ends[stop - 1]
        up, down = powers(0, int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(_BYTES[flat[lo:hi]] * up[: hi - lo], out=total[1:])
        out[at:stop] = mix((total[ends[at:stop] - lo] - total[starts[at:stop] - lo]) * down[starts[at:stop] - lo])
        at = stop
    return out, sizes


class Table:
    """Open-addressing map from 64-bit keys (any but the largest) to doubles, probed for whole arrays."""

    EMPTY = U(2**64 - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY)
        self.values = np.zeros(1 << self.bits)
        at, rest = self.home(keys), np.arange(len(keys))
        while len(rest):
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            # of several keys for one slot the last one written has it
            self.keys[at[free]] = keys[rest[free]]
            won = free[self.keys[at[free]] == keys[rest[free]]]
            self.values[at[won]] = values[rest[won]]
            left = np.ones(len(rest), bool)
            left[won] = False
            rest, at = rest[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(ODD[0])) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        at = self.home(keys)
        have = self.keys[at]
        out, found = self.values[at], have == keys
        rest = np.flatnonzero(~found & (have != self.EMPTY))
        at = at[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.bits) - 1)
            have = self.keys[at]
            hit = have == keys[rest]
            out[rest[hit]], found[rest[hit]] = self.values[at[hit]], True
            go = ~hit & (have != self.EMPTY)
            rest, at = rest[go], at[go]
        return out, found


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of the unit rows of ``x``; starts: the first row, then each time the row least like any start."""
    if not len(x):
        return np.zeros((k, x.shape[1]))
    at = [0]
    while len(at) < min(k, len(x)):
        at.append(int((x @ x[at].T).max(1).argmin()))
    centres = x[at]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        one = (own[:, None] == np.arange(len(centres))).astype(x.dtype)
        sums = one.T @ x
        sums = np.where(one.any(0)[:, None], sums, centres)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return np.vstack([centres, np.zeros((k - len(centres), x.shape[1]))])


def before(totals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``base``: the sum of ``value`` over the rows before each, in the order of ``keys``.

    ``totals`` has one row per written partition (and bucket), so the ordered window
    runs over as many rows as there are partitions, never over documents.
    """
    from pyspark.sql import Window

    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("base", F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
