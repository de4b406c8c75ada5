"""Vector code compression: product codes with codebooks learned by k-means over integer vectors.

A component x becomes floor(scale * x). A vector is cut into equal consecutive parts (filled
up with zeros where the length is no multiple), each part coded by its nearest codebook entry.
The nearest entry is found by slicing and intersecting: for each position the entries'
coordinates are sorted, and the i-th mask of a position has a bit for each of the first i
entries. A first radius, a part of the coordinates' spread, selects a range of each position;
two masks give the entries in that range, and the masks of all positions ANDed give the
candidates. Where there is none the radius is doubled, never beyond the distance to the best
of a few guesses; where there are some, their exact distances give the radius that holds
everything as near, and its candidates settle the nearest, ties to the lower index.

Learning runs in rounds over the whole table: tasks assign their rows against the broadcast
codebooks (``parts * entries`` short vectors, whatever the input) and sum them by entry; Spark
adds the sums, and only the sums of the entries come to the driver.

Integers of any size are exact: arrays of Python integers replace those of 64 bits where
squares could leave them, and sums travel in digits of 40 bits. An error that no long holds
is null, and so is a label's sum with such an error.

Dropped: vectors that are null, or hold a null or non-finite component, or have another length
than the vector of the smallest vec_id. A null vec_id is coded too, and comes last among the
ids; of rows with one vec_id the smaller vector comes first. Repeated rows are coded each and
count each. Extra columns are ignored; an empty table has empty codebooks and gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded
from tidewatch.session import stored

#: Bits of a digit in which sums travel.
DIGIT = 40
#: Positions whose nearest coordinates serve as guesses.
GUESSES = 4
#: Rows whose masks are in memory together.
ROWS = 8192
LONG = 1 << 63


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows whose vector is whole and finite, as doubles; label is null where the table has none."""
    x = F.col("embedding").cast("array<double>")
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return bounded(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("v")).where(F.col("v").isNotNull() & ~bad)


def scaled(v: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """floor(scale * v) of rows of doubles, filled up to a multiple of ``parts``; Python integers where they are large."""
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % parts)))
    if not v.size or np.abs(v).max() < 2**40 / scale:
        return np.floor(v * scale).astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < 2**900 / scale else int(x) * scale for x in v.ravel().tolist()]
    return np.array(exact, object).reshape(v.shape)


def roots(squares: np.ndarray) -> np.ndarray:
    """Radii that hold the squared distances, for 64-bit integers at most one too wide."""
    if squares.dtype == object:
        return np.array([math.isqrt(x) for x in squares.tolist()], object)
    return np.sqrt(squares.astype(float)).astype(np.int64) + 1


class Slices:
    """One part's codebook (entries by positions) with its sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray) -> None:
        n, width = entries.shape
        self.entries, self.order = entries, np.argsort(entries, axis=0, kind="stable").T
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries.T, self.order, 1)) if entries.dtype != object else np.array([entries[o, d] for d, o in enumerate(self.order)], object).reshape(width, n)
        words = -(-n // 64)
        bits = np.zeros((n, words), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.prefix = np.zeros((width, n + 1, words), np.uint64)
        for d in range(width):
            np.bitwise_or.accumulate(bits[self.order[d]], axis=0, out=self.prefix[d, 1:])
        spread = self.sorted[:, (9 * n) // 10 if n > 1 else 0] - self.sorted[:, n // 10] if width and n else np.zeros(1, np.int64)
        self.start = max(1, int(min(spread)) // 8)
        self.looked = self.candidates = 0

    def first(self, x: np.ndarray) -> np.ndarray:
        """Each row's smallest squared distance to some entries: those with the nearest coordinates at a few positions."""
        n, width = self.entries.shape
        best = None
        for d in range(0, width, max(1, width // GUESSES)):
            at = np.minimum(np.searchsorted(self.sorted[d], x[:, d]), n - 1)
            gap = x - self.entries[self.order[d][at]]
            far = (gap * gap).sum(1)
            best = far if best is None else np.minimum(best, far)
        return best if best is not None else np.zeros(len(x), np.int64)

    def masks(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Bits of the entries that lie within the radius at every position."""
        n, width = self.entries.shape
        out = np.broadcast_to(np.bitwise_or.reduce(self.prefix[:, -1], axis=0) if width else np.array([1], np.uint64), (len(x), self.prefix.shape[2] if width else 1)).copy()
        for d in range(width):
            lo = np.searchsorted(self.sorted[d], x[:, d] - radius, "left")
            hi = np.searchsorted(self.sorted[d], x[:, d] + radius, "right")
            out &= self.prefix[d, hi] & ~self.prefix[d, lo]
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row."""
        found = [self._nearest(x[a : a + ROWS]) for a in range(0, len(x), ROWS)]
        return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bound, code, rest = self.first(x), np.zeros(len(x), np.int64), np.arange(len(x))
        radius = np.minimum(self.start, roots(bound))
        self.looked += len(x)
        while len(rest):
            row, entry = np.nonzero(np.unpackbits(self.masks(x[rest], radius[rest]).astype("<u8").view(np.uint8), axis=1, bitorder="little"))
            self.candidates += len(row)
            gap = x[rest[row]] - self.entries[entry]
            far = (gap * gap).sum(1)
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            have = rest[row[begin]]
            least = np.minimum.reduceat(far, begin) if len(begin) else far
            bound[have] = np.minimum(bound[have], least)
            # entries rise within a row, so the first that is as near as the least one is the lowest
            hit = np.flatnonzero(far == np.repeat(least, np.diff([*begin, len(row)])))
            code[have] = entry[hit[np.unique(row[hit], return_index=True)[1]]]
            need = roots(bound)
            seen = np.zeros(len(x), bool)
            seen[have] = True
            # a radius that reaches the best distance so far has seen all that could be nearer
            late = radius[rest] < need[rest]
            radius = np.where(seen, need, np.minimum(radius * 2, need))
            rest = rest[late | ~seen[rest]]
        return code, bound


class Codebooks:
    """Entries of every part: an array (parts, entries, width), and what they were made with."""

    def __init__(self, entries: np.ndarray, length: int, scale: int) -> None:
        self.entries, self.length, self.scale = entries, length, scale

    def slices(self, x: np.ndarray) -> tuple[np.ndarray, list[Slices]]:
        """Rows by part, and the parts' slices, both of 64-bit integers where no square sum leaves them."""
        parts, _, width = self.entries.shape
        x = x.reshape(len(x), parts, width)
        top = max((int(abs(a).max()) for a in (x, self.entries) if a.size), default=0)
        kind = np.int64 if width * (2 * top + 2) ** 2 < LONG else object
        return x.astype(kind), [Slices(e) for e in self.entries.astype(kind)]

    def rows(self, pdf: pd.DataFrame) -> np.ndarray:
        v = np.array(pdf["v"].tolist(), float).reshape(len(pdf), self.length)
        return scaled(v, self.scale, len(self.entries))

    def decode(self, code: str) -> list[int]:
        """The entries that a code names, joined."""
        size = len(code) // len(self.entries)
        return [int(x) for p, e in enumerate(self.entries) for x in e[int(code[p * size : (p + 1) * size], 16)]][: self.length]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks of ``entries`` each, begun with the parts of the smallest vec_ids and moved ``rounds`` times to their rows' floored means."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows, by_id = kept(vectors), [F.col("vec_id").asc_nulls_last(), F.col("v")]
    smallest = rows.orderBy(*by_id).first()
    length = len(smallest.v) if smallest else 0
    first = [r.v for r in rows.where(F.size("v") == length).orderBy(*by_id).limit(entries).collect()]
    begun = scaled(np.array(first, float).reshape(len(first), length), scale, parts)
    books = Codebooks(begun.reshape(len(first), parts, begun.shape[1] // parts).transpose(1, 0, 2), length, scale)
    for _ in range(rounds if first else 0):
        books = moved(rows, books)
    return books


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: entries that have rows become the floored means of these."""
    parts, n, width = books.entries.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((parts, n, width), object), np.zeros((parts, n), np.int64)
        for pdf in batches:
            x, tables = books.slices(books.rows(pdf))
            for p, table in enumerate(tables):
                own, _ = table.nearest(x[:, p])
                count[p] += np.bincount(own, minlength=n)
                got = np.zeros((n, width), x.dtype)
                np.add.at(got, own, x[:, p])
                total[p] += got.astype(object)
        keys, digits, values = [], [], []
        for i, x in enumerate(np.concatenate([count[:, :, None].astype(object), total], axis=2).ravel().tolist()):
            digit, sign, x = 0, (1 if x >= 0 else -1), abs(x)
            while x:
                keys.append(i)
                digits.append(digit)
                values.append(sign * (x & ((1 << DIGIT) - 1)))
                digit, x = digit + 1, x >> DIGIT
        yield pd.DataFrame({"at": keys, "digit": digits, "value": values}, dtype="int64")

    own = rows.where(F.size("v") == books.length).mapInPandas(sums, "at long, digit long, value long")
    added = np.zeros(parts * n * (width + 1), object)
    for r in own.groupBy("at", "digit").agg(F.sum("value").alias("value")).collect():
        added[r.at] += r.value << (DIGIT * r.digit)
    added = added.reshape(parts, n, width + 1)
    entries = books.entries.astype(object)
    for p, e in zip(*np.nonzero(added[:, :, 0])):
        entries[p, e] = added[p, e, 1:] // added[p, e, 0]
    return Codebooks(entries, books.length, books.scale)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error (null beyond a long) of every kept vector of the codebooks' length."""

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, tables = books.slices(books.rows(pdf))
            found = [t.nearest(x[:, p]) for p, t in enumerate(tables)]
            code = ["".join(f"{c:02x}" for c in row) for row in zip(*(c.tolist() for c, _ in found))]
            error = [sum(row) for row in zip(*(e.tolist() for _, e in found))]
            out = pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "code": code})
            yield out.assign(error=pd.array([e if e < LONG else None for e in error], "Int64"))

    # ids go to Python as strings: beside a null, numbers would be doubles there
    rows = kept(vectors).where(F.size("v") == books.length).withColumn("vec_id", F.col("vec_id").cast("string"))
    return rows.mapInPandas(codes, "vec_id string, label string, code string, error long").withColumn("vec_id", F.col("vec_id").cast("long"))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over the rows of equal labels; null labels are one group."""
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when((F.count("error") == F.count("*")) & (exact < F.lit(str(LONG)).cast("decimal(38,0)")), exact.cast("long"))
    each = coded.groupBy(F.col("label").alias("its")).agg(whole.alias("label_error"))
    return coded.join(each, F.col("label").eqNullSafe(F.col("its"))).drop("its")


def compress(vectors: DataFrame, **options: int) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    books = fit(vectors, **options)
    coded = stored(encode(vectors, books), "codes")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
