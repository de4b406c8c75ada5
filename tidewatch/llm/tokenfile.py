"""Token-id shards with a minimal-perfect-hash index.

``write`` deals documents by ascending doc_id, encodes them and writes a Parquet table of
shards: raw little-endian id payloads of about ``shard_bytes``, each with a minimal
perfect hash from document key to slot, and per slot a stored fingerprint, offset and
length, so that a keyed access costs one displacement, one slot and one fingerprint
check. Shards also list their keys in order, for scans. Spark's own writer commits the
files, so a lost executor or a second attempt leaves no half-written shard.

``read_all`` returns every document from the files through the index; ``lookup`` answers
given keys, routed to shards by the key ranges of the written partitions.

Nulls: a null text counts as empty; a null doc_id is a key of its own that comes first
and can be looked up. Rows that repeat a doc_id keep their own entry (key, occurrence in
the shard) and may go on in the next shards, so no shard outgrows its size by more than
one document; ``lookup`` returns each.
Unknown keys return no row. Extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import before, bounded, documents, slices
from tidewatch.llm.tokens import encoder
from tidewatch.session import scratch

SHARD_SCHEMA = "part int, seq int, first_id long, last_id long, local_start long, n_tokens long, width int, keys binary, nulls int, seeds binary, prints binary, offsets binary, lengths binary, payload binary"


def key_hash(key: int | None, occurrence: int) -> tuple[int, int]:
    """Two independent hashes of a document key."""
    raw = struct.pack("<?qq", key is None, key or 0, occurrence)
    return xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)


def slot_of(h: int, seed: int, n: int) -> int:
    return ((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 29 & 0xFFFFFFFF) % n


def perfect_hash(hashes: list[int]) -> np.ndarray:
    """Seeds by bucket so that ``slot_of`` maps the n distinct hashes one to one to 0..n-1."""
    n = len(hashes)
    buckets: dict[int, list[int]] = {}
    for h in hashes:
        buckets.setdefault(h % max(1, n // 3), []).append(h)
    seeds, free = np.zeros(max(1, n // 3), "<u4"), bytearray(b"\1" * n)
    for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
        seed = 0
        while True:
            slots = [slot_of(h, seed, n) for h in members]
            if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                break
            seed += 1
        seeds[b] = seed
        for s in slots:
            free[s] = 0
    return seeds


class ShardIndex:
    """Constant-time keyed access to one shard."""

    def __init__(self, row) -> None:
        self.seeds, self.prints = np.frombuffer(row.seeds, "<u4"), np.frombuffer(row.prints, "<u4")
        self.offsets, self.lengths = np.frombuffer(row.offsets, "<u8"), np.frombuffer(row.lengths, "<u8")
        self.payload, self.dtype = row.payload, "<u2" if row.width == 2 else "<u4"

    def find(self, key: int | None, occurrence: int = 0) -> tuple[int, np.ndarray] | None:
        """(offset, ids) of a key, or None where the stored fingerprint differs."""
        h, check = key_hash(key, occurrence)
        n = len(self.prints)
        s = slot_of(h, int(self.seeds[h % len(self.seeds)]), n)
        if int(self.prints[s]) != check & 0xFFFFFFFF:
            return None
        at, n = int(self.offsets[s]), int(self.lengths[s])
        w = np.dtype(self.dtype).itemsize
        return at, np.frombuffer(self.payload, self.dtype, n, at * w)


def shard_row(part: int, seq: int, start: int, keys: list, ids: list[bytes], width: int) -> tuple:
    """One shard of consecutive documents; ids as unsigned 32-bit bytes."""
    counts = np.array([len(b) // 4 for b in ids], np.uint64)
    offsets = np.cumsum(counts) - counts
    seen: dict = {}
    hashes = []
    for k in keys:
        seen[k] = seen.get(k, -1) + 1
        hashes.append(key_hash(k, seen[k]))
    seeds = perfect_hash([h for h, _ in hashes])
    n = len(keys)
    prints, at, size = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
    for i, (h, check) in enumerate(hashes):
        s = slot_of(h, int(seeds[h % len(seeds)]), n)
        prints[s], at[s], size[s] = check & 0xFFFFFFFF, offsets[i], counts[i]
    flat = np.frombuffer(b"".join(ids), "<u4")
    known = [k for k in keys if k is not None]
    payload = (flat.astype("<u2") if width == 2 else flat).tobytes()
    return (part, seq, known[0] if known else None, known[-1] if known else None, start, len(flat), width, np.array(known, "<i8").tobytes(), n - len(known), seeds.tobytes(), prints.tobytes(), at.tobytes(), size.tobytes(), payload)


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_bytes: int = 2 << 20, path: str | None = None) -> DataFrame:
    """Writes the shards of ``docs`` and returns them as read back from the files.

    ``tokenizer``: a tokenizer file, at the same place on every worker.
    """
    spark = docs.sparkSession
    # the beginning and hash of the text part rows that repeat a doc_id over several partitions
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32), F.xxhash64("text")]
    ordered = documents(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        width = 4 if enc.wide else 2
        part, seq, start, size = TaskContext.get().partitionId(), 0, 0, 0
        keys: list = []
        ids: list[bytes] = []
        names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]

        def flush() -> pd.DataFrame:
            return pd.DataFrame([shard_row(part, seq, start, keys, ids, width)], columns=names).astype({"first_id": "Int64", "last_id": "Int64"})

        for pdf in slices(batches):
            for k, b in zip(pdf["doc_id"].astype("Int64"), enc.batch(list(pdf["text"]))):
                key = None if k is pd.NA else int(k)
                if size >= shard_bytes:
                    yield flush()
                    seq, start = seq + 1, start + sum(map(len, ids)) // 4
                    keys, ids, size = [], [], 0
                keys.append(key)
                ids.append(b + end)
                size += len(b) // 4 * width
        if keys:
            yield flush()

    path = path or scratch(spark, "token-shards")
    ordered.mapInPandas(run, SHARD_SCHEMA).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _answers(row, wanted: list[tuple]) -> list[tuple]:
    index, out = ShardIndex(row), []
    for key, occurrence in wanted:
        hit = index.find(key, occurrence)
        if hit is not None:
            at, ids = hit
            out.append((key, row.base + row.local_start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype("<u4").tobytes()))
    return out


def _with_base(shards: DataFrame) -> DataFrame:
    totals = before(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")), ["part"], "n")
    return shards.join(F.broadcast(totals.select("part", "base")), "part")


def _read(shards: DataFrame, wanted, ids: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                out = pd.DataFrame(_answers(row, wanted(row)), columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})
                yield out if ids else out.drop(columns="ids")

    return bounded(shards).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def read_all(shards: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every stored document, through the index."""

    def wanted(row) -> list[tuple]:
        seen: dict = {}
        out = []
        for k in [None] * row.nulls + np.frombuffer(row.keys, "<i8").tolist():
            seen[k] = seen.get(k, -1) + 1
            out.append((k, seen[k]))
        return out

    return _read(_with_base(shards), wanted, ids)


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents of the given ``doc_id`` keys, with ids.

    The driver learns the key range of each written partition (one row each); a key goes
    to the partitions whose ranges hold it and there, by an equi-join, to the shards.
    """
    spark = shards.sparkSession
    ranges = shards.select("part", "seq", "first_id", "last_id", "nulls")
    parts = ranges.groupBy("part").agg(F.min("first_id").alias("lo"), F.max("last_id").alias("hi"), F.sum("nulls").alias("nulls")).orderBy("part").collect()
    known = [r for r in parts if r["lo"] is not None]
    bounds = spark.sparkContext.broadcast((np.array([r["lo"] for r in known], np.int64), np.array([r["hi"] for r in known], np.int64), [r["part"] for r in known], [r["part"] for r in parts if r["nulls"]]))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, hi, names, with_nulls = bounds.value
        for pdf in batches:
            rows = []
            for k in pdf["key"].astype("Int64"):
                if k is pd.NA:
                    rows += [(None, p) for p in with_nulls]
                else:
                    # partitions follow each other in key order
                    rows += [(k, p) for p in names[int(np.searchsorted(hi, k)) : int(np.searchsorted(lo, k, side="right"))]]
            yield pd.DataFrame(rows, columns=["key", "part"]).astype({"key": "Int64", "part": "int32"})

    wanted = keys.select(F.col("doc_id").cast("long").alias("key")).distinct().mapInPandas(route, "key long, part int")
    holds = F.when(F.col("key").isNull(), F.col("nulls") > 0).otherwise(F.col("key").between(F.col("first_id"), F.col("last_id")))
    routed = wanted.join(ranges, "part").where(holds).groupBy("part", "seq").agg(F.collect_set("key").alias("asked"), F.max(F.col("key").isNull()).alias("ask_null"))

    def ask(row) -> list[tuple]:
        counts = np.unique(np.frombuffer(row.keys, "<i8"), return_counts=True)
        times = dict(zip(*[x.tolist() for x in counts]))
        return [(k, i) for k in map(int, row.asked) for i in range(times.get(k, 1))] + [(None, i) for i in range(row.nulls if row.ask_null else 0)]

    return _read(_with_base(shards).join(routed, ["part", "seq"]), ask, True)
