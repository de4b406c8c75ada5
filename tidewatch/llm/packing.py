"""Sequence packing by power-of-two decomposition.

A document of L ids is split into pieces whose lengths are the binary digits of L, after
whole pieces of ``max_length``. Each piece is a sequence of its own length bucket, so no
sequence crosses documents and, lengths being powers of two, none is padded.
Sequences are numbered by bucket: the pieces are written (with their ids) by Spark, each
with its partition and rank, and numbers follow from per-partition counts.

Nulls: a null text is an empty document, which still has its end id; a null doc_id is
kept. Repeated rows are separate documents. Extra columns are ignored; an empty table
gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import before, documents, slices
from tidewatch.llm.tokens import encoder
from tidewatch.session import stored

MAX_LENGTH = 4096


def pieces(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Piece lengths of a document of n ids: whole pieces first, then falling powers of two."""
    out = [max_length] * (n // max_length)
    rest = n % max_length
    return out + [1 << b for b in range(max_length.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, max_length: int = MAX_LENGTH) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (unsigned 32-bit bytes)."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long, ids binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        rank: dict[int, int] = {}
        for pdf in slices(batches):
            rows = []
            for key, b in zip(pdf["doc_id"].astype("Int64"), enc.batch(list(pdf["text"]))):
                b += end
                at, n = 0, len(b) // 4
                for size in pieces(n, max_length):
                    own = b[4 * at : 4 * (at + size)]
                    rows.append((key, at, size, zlib.crc32(own), n, part, rank.get(size, 0), own))
                    rank[size] = rank.get(size, 0) + 1
                    at += size
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

    cutup = stored(documents(docs).mapInPandas(run, schema), "pieces")
    totals = before(cutup.groupBy("length", "part").agg(F.count("*").alias("n")), ["length", "part"], "n")
    placed = cutup.join(F.broadcast(totals.select("length", "part", "base")), ["length", "part"])
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
