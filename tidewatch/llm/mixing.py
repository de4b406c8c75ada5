"""Mixing sources to target weights by iterative proportional fitting.

Token counts are gathered per cell (source, language, topic). Raking scales the cells in
turn to the target marginals of each dimension until all three fit; a document's
calibrated rate is its cell's raked weight over its tokens. One factor turns rates into
sampling probabilities, capped at 1, whose expected tokens are ``keep`` of all; a fixed
hash of the row decides, so a rerun samples the same documents.

One way of raking serves every size. A cell's weight is its tokens times a factor per
dimension. Cells lie by source over the tasks; a round is one pass in which each task
fits its own sources exactly and returns the sums by (language, topic). These sums, of
which there are at most ``PAIRS``, and the factors of the two small dimensions are all
that the driver sees. Rounds end when every marginal misses its target by less than
``MISS`` of it, or when a round no longer changes the miss: targets that contradict each
other can't all be met, which a warning tells with the miss that is left.

Targets: unless given, each marginal is its observed share to the power ``temper``, so
that small sources gain and the largest do not crowd the mix. Topic: spherical k-means
over hashed words, fitted on all texts in passes over their stored word counts, then every
whole text goes to the topic whose centre scores highest (ties: the smallest; no word: -1).

Nulls in a dimension are a value of their own; a null text has no tokens, rows without
tokens are kept (they cost nothing). A given target that names no value of the data has no
effect; values without a target keep their share. Repeated rows share one decision. An
empty table gives no row. The input's columns travel in a struct, so any names may occur.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SLICE, U, bounded, documents, slices, word_hashes
from tidewatch.session import cut, stored

TOPICS = 8
#: Buckets of word hashes that the topic model knows words by.
BUCKETS = 1 << 12
#: Rounds of k-means at most, and the fraction of a weight that sums are exact to.
LLOYD, UNIT = 12, float(1 << 20)
DIMENSIONS = ("source", "lang", "topic")
ROUNDS, MISS = 200, 1e-7
#: Most (language, topic) pairs; more than this is an error, not a loss.
PAIRS = 1_000_000
#: Most cells that are broadcast to the documents; more are joined, each hot one over ``SALTS`` tasks.
BROADCAST_CELLS, SALTS = 100_000, 32


def _buckets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    h, sizes = word_hashes([(t or "").encode() for t in texts])
    return (h >> U(52)).astype(np.int64), sizes


class Topics:
    """Word weights per topic: (BUCKETS, topics)."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights.astype(np.float32)

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(topic, number of words) of each text."""
        code, sizes = _buckets(texts)
        out = np.full(len(sizes), -1, np.int32)
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            score = np.column_stack([np.add.reduceat(self.weights[:, k][code], starts, dtype=np.float64) for k in range(self.weights.shape[1])])
            out[full] = np.round(score / sizes[full][:, None], 9).argmax(1)
        return out, sizes


def _vectors(rows: DataFrame) -> DataFrame:
    """(h, code, n): buckets of the words of every text that has one, and log(1 + n) of how often each occurs; h orders texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in slices(b.to_pandas() for b in batches):
            code, sizes = _buckets(list(pdf["text"]))
            both, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * BUCKETS + code, return_counts=True)
            ends = np.searchsorted(both, np.arange(len(sizes) + 1) * BUCKETS).astype(np.int32)
            # numbers in a row as bytes: Spark copies them whole
            flat = [pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends * v.dtype.itemsize), pa.py_buffer(v)]) for v in ((both % BUCKETS).astype(np.uint16), np.log1p(n).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([pa.array(pdf["h"].to_numpy(np.int64)), *flat], names=["h", "code", "n"])

    keyed = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    return stored(keyed.mapInArrow(counted, "h long, code binary, n binary").where(F.length("code") > 0), "words")


def _weighted(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """(h, code, weight, first, size) of texts with a weight: codes and unit weights of all in a row, where each text begins and how many it has."""
    code, size = _flat(batch.column("code"), np.uint16)
    w = _flat(batch.column("n"), np.float32)[0] * idf[code]
    norm = np.sqrt(np.add.reduceat(w * w, np.cumsum(size) - size))
    full = norm > 0
    if not full.all():
        kept = np.repeat(full, size)
        code, size, w, norm = code[kept], size[full], w[kept], norm[full]
    return batch.column("h").to_numpy()[full], code, w / np.repeat(norm, size), np.cumsum(size) - size, size


def _flat(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of bytes in a row, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _scores(code: np.ndarray, w: np.ndarray, first: np.ndarray, centres: np.ndarray) -> np.ndarray:
    # one centre at a time: runs of numbers are summed far faster than rows of them, and no row of all centres is made for each word
    return np.round(np.column_stack([np.add.reduceat(c[code] * w, first) for c in centres]), 9)


def learn_topics(docs: DataFrame, topics: int = TOPICS, sample: int | None = None) -> Topics:
    """The topic model of all texts of ``docs``, or of ``sample`` of them where that is given.

    Each pass is one job over the stored counts; the driver gets sums by topic and bucket. A
    start is the text least like any start before it. Weights are summed as whole numbers, so
    centres do not depend on how the rows are dealt.
    """
    rows = documents(docs)
    if sample is not None:
        rows = rows.join(F.broadcast(rows.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()), "doc_id")
    held = _vectors(rows)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("code"), np.uint16)[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"code": np.arange(BUCKETS, dtype=np.int32), "n": total}), preserve_index=False)

    known = held.mapInArrow(present, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    df[known["code"]] = known["n"]
    idf = np.log((held.count() + 1) / (df + 1))
    centres = np.zeros((0, BUCKETS))

    def least_like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, row = None, None
        for batch in batches:
            h, code, w, first, size = _weighted(batch, idf)
            if len(h):
                like = _scores(code, w, first, centres).max(1) if len(centres) else np.zeros(len(h))
                i = int(np.lexsort((h, like))[0])
                if best is None or (like[i], h[i]) < best:
                    at = slice(first[i], first[i] + size[i])
                    best, row = (like[i], h[i]), (code[at], w[at])
        if best is not None:
            yield pa.RecordBatch.from_pydict({"like": pa.array([float(best[0])]), "h": pa.array([int(best[1])]), "code": pa.array([row[0].tolist()], pa.list_(pa.int32())), "w": pa.array([row[1].tolist()], pa.list_(pa.float64()))})

    while len(centres) < topics:
        found = held.mapInArrow(least_like, "like double, h long, code array<int>, w array<double>").orderBy("like", "h").first()
        if found is None or found["like"] >= 1 - 1e-9:
            break
        centres = np.vstack([centres, np.zeros(BUCKETS)])
        centres[-1, found["code"]] = found["w"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(centres.size)
        for batch in batches:
            h, code, w, first, size = _weighted(batch, idf)
            if len(h):
                own = _scores(code, w, first, centres).argmax(1)
                total += np.bincount(np.repeat(own, size) * BUCKETS + code.astype(np.int64), np.rint(w * UNIT), minlength=centres.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"at": at, "w": total[at].astype(np.int64)}), preserve_index=False)

    for _ in range(LLOYD if len(centres) else 0):
        got = held.mapInArrow(summed, "at long, w long").groupBy("at").agg(F.sum("w").alias("w")).toPandas()
        sums = np.zeros(centres.size)
        sums[got["at"]] = got["w"]
        sums = sums.reshape(centres.shape)
        sums = np.where(sums.any(1)[:, None], sums, centres)
        last, centres = centres, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.abs(centres - last).max() < 1e-9:
            break
    return Topics(np.vstack([centres, np.zeros((topics - len(centres), BUCKETS))]).T * idf[:, None])


def described(docs: DataFrame, topics: Topics, columns: list[str] | None = None) -> DataFrame:
    """(row, source, lang, topic, tokens, draw): row is a struct of ``columns`` (all, unless given); draw lies in [0, 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(topics)

    @F.pandas_udf("struct<topic: int, tokens: long>")
    def measured(text: pd.Series) -> pd.DataFrame:
        parts = [shared.value.of(list(p["text"])) for p in slices(iter([text.to_frame("text")]), size=SLICE)]
        return pd.DataFrame({"topic": np.concatenate([a for a, _ in parts] or [np.empty(0, np.int32)]), "tokens": np.concatenate([b for _, b in parts] or [np.empty(0, np.int64)])})

    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    out = bounded(docs).select(F.struct(*(columns or docs.columns)).alias("row"), named("source").alias("source"), named("lang").alias("lang"), draw.alias("draw"), measured("text").alias("x"))
    return out.select("row", "source", "lang", F.col("x.topic").alias("topic"), F.col("x.tokens").alias("tokens"), "draw")


def shares(own: pd.Series, temper: float, given: dict | None) -> pd.Series:
    """Target shares of a dimension's values that sum to 1; own: their tokens."""
    total = float(own.sum()) or 1.0
    if given:
        told = {str(k): float(v) for k, v in given.items()}
        want = pd.Series([told.get(str(v).removeprefix("="), t / total) for v, t in own.items()], own.index, dtype=float)
    else:
        want = own.astype(float) ** temper
    return want / (want.sum() or 1.0)


def _source_shares(cells: DataFrame, temper: float, given: dict | None) -> DataFrame:
    """``cells`` with ``share``: the target share of the cell's source."""
    own = cells.groupBy("source").agg(F.sum("tokens").alias("t"))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    if given:
        told = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items()], "v string, g double")
        want = own.join(told, F.regexp_replace("source", "^=", "") == F.col("v"), "left").select("source", F.coalesce("g", F.col("t") / total).alias("s"))
    else:
        want = own.select("source", F.pow(F.col("t").cast("double"), F.lit(temper)).alias("s"))
    scale = want.agg(F.sum("s")).first()[0] or 1.0
    return cells.join(want.select("source", (F.col("s") / scale).alias("share")), "source")


def _fitted(pdf: pd.DataFrame, lang: dict, topic: dict) -> np.ndarray:
    """Weights of whole sources: own shares times the factors of language and topic, scaled to each source's target."""
    w = pdf["tokens"].to_numpy(float) * pdf["lang"].map(lang).to_numpy(float) * pdf["topic"].map(topic).to_numpy(float)
    code, values = pd.factorize(pdf["source"])
    now = np.bincount(code, w, len(values))
    return w * np.divide(pdf["share"].to_numpy(float), now[code], out=np.zeros(len(w)), where=now[code] > 0)


def _whole_sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by source, cut so that no source is parted."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = (held["source"] == held["source"].iloc[-1]).to_numpy() if len(held) else np.empty(0, bool)
        if not last.all():
            yield held[~last].reset_index(drop=True)
            held = held[last].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def rake(cells: DataFrame, want: dict[str, pd.Series], rounds: int = ROUNDS, tolerance: float = MISS) -> DataFrame:
    """(source, lang, topic, tokens, w): cells (source, lang, topic, tokens, share) with raked shares; want: target shares of language and topic."""
    spark = cells.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells.count() // 20_000)))
    cells = cut(cells.repartition(parts, "source").sortWithinPartitions("source"))
    factor = {d: pd.Series(1.0, s.index) for d, s in want.items()}

    def tables() -> dict[str, dict]:
        return {d: f.to_dict() for d, f in factor.items()}

    def summed(given: dict[str, dict]) -> pd.DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in _whole_sources(batches):
                yield pdf.assign(w=_fitted(pdf, given["lang"], given["topic"])).groupby(["lang", "topic"], as_index=False)["w"].sum()

        got = cells.mapInPandas(run, "lang string, topic int, w double")
        return (got if parts == 1 else got.groupBy("lang", "topic").agg(F.sum("w").alias("w"))).toPandas().groupby(["lang", "topic"], as_index=False)["w"].sum()

    last, worst = float("inf"), 0.0
    for _ in range(rounds):
        both = summed(tables())
        worst = 0.0
        w = both["w"].to_numpy(float)
        for step in range(50):
            miss = 0.0
            for d, share in want.items():
                code = share.index.get_indexer(both[d])
                now = np.bincount(code, w, len(share))
                ok = (now > 0) & (share.to_numpy() > 0)
                ratio = np.divide(share.to_numpy(), now, out=np.ones(len(share)), where=ok)
                miss = max(miss, float(np.abs(1 / ratio[ok] - 1).max(initial=0)))
                factor[d] = factor[d] * ratio
                w = w * ratio[code]
            worst = worst or miss
            if miss < tolerance / 10:
                break
        if worst < tolerance or abs(worst - last) <= tolerance * worst:
            break
        last = worst
    if worst >= tolerance:
        warnings.warn(f"targets of the mix contradict each other: marginals miss them by {worst:.2g} of a target", stacklevel=2)
    done = tables()

    def last_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_sources(batches):
            yield pdf.drop(columns="share").assign(w=_fitted(pdf, done["lang"], done["topic"]))

    return cut(cells.mapInPandas(last_pass, "source string, lang string, topic int, tokens long, w double"))


def factor_of(raked: DataFrame, keep: float, points: int = 32, rounds: int = 9) -> float:
    """The factor on rates at which the expected tokens are ``keep`` of all: a search that narrows its range ``points``-fold a pass."""
    total = float(raked.agg(F.sum("tokens")).first()[0] or 0)
    rate = F.col("w") * F.lit(total or 1.0) / F.col("tokens")
    some = raked.where((F.col("tokens") > 0) & (F.col("w") > 0))
    held = lambda f: F.sum(F.col("tokens") * F.least(F.lit(1.0), rate * F.lit(float(f))))
    slowest, reach = some.agg(F.min(rate), F.sum("tokens")).first()
    if not total or slowest is None:
        return keep
    lo, hi = 0.0, 1 / slowest
    if reach <= keep * total:
        return hi
    hi = min(hi, max(keep, 1e-9)) if some.agg(held(keep)).first()[0] >= keep * total else hi
    for _ in range(rounds):
        grid = np.linspace(lo, hi, points + 1)[1:]
        sums = np.array(some.agg(*[held(f).alias(f"f{i}") for i, f in enumerate(grid)]).first(), float)
        at = int(np.argmax(sums >= keep * total)) if (sums >= keep * total).any() else points - 1
        lo, hi = (grid[at - 1] if at else lo), grid[at]
        if hi - lo <= 1e-12 * hi:
            break
    return hi


def calibrate(known: DataFrame, keep: float = 0.75, temper: float = 0.7, targets: dict[str, dict] | None = None) -> DataFrame:
    """(source, lang, topic, tokens, w, p): raked share and sampling probability of each cell of described documents."""
    targets = targets or {}
    cells = cut(known.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    pairs = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens"))
    n = pairs.count()
    if n > PAIRS:
        raise ValueError(f"{n} pairs of language and topic; at most {PAIRS} can be raked")
    pairs = pairs.toPandas().sort_values(["lang", "topic"])
    want = {d: shares(pairs.groupby(d)["tokens"].sum(), temper, targets.get(d)) for d in ("lang", "topic")}
    raked = rake(_source_shares(cells, temper, targets.get("source")), want)
    total = float(raked.agg(F.sum("tokens")).first()[0] or 1.0)
    rate = F.when(F.col("tokens") > 0, F.col("w") * F.lit(total) / F.col("tokens")).otherwise(F.lit(float("inf")))
    return raked.withColumn("p", F.least(F.lit(1.0), rate * F.lit(factor_of(raked, keep))))


def decide(docs: DataFrame, keep: float = 0.75, temper: float = 0.7, targets: dict[str, dict] | None = None, columns: list[str] | None = None) -> DataFrame:
    """(row, source, lang, topic, tokens, p, kept) of every document; row: a struct of ``columns``, all unless given."""
    known = stored(described(docs, learn_topics(docs), columns), "described")
    cells = calibrate(known, keep, temper, targets).select(*DIMENSIONS, "p")
    if cells.count() <= BROADCAST_CELLS:
        out = known.join(F.broadcast(cells), list(DIMENSIONS))
    else:
        salt = F.floor(F.col("draw") * SALTS).cast("int")
        spread = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = known.withColumn("salt", salt).join(spread, [*DIMENSIONS, "salt"])
    return out.select("row", *DIMENSIONS, "tokens", "p", (F.col("draw") < F.col("p")).alias("kept"))


def mix(docs: DataFrame, keep: float = 0.75, temper: float = 0.7, targets: dict[str, dict] | None = None) -> DataFrame:
    """The sampled rows of ``docs``, with all their columns."""
    return decide(docs, keep, temper, targets).where("kept").select("row.*")
