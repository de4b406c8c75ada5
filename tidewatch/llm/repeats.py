"""Removal of word sequences that repeat, by prefix-partitioned suffix trees.

A word sequence of ``window`` words repeats when it starts at two or more places of the
corpus. A tree over every suffix would cost many times the corpus, so suffixes are kept
at anchors only: each window's anchor is its smallest ``PREFIX``-word gram (by hash,
leftmost on ties), so equal windows have equal anchors at equal places.

1. Prefixes. A window reaches at least half of the other words on one side of its anchor,
   so the anchor is lengthened there: to the left for windows in which it stands late, to
   the right for the rest. These longer prefixes are counted over the whole corpus (once
   per batch, however often a batch holds them); a suffix whose prefix occurs once can't
   repeat and goes no further.
2. Subtrees. The remaining suffixes are parted by prefix. In each group the words behind
   the prefix are sorted and their longest common prefixes taken: runs of neighbours that
   share d words are the internal nodes at depth d of the group's suffix tree. The words
   before the prefix give the tree of the reversed text in the same way.
3. Maximal repeats. Places that share a node in both trees, with ``window`` words between
   the two depths, hold the same sequence: those are marked. A window is marked at each
   depth at which it repeats, so what is marked in a row is the maximal repeat.
4. Marks return to their documents and the covered words are removed.

Prefix groups of over ``group_rows`` places are lengthened further, to the whole window,
and places that meet within a batch are combined before they are sent. At most
``HOT_KEYS`` prefixes are told to the tasks; with more, ``group_rows`` rises.

Words are compared by hashes: 64 bits of prefix and 32 of each word beyond it.

Nulls: a null text has no words. Rows are told apart by doc_id and text, so null and
repeated doc_ids keep their own result; repeated rows repeat each other's windows. Extra
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import U, documents, mix, ragged, rolling, slices, word_hashes
from tidewatch.session import stored

WINDOW = 35
PREFIX = 12
HOT_KEYS = 4_000_000
#: Documents whose keys may be broadcast to drop the rest before texts are shuffled.
NAMED = 1_000_000


def leftmost_min(x: np.ndarray, width: int) -> np.ndarray:
    """For each i the first position of the smallest of x[i : i + width]."""
    at, span = np.arange(len(x)), 1

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    while span * 2 <= width:
        at = lower(at[:-span], at[span:])
        span *= 2
    if span < width:
        at = lower(at[: len(at) - (width - span)], at[width - span :])
    return at


class Suffixes:
    """The anchored suffixes of a batch of texts, laid end to end, by side.

    A window that has ``o`` words before its anchor belongs to side 1 (prefix lengthened
    to the left) if o > half, else to side 0 (to the right). Of each entry: doc, pos (of
    the anchor in its text), side, key (hash of the lengthened prefix), and lo..hi, the
    numbers of further words to the left with which a window starts.
    """

    def __init__(self, raw: list[bytes], window: int = WINDOW, prefix: int = PREFIX) -> None:
        self.x, self.sizes = word_hashes(raw)
        self.base = np.cumsum(self.sizes) - self.sizes
        rest = window - prefix
        self.half = rest // 2
        #: further words on both sides together, by side
        self.reach = (self.half, rest - self.half)
        starts = ragged(self.base, np.maximum(self.sizes - window + 1, 0))
        empty = np.empty(0, np.int64)
        self.doc = self.pos = self.side = self.lo = self.hi = empty
        self.key = np.empty(0, U)
        if not len(starts):
            return
        grams = rolling(self.x, prefix, 0)
        at = leftmost_min(grams, rest + 1)[starts]
        doc = np.repeat(np.arange(len(raw)), np.maximum(self.sizes - window + 1, 0))
        before = at - starts
        side = (before > self.half).astype(np.int64)
        # windows of one anchor and side follow each other
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (side[1:] != side[:-1]) | (doc[1:] != doc[:-1])])
        last = np.r_[new[1:], len(at)] - 1
        anchor, self.side, self.doc = at[new], side[new], doc[new]
        self.pos = anchor - self.base[self.doc]
        self.hi, self.lo = before[new] - self.side * self.half, before[last] - self.side * self.half
        left, right = rolling(self.x, prefix + self.half, 1), rolling(self.x, prefix + self.reach[1], 1)
        self.key = np.empty(len(new), U)
        s = self.side == 1
        self.key[s] = left[anchor[s] - self.half]
        self.key[~s] = right[anchor[~s]] ^ U(0x5555555555555555)

    def words(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """32-bit hashes of the words to the left (nearest first) and right of the lengthened prefixes of entries ``at``."""
        width = max(self.reach)
        code = np.concatenate([(self.x >> U(32)).astype(np.uint32), [0]]).astype(np.uint32)
        anchor, side = self.pos[at] + self.base[self.doc[at]], self.side[at]
        j = np.arange(width)
        reach = np.array(self.reach)[side]
        l = anchor - side * self.half - 1
        r = anchor + PREFIX + (1 - side) * self.reach[1]
        left = np.where(j[None, :] < self.hi[at][:, None], l[:, None] - j, len(self.x))
        right = np.where(j[None, :] < (reach - self.lo[at])[:, None], r[:, None] + j, len(self.x))
        return code[left], code[right]


def _ids(pdf: pd.DataFrame, at: np.ndarray) -> dict:
    return {"doc_id": pdf["doc_id"].astype("Int64").take(at).array, "th": pdf["th"].to_numpy()[at]}


def _raw(pdf: pd.DataFrame) -> list[bytes]:
    return [t.encode() for t in pdf["text"]]


def _lone(n: int, name: np.ndarray) -> np.ndarray:
    """Keys for rows that need no group and may meet the shuffle anywhere."""
    return mix(name.view(U) ^ np.arange(n).astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def _prefixes(window: int):
    """(doc_id, th, key, pos, times): each prefix once a batch with its times there; further places with times 0. pos: twice the anchor's place, and the side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, size=2 << 20):
            s = Suffixes(_raw(pdf), window)
            _, lead, times = np.unique(s.key, return_index=True, return_counts=True)
            n = np.zeros(len(s.key), np.int32)
            n[lead] = times
            out = pd.DataFrame(_ids(pdf, s.doc) | {"key": s.key.view(np.int64), "pos": (s.pos * 2 + s.side).astype(np.int32), "times": n})
            more = n == 0
            out.loc[more, "key"] = _lone(int(more.sum()), out["th"].to_numpy()[more])
            yield out

    return run


def _repeated(group_rows: int):
    """For rows sorted by key: places (doc_id, th, pos) of prefixes that occur twice; and as (key, times) the crowded ones."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key, times = pdf["key"].to_numpy(), pdf["times"].to_numpy(np.int64)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.add.reduceat(times, new)
        each = np.repeat(total, np.diff(np.r_[new, len(key)]))
        found = pdf[(each > 1) | (times == 0)]
        hot = total > group_rows
        crowded = pd.DataFrame({"doc_id": pd.array([None] * int(hot.sum()), "Int64"), "th": key[new[hot]], "pos": np.int32(-1), "times": total[hot]})
        return pd.concat([found[["doc_id", "th", "pos"]].astype({"doc_id": "Int64"}).assign(times=np.int64(0)), crowded], ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(batches, "key", 100_000):
            yield solve(pdf)

    return run


def _whole(batches: Iterator[pd.DataFrame], by: str, rows: int) -> Iterator[pd.DataFrame]:
    """Batches sorted by a column, joined to ``rows`` rows or more and cut so that no value is parted."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size < rows:
            continue
        pdf = pd.concat(held, ignore_index=True)
        last = (pdf[by] == pdf[by].iloc[-1]).to_numpy()
        if not last.all():
            yield pdf[~last].reset_index(drop=True)
        held, size = [pdf[last].reset_index(drop=True)], int(last.sum())
    if size:
        yield pd.concat(held, ignore_index=True)


SENT = "doc_id long, th long, key long, side int, top int, lo int, hi int, mask long, words binary"


def _sent(window: int, hot):
    """The suffixes at found places, as rows for their groups: ``top - l`` is the start of the window with l further words to the left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crowded = hot.value
        for pdf in slices(batches):
            s = Suffixes(_raw(pdf), window)
            found = np.zeros(2 * int(s.sizes.sum()) + 2, bool)
            for base, at in zip(s.base, pdf["found"]):
                found[2 * base + np.asarray(at, np.int64)] = True
            at = np.flatnonzero(found[2 * (s.pos + s.base[s.doc]) + s.side])
            is_hot = np.zeros(len(at), bool)
            if len(crowded):
                k = s.key[at].view(np.int64)
                is_hot = crowded[np.minimum(np.searchsorted(crowded, k), len(crowded) - 1)] == k
            yield _rows(pdf, s, at[~is_hot], None)
            if is_hot.any():
                yield _rows(pdf, s, *_by_window(s, at[is_hot]))

    return run


def _by_window(s: Suffixes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = s.hi[at] - s.lo[at] + 1
    return np.repeat(at, n), ragged(s.lo[at], n)


def _rows(pdf: pd.DataFrame, s: Suffixes, at: np.ndarray, l: np.ndarray | None) -> pd.DataFrame:
    """Rows for entries ``at``; with ``l`` each for the one window with l further words to the left, combined within the batch."""
    left, right = s.words(at)
    top = (s.pos[at] - s.side[at] * s.half).astype(np.int32)
    lo, hi = (s.lo[at], s.hi[at]) if l is None else (l, l)
    key, mask = s.key[at], np.zeros(len(at), np.int64)
    if l is not None:
        j = np.arange(left.shape[1])
        reach = np.array(s.reach)[s.side[at]]
        left = np.where(j < l[:, None], left, 0)
        right = np.where(j < (reach - l)[:, None], right, 0)
        whole = np.ascontiguousarray(np.hstack([left, right])).view(U)
        key = key ^ mix(l.astype(U) + U(1))
        for c in range(whole.shape[1]):
            key = mix(key * U(0x9E3779B97F4A7C15) + whole[:, c])
        _, lead, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        again = (times > 1)[back]
        mask = np.where(again, np.int64(1) << l, 0)
        more = np.ones(len(at), bool)
        more[lead] = False
        # a window met twice in the batch is marked here; one of its places is sent on
        key = key.copy()
        key[more] = _lone(int(more.sum()), key[more].view(np.int64)).view(U)
        lo, hi = np.where(more, 1, lo), np.where(more, 0, hi)
        left[more], right[more] = 0, 0
    both = np.hstack([left, right]).astype("<u4")
    flat, width = both.tobytes(), both.shape[1] * 4
    words = [flat[i : i + width] for i in range(0, len(flat), width)]
    return pd.DataFrame(_ids(pdf, s.doc[at]) | {"key": key.view(np.int64), "side": s.side[at].astype(np.int32), "top": top, "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "mask": mask, "words": words})


def nodes(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each row and depth 0..width the internal node of its group's tree that it lies under.

    The rows are sorted by group and words; rows that share their first d words with their
    neighbours form one interval of longest common prefixes, whose first row names it.
    """
    n, width = words.shape
    order = np.lexsort((*words.T[::-1], group))
    g, w = group[order], words[order]
    other = np.empty((n - 1, width + 1), bool)
    other[:, 0] = g[1:] != g[:-1]
    other[:, 1:] = w[1:] != w[:-1]
    # words in common with the row before; -1: another group
    common = np.r_[-1, np.where(other.any(1), other.argmax(1) - 1, width)]
    out = np.empty((n, width + 1), np.int64)
    rank = np.arange(n)
    for d in range(width + 1):
        out[order, d] = np.maximum.accumulate(np.where(common < d, rank, 0))
    return out


def mark(pdf: pd.DataFrame, reach: tuple[int, int]) -> pd.DataFrame:
    """Whole groups, sorted by key: (doc_id, th, top, mask) with a bit of mask for each window that another place shares."""
    key = pdf["key"].to_numpy()
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
    width = max(reach)
    both = np.frombuffer(b"".join(pdf["words"]), "<u4").reshape(len(pdf), 2 * width)
    lo, hi, mask = (pdf[c].to_numpy(np.int64) for c in ("lo", "hi", "mask"))
    side = pdf["side"].to_numpy() == 1
    mask = mask.copy()
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(some):
        left, right = nodes(group[some], both[some, :width]), nodes(group[some], both[some, width:])
        for s in (0, 1):
            for l in range(reach[s] + 1):
                ok = np.flatnonzero((lo[some] <= l) & (l <= hi[some]) & (side[some] == bool(s)))
                if len(ok) < 2:
                    continue
                pair = left[ok, l] * len(some) + right[ok, reach[s] - l]
                order = np.argsort(pair, kind="stable")
                same = pair[order][1:] == pair[order][:-1]
                hit = np.zeros(len(ok), bool)
                hit[order] = np.r_[same, False] | np.r_[False, same]
                mask[some[ok[hit]]] |= np.int64(1) << l
    keep = np.flatnonzero(mask)
    return pd.DataFrame(_ids(pdf, keep) | {"top": pdf["top"].to_numpy()[keep], "mask": mask[keep]})


def _subtrees(reach: tuple[int, int], rows: int = 40_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(batches, "key", rows):
            yield mark(pdf, reach)

    return run


def _removal(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            rows = []
            for text, tops, masks in zip(pdf["text"], pdf["tops"], pdf["masks"]):
                words = text.encode().split()
                n, gone = len(words), 0
                if tops is not None and len(tops):
                    bits = np.asarray(masks, np.int64)[:, None] >> np.arange(window) & 1
                    r, l = np.nonzero(bits)
                    at = np.unique(np.asarray(tops, np.int64)[r] - l)
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    keep = np.cumsum(cover)[:n] == 0
                    gone = n - int(keep.sum())
                    words = [words[i] for i in np.flatnonzero(keep)]
                kept = b" ".join(words)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest(), kept.decode()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept"])
            yield pd.concat([pdf[["doc_id"]].astype("Int64").reset_index(drop=True), out], axis=1)

    return run


def _met(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _split(texts: DataFrame, named: DataFrame) -> DataFrame:
    """``texts`` that ``named`` has, before they are shuffled, where its size allows to broadcast it."""
    if named.count() > NAMED:
        return texts
    keys = named.select("doc_id", "th")
    return texts.join(F.broadcast(keys), _met(texts, keys), "left_semi")


def remove_repeats(docs: DataFrame, window: int = WINDOW, group_rows: int = 4096) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every document."""
    if not PREFIX + 2 <= window <= 63:
        raise ValueError(f"window must be {PREFIX + 2} to 63")
    spark = docs.sparkSession
    texts = documents(docs).withColumn("th", F.xxhash64("text"))
    row = "doc_id long, th long, "
    prefixes = texts.mapInPandas(_prefixes(window), row + "key long, pos int, times int").repartition("key").sortWithinPartitions("key")
    found = stored(prefixes.mapInPandas(_repeated(group_rows), row + "pos int, times long"), "found")
    crowded = found.where("pos = -1")
    if crowded.count() > HOT_KEYS:
        crowded = crowded.orderBy(F.desc("times")).limit(HOT_KEYS)
    hot = spark.sparkContext.broadcast(np.sort(crowded.select("th").toArrow().column("th").to_numpy().astype(np.int64)))
    places = stored(found.where("pos >= 0").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("found")), "places")
    some = _split(texts, places)
    known = some.join(places, _met(some, places)).select(some["doc_id"], some["th"], "text", "found")
    groups = known.mapInPandas(_sent(window, hot), SENT).repartition("key").sortWithinPartitions("key")
    rest = window - PREFIX
    marks = groups.mapInPandas(_subtrees((rest // 2, rest - rest // 2)), row + "top int, mask long")
    marked = stored(marks.groupBy("doc_id", "th").agg(F.collect_list("top").alias("tops"), F.collect_list("mask").alias("masks")), "marked")
    return _kept(texts, marked).mapInPandas(_removal(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def _kept(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id, text, tops, masks) of every row; only marked texts are shuffled where their keys can be broadcast."""
    columns = [texts["doc_id"], "text", "tops", "masks"]
    if marked.count() > NAMED:
        return texts.join(marked, _met(texts, marked), "left").select(*columns)
    keys = marked.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.lit(True).alias("has"))
    told = texts.join(F.broadcast(keys), texts["doc_id"].eqNullSafe(F.col("_d")) & (texts["th"] == F.col("_t")), "left")
    clean = told.where("has is null").select("doc_id", "text", F.lit(None).cast("array<int>").alias("tops"), F.lit(None).cast("array<bigint>").alias("masks"))
    own = told.where("has").select("doc_id", "th", "text")
    return clean.union(own.join(marked, _met(own, marked)).select(own["doc_id"], "text", "tops", "masks"))
