"""SimHash near-duplicate detection with BK-trees.

1. ``fingerprints``: every whole text becomes a 64-bit SimHash over word shingles.
2. ``links``: equal fingerprints are folded first, so a group of exact copies is one
   node however large. Any two fingerprints within ``radius`` agree on ``agree`` of
   ``radius + agree`` bit blocks (pigeonhole), so each fingerprint is sent once per
   choice of blocks to the shard that holds the fingerprints with the same bits there.
   Every shard builds a BK-tree whose children are keyed by their integer Hamming
   distance to the parent; queries follow only edges within the radius. A shard tree is
   sent to query blocks only within its own shard: trees over the whole corpus would
   grow with the data and so are never broadcast to all tasks. A crowded shard is dealt
   anew by further bit blocks; only what stays crowded is cut into several trees, which
   its queries all visit.
3. ``components``: the shard's links are reduced to a spanning forest before they leave
   the task, then contracted to components.

Nulls: a null or empty text has fingerprint zero. A null doc_id keeps its row and its
fingerprint but never names a component unless nothing else is in it. Repeated rows
return one row each. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import documents, lowered, ragged, slices
from tidewatch.operators.graph import connected_components
from tidewatch.session import cut, stored

SEED = 42


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each ``words``-word shingle, repeats included; fewer words: of the whole sequence; none: []."""
    parts = lowered(text).split()
    if not parts:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    n = len(parts) - words + 1
    if n <= 1:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(p) + 1 for p in parts])
    lo = [0, *ends[: n - 1].tolist()]
    hi = (ends[words - 1 :] - 1).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(lo, hi)]


def simhash(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: a bit is 1 if set in over half of a run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    counts = np.empty((len(full), 64), np.int64)
    for bit in range(64):
        counts[:, bit] = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
    on = counts * 2 > sizes[full][:, None]
    out[full] = (on.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, th, fp): fp is the 64-bit fingerprint as a signed long, th a hash of the text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            each = [np.array(shingle_hashes(t, words), np.uint64) for t in pdf["text"]]
            sizes = np.array([len(x) for x in each], np.int64)
            fp = simhash(np.concatenate(each) if each else np.empty(0, np.uint64), sizes)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "th": pdf["th"], "fp": fp.view(np.int64)})

    return documents(docs).withColumn("th", F.xxhash64("text")).mapInPandas(run, "doc_id long, th long, fp long")


def choose_blocks(n: int, radius: int, shard_rows: int) -> tuple[list[int], int]:
    """Bit blocks as masks and how many of them must agree so that an average shard holds ``shard_rows`` at most."""
    for agree in range(1, 6):
        m = radius + agree
        if n / 2 ** (64 * agree // m) <= shard_rows or m > 60:
            break
    edges = [64 * i // m for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])], agree


def bk_forest(fp: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees over runs of fingerprints; root[i]: the first position of i's run.

    Returns the edges: sorted keys ``parent * 65 + distance`` and the children. All runs
    descend one level per round, so the work is vectorised over a whole partition.
    """
    at = root.copy()
    active = np.flatnonzero(root != np.arange(len(fp)))
    keys, kids = [], []
    while len(active):
        key = at[active] * 65 + np.bitwise_count(fp[active] ^ fp[at[active]])
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        child = active[first]
        keys.append(uniq)
        kids.append(child)
        at[active] = child[back]
        active = np.delete(active, first)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(kids)
    order = np.argsort(k, kind="stable")
    return k[order], c[order]


def bk_search(fp: np.ndarray, keys: np.ndarray, kids: np.ndarray, query: np.ndarray, start: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, node) pairs within the radius, node another tree member than the query itself."""
    block = 1 << 15
    for lo in range(0, len(query), block):
        stack = [(query[lo : lo + block], start[lo : lo + block])]
        while stack:
            q, node = stack.pop()
            if len(q) > 1 << 20:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            near = (d <= radius) & (q != node)
            if near.any():
                yield q[near], node[near]
            a = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
            b = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), side="right")
            width = b - a
            if width.any():
                stack.append((np.repeat(q, width), kids[ragged(a, width)]))


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges the pairs into ``label`` (label[i]: smallest known member of i's set)."""
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return label
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump


def _link_shards(radius: int, rows: int = 200_000):
    """For mapInPandas over rows sorted by (shard, tree): one spanning forest per tree."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        group = (pdf[["shard", "value", "tree"]] != pdf[["shard", "value", "tree"]].shift()).any(axis=1).to_numpy()
        first = np.maximum.accumulate(np.where(group, np.arange(len(fp)), 0))
        member = pdf["member"].to_numpy(bool)
        inside = np.flatnonzero(member)
        has = np.flatnonzero(group)
        # rows of a tree come before its visiting queries, so the first row of a run is its root
        keys, kids = bk_forest(fp[inside], np.searchsorted(inside, first[inside])) if len(inside) < len(fp) else bk_forest(fp, first)
        if len(inside) < len(fp):
            parent, dist = np.divmod(keys, 65)
            keys, kids = inside[parent] * 65 + dist, inside[kids]
        label = np.arange(len(fp))
        rooted = member[first]
        q = np.flatnonzero(rooted)
        del has
        for a, b in bk_search(fp, keys, kids, q, first[q], radius):
            label = forest(label, a, b)
        out = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[out].view(np.int64), "b": fp[label[out]].view(np.int64)}).query("a != b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < rows:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = pdf[["shard", "value", "tree"]].iloc[-1]
            open_ = ((pdf["shard"] == last["shard"]) & (pdf["value"] == last["value"]) & (pdf["tree"] == last["tree"])).to_numpy()
            if not open_.all():
                yield solve(pdf[~open_].reset_index(drop=True))
            held, size = [pdf[open_]], int(open_.sum())
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split_masks(mask: int, radius: int, agree: int = 2) -> list[int]:
    """``mask`` widened by each choice of ``agree`` of ``radius + agree`` blocks of the bits that it leaves: fingerprints that
    agree on ``mask`` and are within the radius agree on one of these too."""
    rest = [b for b in range(64) if not mask >> b & 1]
    m = radius + agree
    blocks = [sum(1 << b for b in rest[len(rest) * i // m : len(rest) * (i + 1) // m]) for i in range(m)]
    return [mask | sum(c) for c in combinations(blocks, agree)]


def _crowded(sent: DataFrame, tree_rows: int) -> DataFrame:
    return cut(sent.groupBy("shard", "value").count().where(F.col("count") > tree_rows))


def links(distinct: DataFrame, n: int, radius: int = 4, shard_rows: int = 256, tree_rows: int = 16_384) -> DataFrame:
    """(a, b): links that connect every pair of distinct fingerprints ``fp`` within ``radius``.

    A shard beyond ``tree_rows`` is dealt anew by further bit blocks, which again loses no
    link; only what is still crowded then is cut into trees that all its rows visit.
    """
    spark = distinct.sparkSession
    masks, agree = choose_blocks(n, radius, shard_rows)
    choices = [sum(c) for c in combinations(masks, agree)]
    sent = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in choices])).alias("shard", "value"))
    crowded = _crowded(sent, tree_rows)
    if not crowded.isEmpty():
        finer = [_split_masks(m, radius) for m in choices]
        table = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in finer])
        again = sent.join(crowded.select("shard", "value"), ["shard", "value"], "left_semi").select("fp", "shard", F.posexplode(F.get(table, F.col("shard"))).alias("sub", "mask"))
        again = again.select("fp", ((F.col("shard") + 1) * 1000 + F.col("sub")).alias("shard"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
        sent = sent.join(crowded.select("shard", "value"), ["shard", "value"], "left_anti").select("fp", "shard", "value").union(again)
        crowded = _crowded(sent.where("shard >= 1000"), tree_rows)
    sent = sent.withColumns({"tree": F.lit(0), "member": F.lit(True)})
    if not crowded.isEmpty():
        trees = crowded.select("shard", "value", F.ceil(F.col("count") / tree_rows).cast("int").alias("trees"))
        cutup = sent.join(trees, ["shard", "value"]).withColumn("own", F.pmod(F.hash("fp"), "trees"))
        cutup = cutup.select("fp", "shard", "value", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), "own")
        sent = sent.join(trees, ["shard", "value"], "left_anti").select("fp", "shard", "value", "tree", "member").union(cutup.select("fp", "shard", "value", "tree", (F.col("tree") == F.col("own")).alias("member")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(choices) // 1_000_000)
    rows = sent.repartition(parts, "shard", "value", "tree").sortWithinPartitions("shard", "value", "tree", F.desc("member"))
    return rows.mapInPandas(_link_shards(radius), "a long, b long")


def components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    pairs = links(distinct.select("fp"), distinct.count(), radius)
    joined = connected_components(pairs, "a", "b", small=0)
    named = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    return named.join(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row of ``docs``."""
    prints = cut(fingerprints(docs, words))
    known = components(prints, radius)
    return prints.join(known, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            sets = [np.unique(np.array(shingle_hashes(t, words), np.uint64)).view(np.int64) for t in pdf["text"]]
            yield pd.DataFrame({"component": pdf["component"], "doc_id": pdf["doc_id"].astype("Int64"), "th": pdf["th"], "shingles": sets})

    return run


#: Shingles that order last in a prefix: at least so many of the sampled texts (one in ``HOT_SAMPLE``) hold them, at most ``HOT_KEPT`` of them.
HOT_SAMPLE, HOT_LEAST, HOT_KEPT = 8, 3, 500_000


def _described(words: int, similarity: float, hot):
    """For mapInPandas: each text's fingerprint and its first shingles, the hot ones last, of which two texts that are similar enough share one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = hot.value
        for pdf in slices(batches):
            each = [np.array(shingle_hashes(t, words), np.uint64) for t in pdf["text"]]
            fp = simhash(np.concatenate(each), np.array([len(x) for x in each], np.int64))
            heads, size = [], []
            for x in each:
                x = np.unique(x).view(np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, x), len(often) - 1)
                    x = x[np.argsort(often[at] == x, kind="stable")]
                left = max(0, int(np.ceil(similarity * len(x) - 1e-9)) - 1)
                heads.append(x[: len(x) - left])
                size.append(len(x))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "th": pdf["th"], "fp": fp.view(np.int64), "size": np.array(size, np.int32), "head": heads})

    return run


def _hot_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts hold, judged by a sample; they only order the prefixes, so a miss costs time and loses no pair."""
    some = texts.where(F.pmod("th", F.lit(HOT_SAMPLE)) == 0).select(F.lit(0).cast("long").alias("component"), "doc_id", "th", "text")
    held = some.mapInPandas(_shingle_sets(words), "component long, doc_id long, th long, shingles array<long>").select(F.explode("shingles").alias("shingle"))
    often = held.groupBy("shingle").count().where(F.col("count") >= HOT_LEAST).orderBy(F.desc("count"), "shingle").limit(HOT_KEPT)
    return np.sort(often.select("shingle").toArrow().column("shingle").to_numpy().astype(np.int64))


def _met(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """(a, b): two texts, once for each shingle that is early enough in both prefixes to be the first that two similar texts share.

    Such texts of sizes x and y share t / (1 + t) * (x + y) shingles at least. All of them
    stand from the first one on, so not more than x less that many stand before it in the one
    and y less that many in the other. Of a template's texts that differ in more than that by
    shingles of their own, which order before the template's, no pair meets.
    """
    x = left.select(F.posexplode("head").alias("i", "shingle"), F.col("th").alias("a"), F.col("size").alias("x"))
    y = right.select(F.posexplode("head").alias("j", "shingle"), F.col("th").alias("b"), F.col("size").alias("y"))
    least = (F.col("x") + F.col("y")) * (similarity / (1 + similarity)) - 1e-6
    early = (F.col("i") <= F.col("x") - least) & (F.col("j") <= F.col("y") - least)
    return x.join(y, "shingle").where(((F.col("a") < F.col("b")) if left is right else (F.col("a") != F.col("b"))) & early)


def similar(left: DataFrame, right: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): every pair of texts of the two prefix tables, told by ``th``, with a Jaccard similarity of ``similarity`` or more.

    A pair that meets is judged by its prefixes first: what two similar texts share is within
    both, but for the longer part behind a prefix. Whole sets are compared of the rest only.
    """
    # written, so that its size is known and few names do not make all texts move
    names = lambda pairs: stored(pairs.select(F.col("a").alias("_th")).union(pairs.select("b")).distinct(), "named")
    met = cut(_met(left, right, similarity).select("a", "b").distinct())
    named = names(met)
    x = left.join(named, F.col("th") == F.col("_th"), "left_semi").select(F.col("th").alias("a"), F.col("size").alias("x"), F.col("head").alias("s"))
    y = right.join(named, F.col("th") == F.col("_th"), "left_semi").select(F.col("th").alias("b"), F.col("size").alias("y"), F.col("head").alias("t"))
    behind = F.greatest(F.col("x") - F.size("s"), F.col("y") - F.size("t"))
    enough = F.size(F.array_intersect("s", "t")) >= (F.col("x") + F.col("y")) * (similarity / (1 + similarity)) - behind - 1e-6
    met = cut(met.join(x, "a").join(y, "b").where(enough).select("a", "b"))
    named = names(met)
    wanted = texts.join(named, F.col("th") == F.col("_th")).select(F.lit(0).cast("long").alias("component"), "doc_id", "th", "text")
    sets = cut(wanted.mapInPandas(_shingle_sets(words), "component long, doc_id long, th long, shingles array<long>").select("th", "shingles").dropDuplicates(["th"]))
    both = met.join(sets.select(F.col("th").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("th").alias("b"), F.col("shingles").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t"))
    return both.where(shared / (F.size("s") + F.size("t") - shared) >= similarity).select("a", "b")


def _rank(at: str = ""):
    return F.struct(F.col(f"{at}doc_id").isNull(), F.col(f"{at}doc_id"), F.col(f"{at}th"))


def _losers(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(th): texts that go so that no pair stays whole; in order of rank, a text stays unless it is paired with one that does."""
    l, r = known.select("doc_id", "th").alias("l"), known.select("doc_id", "th").alias("r")
    named = pairs.join(l, F.col("a") == F.col("l.th")).join(r, F.col("b") == F.col("r.th"))
    first = _rank("l.") < _rank("r.")
    rest = cut(named.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi")))
    gone = rest.select(F.col("hi").alias("th")).where("false")
    while not rest.isEmpty():
        stay = rest.select(F.col("lo").alias("_s")).distinct().join(rest.select(F.col("hi").alias("_h")).distinct(), F.col("_s") == F.col("_h"), "left_anti")
        out = cut(rest.join(stay, F.col("lo") == F.col("_s")).select(F.col("hi").alias("th")).distinct())
        gone = gone.union(out)
        rest = cut(rest.join(out, F.col("hi") == F.col("th"), "left_anti").join(out, F.col("lo") == F.col("th"), "left_anti"))
    return cut(gone)


def _one_of_each_component(first: DataFrame, texts: DataFrame, words: int, similarity: float, rounds: int = 4) -> DataFrame:
    """(th, by): texts of ``first`` that are similar to one of their component that stays, ``by``.

    Each of at most ``rounds`` rounds takes the first remaining text of each component as one
    that stays; whatever a component still holds then is left to the exact join.
    """
    many = stored(first.join(first.groupBy("component").count().where("count > 1"), "component").select("component", F.col("doc_id").alias("_id"), F.col("th").alias("_th")), "many")
    wanted = texts.join(many, texts["doc_id"].eqNullSafe(many["_id"]) & (texts["th"] == many["_th"])).select("component", "doc_id", "th", "text")
    rest = cut(wanted.mapInPandas(_shingle_sets(words), "component long, doc_id long, th long, shingles array<long>").dropDuplicates(["component", "th"]))
    gone = rest.select("th", F.col("th").alias("by")).where("false")
    for _ in range(rounds):
        if rest.isEmpty():
            break
        stays = rest.groupBy("component").agg(F.min_by(F.struct("doc_id", "th", "shingles"), _rank()).alias("s"))
        both = F.size(F.array_intersect("shingles", "s.shingles"))
        either = F.size("shingles") + F.size("s.shingles") - both
        judged = rest.join(stays, "component").where(F.col("th") != F.col("s.th")).withColumn("near", F.when(either == 0, 1.0).otherwise(both / either) >= similarity)
        judged = cut(judged.withColumn("by", F.col("s.th")).drop("s"))
        gone = gone.union(judged.where("near").select("th", "by"))
        left = judged.where("not near").drop("near", "by")
        rest = left.join(left.groupBy("component").count().where("count > 1").select("component"), "component")
    return cut(gone)


def keep_one(docs: DataFrame, words: int = 5, radius: int = 8, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies, all columns kept.

    No two documents that stay have shingle sets with a Jaccard similarity of
    ``similarity`` or more, and each that goes has it with one that stays. Equal texts are
    folded before. Components of SimHash links come first, as they reduce large groups
    without looking at all their pairs; among what they leave, an exact join on prefixes
    of rare shingles finds the pairs whose fingerprints lie further apart. Where a text
    goes that others went for, those are compared with all that stay and, if similar to
    none, gone through again.
    """
    keyed = documents(docs).withColumn("th", F.xxhash64("text"))
    hot = docs.sparkSession.sparkContext.broadcast(_hot_shingles(keyed, words))
    seen = stored(keyed.mapInPandas(_described(words, similarity, hot), "doc_id long, th long, fp long, size int, head array<long>"), "described")
    member = cut(seen.select("doc_id", "th", "fp").join(components(seen.select("doc_id", "th", "fp"), radius), "fp").select("doc_id", "th", "component").distinct())
    first = cut(member.groupBy("component", "th").agg(F.min("doc_id").alias("doc_id")))
    met = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    prefixes = lambda some: stored(seen.select("th", "size", "head").join(some.select("th"), "th", "left_semi").dropDuplicates(["th"]), "prefixes")
    pending, kept, gone = first, None, first.select("th").where("false")
    while True:
        went = _one_of_each_component(pending, keyed, words, similarity)
        tops = pending.join(went.select("th"), "th", "left_anti")
        mine = prefixes(tops)
        out = _losers(similar(mine, mine, keyed, words, similarity), first)
        mine = mine.join(out, "th", "left_anti")
        kept = mine if kept is None else kept.union(mine)
        gone = gone.union(out).union(went.select("th"))
        left = cut(went.join(out.select(F.col("th").alias("by")), "by", "left_semi").select("th"))
        if left.isEmpty():
            break
        near = similar(prefixes(left), kept, keyed, words, similarity).select(F.col("a").alias("th")).distinct()
        back = cut(left.join(near, "th", "left_anti"))
        if back.isEmpty():
            break
        gone = cut(gone.join(back, "th", "left_anti"))
        pending = cut(first.join(back, "th", "left_semi"))
    gone = cut(member.join(first, met(member, first), "left_anti").select("doc_id", "th").union(first.join(gone, "th", "left_semi").select("doc_id", "th")).distinct())
    again = cut(seen.groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th"))
    # the rows travel in a struct, so that their columns may have any names
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("th"))
    out = _by_keys(rows, gone, "left_anti")
    if not again.isEmpty():
        out = _by_keys(out, again, "left_anti").unionByName(_by_keys(out, again, "left_semi").dropDuplicates(["doc_id", "th"]))
    return out.select("row.*")


#: Keys of documents that are broadcast, so that their texts need no shuffle; more are joined by one.
NAMED = 1_000_000


def _by_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    named = F.broadcast(keys) if keys.count() <= NAMED else keys
    return rows.join(named, rows["doc_id"].eqNullSafe(keys["doc_id"]) & (rows["th"] == keys["th"]), how)
