"""Exact top-k inner-product search with dual cover trees.

Candidates are dealt into bounded blocks and each block becomes one cover tree: centres of
a level lie over its scale apart, children lie within the scale of their parent and stay
centres at deeper levels, and every node knows its covering radius. Queries are dealt and
indexed the same way. Every
query tree then meets every candidate tree (a stated query set against all rows, in
blocks) and both are descended together: a pair of nodes is dropped when even the bound
``cq.cr + rq|cr| + rr|cq| + rq rr`` stays under the worst k-th score that the query
group holds. The k best per query and block are merged by a window over
``k x blocks`` rows a query.

Vectors that are null or hold null or non-finite components take no part; vectors of
different length are compared over zero-padded components. Ties go to the smaller
vec_id. Repeated vec_ids are separate candidates, but a row never answers a query with
its own vec_id. Scaled components beyond 2**58 count as that; a score that no long holds is
ranked by its value and given as null. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 96
#: Greatest scaled component: the scores of vectors of up to a thousand of them fit a decimal.
MOST = 2.0**58


def farthest_first(p: np.ndarray, leaf: int = LEAF) -> tuple[list[int], list[float], np.ndarray]:
    """Centres in farthest-first order, each one's distance to the centres before it, and the nearest centre of every point.

    Ends when no centre has more than ``leaf`` points or all points lie on centres.
    """
    sq = (p * p).sum(1)

    def away(i: int) -> np.ndarray:
        return np.sqrt(np.maximum(sq - 2 * (p @ p[i]) + sq[i], 0.0))

    first = int(((p - p.mean(0)) ** 2).sum(1).argmin())
    d, own = away(first), np.zeros(len(p), np.int64)
    d[first] = 0
    centres, gaps, counts = [first], [float("inf")], [len(p)]
    while max(counts) > leaf:
        far = int(d.argmax())
        if d[far] <= 1e-6:
            break
        centres.append(far)
        gaps.append(float(d[far]))
        dn = away(far)
        dn[far] = 0
        closer = dn < d
        own[closer] = len(centres) - 1
        d[closer] = dn[closer]
        counts = np.bincount(own, minlength=len(centres)).tolist()
    return centres, gaps, own


def build(points: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree as arrays: order, and per node first, size, center, radius, kids (first, count), level.

    Level i has the centres that lie over R / 2**i from all before them in farthest-first
    order (R: radius of the whole). So centres of a level lie over that scale apart
    (separation), every centre is within the scale above of its parent (covering) and stays
    a centre at all deeper levels (nesting). Levels at which a centre gains no child are left out.
    """
    p = points.astype(np.float64)
    if not len(p):
        none = np.empty(0, np.int64)
        return {"order": none, "first": none, "size": none, "center": np.empty((0, p.shape[1])), "radius": np.empty(0), "kid": none, "kids": none, "level": none, "point": none}
    centres, gaps, own = farthest_first(p)
    whole = float(np.sqrt(((p - p[centres[0]]) ** 2).sum(1).max()))
    level = [0] + [max(1, int(np.floor(np.log2(whole / g))) + 1) for g in gaps[1:]]
    # rounding must not put a centre a level too high or low
    level = [0] + [next(i for i in range(max(1, n - 1), n + 3) if g > whole / 2**i) for n, g in zip(level[1:], gaps[1:])]
    c = p[centres]
    children: list[dict[int, list[int]]] = [{} for _ in centres]
    for k in range(1, len(centres)):
        above = [j for j in range(k) if level[j] < level[k]]
        nearest = above[int(((c[above] - c[k]) ** 2).sum(1).argmin())]
        children[nearest].setdefault(level[k], []).append(k)
    members = [np.flatnonzero(own == k) for k in range(len(centres))]
    nodes: list[list] = [[0, sorted(children[0].items())]]  # centre, levels of children still to open
    kid, kids = [], []
    at = 0
    while at < len(nodes):
        k, todo = nodes[at]
        kid.append(len(nodes) if todo else 0)
        if todo:
            nodes.append([k, todo[1:]])
            nodes += [[j, sorted(children[j].items())] for j in todo[0][1]]
        kids.append(len(nodes) - kid[-1] if todo else 0)
        at += 1
    first, size, below = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes), np.int64), [None] * len(nodes)
    radius = np.zeros(len(nodes))
    for x in range(len(nodes) - 1, -1, -1):
        k = nodes[x][0]
        below[x] = np.concatenate([below[y] for y in range(kid[x], kid[x] + kids[x])]) if kids[x] else members[k]
        size[x] = len(below[x])
        radius[x] = np.sqrt(((p[below[x]] - c[k]) ** 2).sum(1).max(initial=0.0))
    order, filled = [], 0
    for x in range(len(nodes)):
        if not kids[x]:
            first[x] = filled
            filled += len(below[x])
            order.append(below[x])
    return {
        "order": np.concatenate(order), "first": first, "size": size, "center": np.array([c[n[0]] for n in nodes]), "radius": radius, "kid": np.array(kid, np.int64), "kids": np.array(kids, np.int64),
        "level": np.array([level[n[0]] if not n[1] else n[1][0][0] - 1 for n in nodes], np.int64), "point": np.array([centres[n[0]] for n in nodes], np.int64),
    }


def pack(ids: np.ndarray, vectors: list) -> bytes:
    """A block of vectors with its cover tree, points in tree order."""
    width = max(map(len, vectors), default=0)
    m = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    tree = build(m)
    o = tree.pop("order")
    buf = io.BytesIO()
    np.savez(buf, ids=ids[o], points=m[o], **tree)
    return buf.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def widen(t: dict, width: int) -> dict:
    return t | {k: np.pad(t[k], ((0, 0), (0, width - t[k].shape[1]))) for k in ("points", "center")}


def dual(q: dict, r: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): for each query its k best in the candidate tree, fewer if there are fewer."""
    width = max(q["points"].shape[1], r["points"].shape[1])
    q, r = widen(q, width), widen(r, width)
    n = len(q["ids"])
    # doubles hold the scores of small components exactly; larger ones are summed as Python's integers
    tops = [int(np.abs(x["points"]).max(initial=0)) for x in (q, r)]
    exact = object if tops[0] * tops[1] * width >= 2**53 else np.float64
    best = np.full((n, k), -np.inf, exact)
    who = np.full((n, k), np.iinfo(np.int64).max)
    qp, rp = q["points"].astype(exact), r["points"].astype(exact)
    qnorm, rnorm = np.linalg.norm(q["center"], axis=1), np.linalg.norm(r["center"], axis=1)
    lowest = np.full(len(q["first"]), -np.inf)

    def bounds(a: int, rs: np.ndarray) -> np.ndarray:
        spare = q["radius"][a] * rnorm[rs] + r["radius"][rs] * qnorm[a] + q["radius"][a] * r["radius"][rs]
        return r["center"][rs] @ q["center"][a] + spare + 1e-6 + 1e-9 * (spare + rnorm[rs] * qnorm[a])  # rounding loses no pair

    def leaves(a: int) -> Iterator[int]:
        stack = [a]
        while stack:
            x = stack.pop()
            if q["kids"][x]:
                stack += range(q["kid"][x], q["kid"][x] + q["kids"][x])
            else:
                yield x

    # each query leaf descends the candidates best-first under its own worst k-th score; inner query nodes prune for all leaves below
    def scan(a: int, b: int) -> None:
        s, e = q["first"][a], q["first"][a] + q["size"][a]
        t, f = r["first"][b], r["first"][b] + r["size"][b]
        score = qp[s:e] @ rp[t:f].T
        ids = r["ids"][t:f]
        score[q["ids"][s:e, None] == ids[None, :]] = -np.inf
        all_s = np.concatenate([best[s:e], score], 1)
        all_i = np.concatenate([who[s:e], np.broadcast_to(ids, score.shape)], 1)
        all_i = np.where(all_s == -np.inf, np.iinfo(np.int64).max, all_i)
        if exact is object:
            top = np.array([sorted(range(len(x)), key=lambda j: (-x[j], y[j]))[:k] for x, y in zip(all_s, all_i)])
        else:
            top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        best[s:e] = np.take_along_axis(all_s, top, 1)
        who[s:e] = np.take_along_axis(all_i, top, 1)
        lowest[a] = float(best[s:e, -1].min())

    def floor(a: int) -> float:
        if not q["kids"][a]:
            return lowest[a]
        return min(lowest[x] for x in under[a])

    under = {a: list(leaves(a)) for a in range(len(q["first"])) if q["kids"][a]}
    stack = [(0, 0)] if n and len(r["ids"]) else []
    while stack:
        a, b = stack.pop()
        if bounds(a, np.array([b]))[0] < floor(a):
            continue
        if q["kids"][a] and (not r["kids"][b] or q["radius"][a] >= r["radius"][b]):
            stack += [(x, b) for x in range(q["kid"][a], q["kid"][a] + q["kids"][a])]
        elif r["kids"][b]:
            rs = np.arange(r["kid"][b], r["kid"][b] + r["kids"][b])
            up = bounds(a, rs)
            keep = up >= floor(a)
            rs, up = rs[keep], up[keep]
            stack += [(a, int(x)) for x in rs[np.argsort(up)]]  # the most promising comes off first
        else:
            scan(a, b)
    i, j = np.nonzero(best != -np.inf)
    return q["ids"][i], who[i, j], best[i, j].astype(np.int64 if exact is np.float64 else object)


def clean(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a double; without nulls, NaN and infinities."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(MOST)), F.lit(-MOST)))).alias("v"))


def trees(rows: DataFrame, n: int, block: int) -> DataFrame:
    """(block, tree): cover trees of bounded blocks of (vec_id, v)."""
    blocks = max(1, -(-n // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "tree": [pack(pdf["vec_id"].to_numpy(np.int64), list(pdf["v"]))]})

    return dealt.groupBy("block").applyInPandas(one, "block int, tree binary")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: float = 64.0, query_block: int = 1024, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): exact k largest inner products of every query."""
    q, c = clean(queries, scale), clean(candidates, scale)
    qn, cn = q.count(), c.count()
    qt = trees(q, qn, query_block).select(F.col("block").alias("qb"), F.col("tree").alias("qtree"))
    ct = trees(c, cn, block).select("block", "tree", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-qn // query_block) - 1)))).alias("qb"))
    pairs = ct.join(qt, "qb").repartition("qb", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qblob, cblob in zip(pdf["qtree"], pdf["tree"]):
                a, b, s = dual(unpack(qblob), unpack(cblob), k)
                wide = [Decimal(x) if abs(x) >= 2**63 else None for x in s.tolist()] if s.dtype == object else None
                yield pd.DataFrame({"query_id": a, "vec_id": b, "score": pd.array([None if abs(x) >= 2**63 else x for x in s.tolist()], "Int64") if wide else s, "wide": wide})

    found = pairs.mapInPandas(run, "query_id long, vec_id long, score long, wide decimal(38,0)")
    w = Window.partitionBy("query_id").orderBy(F.coalesce("wide", F.col("score").cast("decimal(38,0)")).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
