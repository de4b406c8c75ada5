import re

import numpy as np
import pytest
import xxhash

from tidewatch.llm import covertree, simhash


def brute_print(text, n=4):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((sum(v >> b & 1 for v in h) * 2 > len(h)) << b for b in range(64))


def brute_components(rows, radius):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], f"{prints[i]:016x}", min(ids) if ids else None) for i in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("radius", [4, 10])
def test_near_duplicates_brute_force(odd_docs, odd_rows, radius):
    got = simhash.near_duplicates(odd_docs, 4, radius).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(odd_rows, radius)


def test_crowded_shards_are_cut_into_trees(spark):
    rnd = np.random.default_rng(1)
    base = rnd.integers(-(2**62), 2**62, 5)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rnd.integers(0, 62, (60, 2))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    out = []
    for tree_rows in (16_384, 20):
        edges = simhash.links(df, len(fps), 4, tree_rows=tree_rows).collect()
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        out.append([find(x) for x in fps])
    pairs = {(find(a), find(b)) for a in fps for b in fps if bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert out[0] == out[1]
    assert all(a == b for a, b in pairs)


def test_no_documents(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_top_k_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(0, 0.2, 12)] if i % 7 else [float(x) for x in np.round(rnd.normal(0, 0.05, 12), 1)], "x") for i in range(700)]
    rows += [(700, None, "x"), (701, [1.0, None], "x"), (702, [float("nan")] * 12, "x"), (703, [float("inf")] * 12, "x"), (None, [1.0] * 12, "x"), (720, [], "x"), (740, [2.0] * 3, "x"), (20, rows[20][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    got = covertree.top_k(df.where("vec_id % 20 = 0"), df, k=5, query_block=16, block=150).collect()
    ok = [(i, np.floor(64 * np.array(np.float32(v), float))) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in dict((i, v) for i, v in ok if i % 20 == 0).items():
        scored = sorted((-int(sum(a * b for a, b in zip(v, w))), j) for j, w in ok if j != i)
        # a query id that stands twice asks twice and is ranked over both its answers
        times = sum(1 for j, _ in ok if j == i)
        scored = sorted(scored * times)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.top_k(none, none).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in covertree.top_k(few.where("vec_id = 0"), few).collect()] == [(0, 1, 1, 64 * 128)]


def test_cover_tree_covers_separates_and_nests():
    rnd = np.random.default_rng(4)
    for p in (rnd.normal(size=(900, 6)), np.repeat(rnd.normal(size=(5, 3)), 80, 0), np.zeros((300, 2)), rnd.normal(size=(1, 4))):
        t = covertree.build(p)
        assert sorted(t["order"].tolist()) == list(range(len(p)))
        c, level = t["center"], t["level"]
        whole = max(np.linalg.norm(p - c[0], axis=1).max(), 1e-9)

        def below(x):
            return t["order"][t["first"][x] : t["first"][x] + t["size"][x]] if not t["kids"][x] else np.concatenate([below(y) for y in range(t["kid"][x], t["kid"][x] + t["kids"][x])])

        for x in range(len(c)):
            assert (c[x] == p[t["point"][x]]).all()
            assert np.linalg.norm(p[below(x)] - c[x], axis=1).max(initial=0) <= t["radius"][x] + 1e-9
            kids = range(t["kid"][x], t["kid"][x] + t["kids"][x])
            if len(kids):
                # the centre stays, its new children lie within its scale and over half of it apart
                assert t["point"][kids[0]] == t["point"][x]
                assert all(np.linalg.norm(c[y] - c[x]) <= whole / 2 ** level[x] + 1e-6 for y in kids)
        for i in range(1, int(level.max(initial=0)) + 1):
            centres = {int(t["point"][x]) for x in range(len(c)) if level[x] <= i}
            q = p[sorted(centres)]
            d = np.linalg.norm(q[:, None] - q[None], axis=2) + np.eye(len(q)) * 1e9
            assert d.min() > whole / 2**i - 1e-6


def test_top_k_of_large_components_is_exact(spark):
    import random

    from tidewatch.llm import covertree

    rnd = random.Random(12)
    rows = [(i, [rnd.choice([1.0, -1.0]) * rnd.random() * 3e6 for _ in range(64)]) for i in range(120)] + [(200 + i, [1e14 * rnd.random() for _ in range(64)]) for i in range(6)] + [(300, [1e300, -1e300] * 32), (301, [0.5] * 64)]
    whole = {i: [max(-(2**58), min(2**58, int(x * 64 // 1) if abs(x) < 1e200 else (2**60 if x > 0 else -(2**60)))) for x in v] for i, v in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in covertree.top_k(df.where("vec_id % 20 = 0"), df, k=5).collect()}
    for q in (i for i in whole if i % 20 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q))[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s if abs(s) < 2**63 else None) for s, i in scores]
