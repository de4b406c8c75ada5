import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import ctw
from tidewatch.llm.common import Table


def brute(rows, deep):
    """Plain context-tree weighting and unigram base, one decision at a time."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, (t or "").translate(low)) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    tok = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t) if w] + [None]
    c = Counter(w for (_, t), h in zip(texts, held) if not h for w in tok(t))
    n, v = sum(c.values()), len(c)

    def decisions(t):
        b = b"\xff" * deep + t.encode() + b"\xff"
        for p in range(deep, len(b)):
            for i in range(8):
                yield b[p - deep : p], (1 << i) | (b[p] >> (8 - i)), b[p] >> (7 - i) & 1

    count = {}
    for (_, t), h in zip(texts, held):
        if not h:
            for ctx, j, bit in decisions(t):
                for d in range(deep + 1):
                    count.setdefault((d, ctx[deep - d :], j), [0, 0])[bit] += 1
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
    pw, kids = {}, {}
    for d, ctx, j in sorted(count, key=lambda x: -x[0]):
        k = kt(*count[d, ctx, j])
        pw[d, ctx, j] = k if d == deep else math.log(0.5) + np.logaddexp(k, kids[d, ctx, j])
        if d:
            up = (d - 1, ctx[1:], j)
            kids[up] = kids.get(up, 0.0) + pw[d, ctx, j]

    def p1(ctx, j):
        a, r, out = 0.0, 1.0, 0.5
        for d in range(deep + 1):
            at = (d, ctx[deep - d :], j)
            if at not in count:
                break
            n0, n1 = count[at]
            g = (n1 + 0.5) / (n0 + n1 + 1)
            out = a + r * g
            beta = 1.0 if d == deep else math.exp(math.log(0.5) + kt(n0, n1) - pw[at])
            a, r = a + r * beta * g, r * (1 - beta)
        return out

    out = []
    for (i, t), h in zip(texts, held):
        w = tok(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        s = sum(math.log10(p1(ctx, j) if bit else 1 - p1(ctx, j)) for ctx, j, bit in decisions(t))
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, base, s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("depth,head", [(5, 2_000_000), (6, 800), (2, 0)])
def test_scores_brute_force(spark, odd_rows, depth, head):
    # one text stays whole and long
    rows = [(i, t if t is None or len(t) < 6000 else t[:20_000]) for i, t in odd_rows]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), depth=depth, head=head).collect()
    got, want = sorted(map(tuple, got), key=repr), brute(rows, depth)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:7] for r in got] == [pytest.approx(r[5:], rel=1e-7) for r in want]
    size = {i: len((t or "").encode()) + 1 for i, t in rows if i != 3}
    assert all(r[7] == pytest.approx(-r[6] * math.log2(10) / size[r[0]]) for r in got if r[0] in size and r[0] is not None)


def test_held_out_texts_are_scored_better_than_by_unigrams(spark):
    rows = [(i, " ".join(f"word{(i * k) % 50}" for k in range(60))) for i in range(120)]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def test_deeper_contexts_score_held_out_tables_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = [ctw.score(docs, depth=d).where("held_out").agg({"score": "sum", "base_score": "sum"}).first() for d in (3, 5)]
    assert told[1]["sum(score)"] > told[0]["sum(score)"]


def test_no_documents(no_docs):
    assert ctw.score(no_docs).count() == 0


def test_table():
    rnd = np.random.default_rng(0)
    keys = np.unique(rnd.integers(0, 2**63, 5000).astype(np.uint64))
    t = Table(keys, np.arange(len(keys), dtype=float))
    v, f = t.get(np.concatenate([keys, keys + np.uint64(1)]))
    assert f[: len(keys)].all() and v[: len(keys)].tolist() == list(range(len(keys)))
    assert (f[len(keys) :] == np.isin(keys + np.uint64(1), keys)).all()
