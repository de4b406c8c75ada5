import hashlib
import math
import random

import numpy as np

from tidewatch.llm import codes


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector, label), whole ones; one distance at a time."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    whole = [[math.floor(x * scale) if abs(x) < 1e200 else int(x) * scale for x in v] + [0] * (-len(v) % parts) for _, v, _ in rows]
    width = len(whole[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(v[p], books[p])[1] for v in cut]
            for e in set(own):
                mine = [v[p] for v, o in zip(cut, own) if o == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for (i, _, label), v in zip(rows, cut):
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total = {lab: sum(r[2] for r in out if r[3] == lab) for lab in {r[3] for r in out}}
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    fit = lambda x: x if x < 2**63 else None
    return sorted(((i, c, fit(d), None if any(r[2] >= 2**63 for r in out if r[3] == lab) else fit(total[lab]), sha) for i, c, d, lab in out), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c", 5) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    return sorted(map(tuple, codes.compress(df, **options).collect()), key=repr)


def clustered(n, width, seed):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i * 3, [c + rnd.gauss(0, 0.2) for c in rnd.choice(centres)], rnd.choice([1, 2, None])) for i in range(n)]


def test_odd_vectors(spark):
    rows = clustered(420, 8, 1)
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (5, rows[1][1], None), (None, rows[2][1], 2), (2**60 + 1, [0.0] * 8, 2)]
    bad = [(6, None, 1), (7, [0.0] * 7 + [None], 1), (8, [float("nan")] + [0.0] * 7, 1), (9, [float("-inf")] + [0.0] * 7, 1), (10, [0.5] * 5, 1), (11, [], 1)]
    assert run(spark, rows + bad) == plain(rows)
    assert run(spark, []) == []
    assert run(spark, bad[:4]) == []


def test_few_rows_and_lengths_that_are_no_multiple(spark):
    rows = [(i, [0.1 * i, -0.2 * i, 3.0, 1e-9, -1e-9, float(i % 3)], None) for i in range(9)]
    assert run(spark, rows, entries=4, rounds=3) == plain(rows, entries=4, rounds=3)
    assert run(spark, rows[:1]) == plain(rows[:1])


def test_huge_components_are_exact(spark):
    rows = [(i, [x * 10.0**e for x in (1.0, -2.0, 3.0, float(i))], 1) for i, e in enumerate([0, 5, 9, 15, 18, 30, 100, 300, 304, 0, 6])]
    assert run(spark, rows, entries=3, rounds=2) == plain(rows, entries=3, rounds=2)


def test_candidates_are_few_and_hold_the_nearest():
    rng = np.random.default_rng(0)
    entries = np.floor(rng.normal(0, 1, (200, 16)) * 1024).astype(np.int64)
    entries[7] = entries[90]
    x = np.concatenate([entries + rng.integers(-90, 90, entries.shape), rng.integers(-4000, 4000, (50, 16)), entries[[7, 90]]])
    own = codes.Slices(entries)
    code, error = own.nearest(x)
    far = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (code == far.argmin(1)).all() and (error == far.min(1)).all() and code[-1] == 7
    near = codes.Slices(entries)
    near.nearest(x[:200])
    # rows near an entry look at few others
    assert near.looked == 200 <= near.candidates < 0.05 * 200 * len(entries)
    wide, error = codes.Slices(entries.astype(object)).nearest(x[:40].astype(object))
    assert (wide == code[:40]).all()


def test_decode_names_the_entries():
    books = codes.Codebooks(np.arange(24).reshape(4, 3, 2), 7, 1024)
    assert books.decode("00010202") == [0, 1, 8, 9, 16, 17, 22]
