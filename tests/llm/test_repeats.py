import hashlib
import random
import re
from collections import Counter

import pytest

from tidewatch.llm import repeats


def brute(rows, window):
    docs = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for _, t in rows]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for (key, _), d in zip(rows, docs):
        gone = set()
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((key, len(d), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def planted():
    rnd = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage, line, other = words(60), words(9), words(35)
    rows = []
    for i in range(120):
        d = words(rnd.randint(0, 200))
        at = rnd.randint(0, len(d))
        if i % 3 == 0:
            d[at:at] = passage[rnd.randint(0, 20) : rnd.randint(30, 60)]
        if i % 10 == 1:
            d[at:at] = line * 12
        if i in (5, 50):
            d[at:at] = other
        if i in (7, 70):
            d[at:at] = other[:34]
        rows.append((i, " ".join(d)))
    rows += [(200 + i, "same " * 100) for i in range(4)]
    return rows


@pytest.mark.parametrize("group_rows", [4096, 1])
def test_removal_brute_force(spark, odd_rows, group_rows):
    rows = planted() + [(None if i is None else i + 1000, t) for i, t in odd_rows] + [(1, "same id other text " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(df, 35, group_rows).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 35)


def test_other_window_and_nothing(spark, no_docs):
    rows = planted()
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr) == brute(rows, 20)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.remove_repeats(no_docs).count() == 0
