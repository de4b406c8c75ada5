import random

import corpus_pipeline
from tidewatch.llm import simhash


def jaccard(a, b):
    def s(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = s(a), s(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_one_of_each_group_stays(spark, odd_docs, odd_rows, no_docs):
    rnd = random.Random(4)
    base = [f"v{rnd.randint(0, 900)}" for _ in range(400)]
    rows = [(i, " ".join(base[:k] + ["new%d" % i] + base[k + 1 :]), "en", "s", 0) for i, k in enumerate(range(0, 400, 50))]
    rows += [(100 + i, " ".join(f"u{rnd.randint(0, 900)}" for _ in range(200)), "en", "s", 0) for i in range(30)]
    rows += [(200, rows[0][1], "en", "s", 0), (None, rows[0][1], "en", "s", 0), (100, rows[8][1], "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert got == [0] + list(range(100, 130))
    kept = simhash.keep_one(odd_docs).collect()
    texts = [r.text or "" for r in kept]
    assert all(any(jaccard(t or "", k) >= 0.8 for k in texts) for _, t in odd_rows)
    assert not any(jaccard(a, b) >= 0.99 for i, a in enumerate(texts) for b in texts[:i])
    assert simhash.keep_one(no_docs).count() == 0


def test_stages_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
    pieces = corpus_pipeline.run(spark, sf)
    ids = pieces.select("sequence_id").collect()
    assert len(ids) == len({r.sequence_id for r in ids}) > 0
    assert pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`").count() == 0


def test_near_copies_beyond_the_radius_go(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(120):
        base = [f"v{rnd.randint(0, 5000)}" for _ in range(rnd.choice([30, 60, 120]))]
        rows.append((3 * i, " ".join(base)))
        # one edit inside takes five shingles, words at the end take one each
        rows.append((3 * i + 1, " ".join(base[: len(base) - len(base) // 12])))
        rows.append((3 * i + 2, " ".join(base + [f"n{rnd.randint(0, 5000)}" for _ in range(len(base) // 8)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[max(0, i - 2) : i] if jaccard(a[1], b[1]) >= 0.8]
    fp = {r.doc_id: r.fp for r in simhash.fingerprints(df, 5).collect()}
    assert sum(((fp[a[0]] ^ fp[b[0]]) & (1 << 64) - 1).bit_count() > 8 for a, b in pairs) > 20
    kept = simhash.keep_one(df).collect()
    assert not any(jaccard(a.text, b.text) >= 0.8 for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(jaccard(t, k.text) >= 0.8 for k in kept) for _, t in rows)


def test_columns_of_any_name_stay(spark):
    rows = [(1, "one two three four five six seven", 7, 8, "x"), (2, "one two three four five six seven", 9, 10, "y"), (None, "", 1, 2, "z"), (3, None, 3, 4, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _th long, th long, component string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_long_chains_of_near_copies(spark):
    # each text is close to the next, none to those further on: components far longer than the rounds
    word = lambda i: f"w{i}"
    rows = [(i, " ".join(word(j) for j in range(6 * i, 6 * i + 100))) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(df).collect()
    assert not any(jaccard(a.text, b.text) >= 0.8 for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(jaccard(t, k.text) >= 0.8 for k in kept) for _, t in rows)


def run_stages(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_of_nothing_and_of_odd_rows(spark, no_docs, odd_docs, odd_rows, tmp_path):
    assert run_stages(spark, no_docs, tmp_path / "none").count() == 0
    pieces = run_stages(spark, odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), tmp_path / "odd").collect()
    ids = {r.doc_id for r in pieces}
    assert ids <= {i for i, _ in odd_rows} and len(ids) > 20
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in pieces)


def test_few_pairs_of_one_template_meet(spark):
    # all share the template, each has too many shingles of its own to be near another, yet too few to fill a prefix
    base = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(f"own{i}x{j}" if j % 40 == i % 40 else w for j, w in enumerate(base))) for i in range(160)]
    rows += [(1000 + i, " ".join(base[:100] + [f"near{i}"] + base[101:])) for i in range(6)]
    df = simhash.documents(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("th", simhash.F.xxhash64("text"))
    hot = spark.sparkContext.broadcast(simhash._hot_shingles(df, 5))
    heads = df.mapInPandas(simhash._described(5, 0.8, hot), df.sparkSession.createDataFrame([], "doc_id long, th long, fp long, size int, head array<long>").schema).cache()
    th = {r.doc_id: r.th for r in df.select("doc_id", "th").collect()}
    near = {tuple(sorted((th[a[0]], th[b[0]]))) for i, a in enumerate(rows) for b in rows[:i] if jaccard(a[1], b[1]) >= 0.8}
    met = [(r.a, r.b) for r in simhash._met(heads, heads, 0.8).select("a", "b").collect()]
    assert near <= set(met) and len(near) == 15
    assert len(met) < 40 * len(rows)
    assert {(r.a, r.b) for r in simhash.similar(heads, heads, df, 5, 0.8).collect()} == near
