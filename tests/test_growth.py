"""Work that must not be repeated within a row, or grow faster than the input."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import terms
from tidewatch.sources import payloads as P


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("use", [P.repository, P.longest_body, P.SHAPES["vulnerability"], P.SHAPES["weather"]])
def test_a_payload_is_parsed_once_for_its_rows_and_once_for_their_filter(spark, use):
    rows = spark.createDataFrame([('{"id": 1}',)], "entry string")
    if use is P.longest_body:
        made = rows.select(use(F.col("entry")).alias("r")).where("r is not null")
    elif use is P.repository:
        made = rows.select(use(F.try_parse_json("entry")).alias("r")).where("r.repo is not null").select("r.repo.*")
    else:
        made = P.items(rows, next(k for k, v in P.SHAPES.items() if v is use), "entry")
    assert 1 <= plan_of(made).lower().count("parsejson") + plan_of(made).count("parse_json") <= 2


def test_terms_are_found_in_one_pass_over_the_texts(spark):
    texts = spark.range(4).selectExpr("id AS item_key", "element_at(array('on the house', 'the end', 'On-the  house', 'on, the house'), int(id) + 1) AS text")
    found = terms.find_terms(texts, "item_key", ["text"], [("on the house", False), ("the", False), ("On the", True), ("absent", False)])
    assert plan_of(found).count("Range (") == 1
    assert {(r.item_key, r.term) for r in found.collect()} == {(0, "on the house"), (2, "on the house"), (2, "On the"), *((i, "the") for i in range(4))}


@pytest.mark.parametrize("most", [0, 1_000])
def test_listed_and_joined_words_find_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "LISTED", most)
    texts = spark.createDataFrame([(1, "a b", "c a-b"), (2, "b", None), (3, "", "A  B c"), (4, None, None)], "k int, title string, summary string")
    found = terms.find_terms(texts, "k", ["title", "summary"], [("a b", False), ("b c", False), ("B", True)])
    assert {tuple(r) for r in found.collect()} == {(1, "a b", False, True, True), (1, "b c", False, False, False), (3, "a b", False, False, True), (3, "b c", False, False, True), (3, "B", True, False, True)}


def test_an_index_moves_its_texts_less_often(spark, tmp_path):
    """Places are gathered without a shuffle of their own, and a first load merges with nothing."""
    from tidewatch.operators import search

    rows = spark.createDataFrame([(i, 1, f"one {i} two one", "body of many words " * 50) for i in range(200)], "item_key long, ingest_seq long, title string, body string")
    rows = rows.selectExpr("item_key", "timestamp '2024-01-01' AS fetched_at", "ingest_seq", "title", "body")
    index = search.SearchIndex(spark, str(tmp_path / "i"), ["title", "body"], buckets=4)
    before = set(_shuffles(spark))
    done = index.upsert(rows)
    # newest versions, postings by bucket, items by bucket
    assert len(set(_shuffles(spark)) - before) == 3
    assert {r.action for r in done.collect()} == {"inserted"}
    first = spark.read.parquet(str(tmp_path / "i" / "postings")).where("item_key = 7").select("word", "field", "at").collect()
    assert {(r.word, r.field): r.at for r in first}[("one", 0)] == [0, 3] and len(first) == 7
    assert {r.action for r in index.upsert(rows).collect()} == {"ignored"}


def _shuffles(spark):
    """Stages that wrote a shuffle."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [stages.apply(i).stageId() for i in range(stages.size()) if stages.apply(i).shuffleWriteBytes() > 0]
