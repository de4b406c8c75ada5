import random

from pyspark.sql import functions as F

from tidewatch.llm import tokencount
from tidewatch.llm.tokens import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def library(texts):
    from sentencepiece import SentencePieceProcessor

    return [len(x) for x in SentencePieceProcessor(model_file=MODEL).encode(texts, num_threads=1)]


def test_pre_tokens_add_up_to_the_text():
    rnd = random.Random(2)
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "\r\n", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "é", "é", "ﬁ", "①", "你好", "𝒳", "\x00", "　", "\xa0", "​", "﻿", "don't", "x" * 40, "0123", "();", ".\n", "Ж"]
    own = tokencount.pieces(MODEL)
    assert own.cuts
    texts = parts + ["", " a", "a ", "   ", "\n a \n"] + ["".join(rnd.choices(parts, k=rnd.randint(2, 25))) for _ in range(3000)]
    got = [sum(own.counts(own.pretokens(t))) if t else 0 for t in texts]
    assert got == library(texts)
    assert all("".join(own.pretokens(t)) == " " + t.replace("▁", " ") for t in texts if t)


def check(spark, docs, rows, **options):
    got = tokencount.count_tokens(docs, MODEL, **options).collect()
    texts = [t or "" for _, t in rows]
    want = [(i, len(t.encode()), n, n > options.get("limit", 4096)) for (i, _), t, n in zip(rows, texts, library(texts))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_counts_are_the_librarys(spark, odd_docs, odd_rows, no_docs):
    for head in (0, 50, 1 << 17):
        check(spark, odd_docs, odd_rows, limit=100, head=head)
    rows = [(2**60 + 1, "one two"), (None, "three \n four")]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rows)
    assert tokencount.count_tokens(no_docs, MODEL).count() == 0


def test_distinct_pre_tokens_are_counted_once(spark, odd_docs):
    words = tokencount.vocabulary(odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), MODEL)
    assert words.count() == words.select("part").distinct().count()
    assert words.where("part = ' one'").first().total == 4


def test_frequent_pre_tokens_are_no_key_of_the_shuffle(spark):
    rows = [(i, f"the same words of all rows and {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, docs, rows, head=8)
