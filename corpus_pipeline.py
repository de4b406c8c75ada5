"""A training-data pipeline over ``documents``: each stage works on what the stage before it kept.

In every stage a null text counts as empty and a null doc_id is a document like others; an
empty table gives no row; extra columns stay, whatever their names. What that means for a
stage's decision stands with the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import mixing, packing, secrets, simhash, tokens, toxicity
from tidewatch.session import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject; the chain is fitted on the labelled ones among them.

    Empty texts have no features and stay unless most labelled rows are toxic; repeated rows share one verdict.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles.

    The smallest doc_id stays, null last; of rows that repeat doc_id and text one stays; all empty texts are one group.
    """
    return simhash.keep_one(docs, words=5, radius=4, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; texts without any, and null ones, stay as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens fit the target shares of source, language and topic.

    Texts without words stay, as they cost nothing; rows that repeat doc_id and text share one draw.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document; one piece is one sequence. An empty text has its end id alone; repeated rows are packed each."""
    return packing.pack(docs, tokens.tokenizer_path("word_bpe_49k.json"), end_id=2).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A stage's models and tokenizer are beyond SQL; tests/llm holds the operators of the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
