"""Token counts of whole texts by a SentencePiece model, from its pre-tokens alone.

A text is cut where no piece of the model can reach across: before a run of spaces, and
before a line break. Pieces are counted once for each distinct pre-token of the corpus; the
counts are joined to each document's pre-token frequencies and summed, so no text is encoded
and no id leaves the library.

The join is dealt by frequency: the most frequent pre-tokens (``HEAD`` at most, of at most
``SHORT`` characters each) are broadcast to where the frequencies are made, the others go
through a shuffle join on the pre-token, one row for each document and rare pre-token. So a
pre-token that every document holds is never a key of the shuffle.

A model with pieces that cross such cuts, or that rewrites texts, has the whole text as its
one pre-token: right, if slower.

Nulls: a null text is empty, with no token; a null doc_id is kept. Repeated rows are counted
each. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import documents, slices
from tidewatch.session import stored

#: Pre-tokens whose counts are broadcast, and their greatest length in characters.
HEAD, SHORT = 1 << 17, 48
#: Distinct pre-tokens that a task counts before it hands them on.
FLUSH = 1 << 19
#: The library writes a space as this character, and takes it for one.
SPACE = "▁"
PRETOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")


class Pieces:
    """Pre-tokens of a text, and the number of a model's pieces in each."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        kept = "x  y\tz İ ﬁ\n é 　 "
        self.cuts = not any(SPACE in n.lstrip(SPACE) or "\n" in n for n in names) and self.model.normalize(kept) == SPACE + kept.replace(" ", SPACE)
        self.lead = len(self.model.encode("a"))

    def pretokens(self, text: str) -> list[str]:
        """The parts of a text, which begins with one more space for the library; their piece counts add up to the text's."""
        if not text:
            return []
        return PRETOKEN.findall(" " + text.replace(SPACE, " ")) if self.cuts else [text]

    def counts(self, parts: list[str]) -> list[int]:
        """Pieces of each pre-token; each is encoded behind a letter, from which it is cut off anyway."""
        if not self.cuts:
            return [len(x) for x in self.model.encode(parts, num_threads=1)]
        return [len(x) - self.lead for x in self.model.encode(["a" + p for p in parts], num_threads=1)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The worker's copy of a model."""
    return Pieces(path)


def vocabulary(docs: DataFrame, model: str) -> DataFrame:
    """(part, total, n): each distinct pre-token of (doc_id, text), its occurrences and its pieces."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = pieces(model), Counter()
        for pdf in slices(batches):
            for text in pdf["text"]:
                seen.update(own.pretokens(text))
            if len(seen) >= FLUSH:
                yield from frames(seen)
                seen.clear()
        yield from frames(seen)

    def frames(seen: Counter) -> Iterator[pd.DataFrame]:
        rows = pd.DataFrame({"part": list(seen), "total": list(seen.values())})
        yield from slices((rows[a : a + 20_000] for a in range(0, len(rows), 20_000)), "part")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces(model)
        for pdf in slices(batches, "part"):
            yield pdf.assign(n=own.counts(list(pdf["part"])))

    distinct = docs.mapInPandas(cut, "part string, total long").groupBy("part").agg(F.sum("total").alias("total"))
    return stored(distinct.mapInPandas(count, "part string, total long, n long"), "pieces")


def frequent(words: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the most frequent short pre-tokens: those above the lowest step of frequency that leaves at most ``most``.

    Steps are sixteenths of a power of two, so their counts are few, and no task sends more
    than what is taken.
    """
    short = words.where(F.length("part") <= SHORT).withColumn("step", F.floor(F.log2("total") * 16).cast("int"))
    taken, least = 0, None
    for r in sorted(short.groupBy("step").count().collect(), reverse=True):
        taken += r["count"]
        if taken > most:
            break
        least = r.step
    return {} if least is None else {r.part: r.n for r in short.where(F.col("step") >= least).select("part", "n").collect()}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of a documents table."""
    texts = documents(docs)
    words = vocabulary(texts, model)
    shared = texts.sparkSession.sparkContext.broadcast(frequent(words, head))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row a document: what the frequent pre-tokens sum to, and the frequencies of the others."""
        own, known, at = pieces(model), shared.value, TaskContext.get().partitionId() << 40
        for pdf in slices(batches):
            sums, rest = [], []
            for text in pdf["text"]:
                seen = Counter(own.pretokens(text))
                n = list(map(known.get, seen))
                if None in n:
                    rest.append([(p, f) for (p, f), x in zip(seen.items(), n) if x is None])
                    n = [x or 0 for x in n]
                else:
                    rest.append([])
                sums.append(sum(map(mul, n, seen.values())))
            key = range(at, at + len(pdf))
            at += len(pdf)
            size = [len(t.encode()) for t in pdf["text"]]
            yield pd.DataFrame({"key": key, "doc_id": pdf["doc_id"], "n_bytes": size, "n": sums, "rest": rest})

    # ids go to Python as strings: beside a null, numbers would be doubles there
    per_doc = texts.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(frequencies, "key long, doc_id string, n_bytes long, n long, rest array<struct<part:string,f:long>>")
    # what the frequent ones sum to goes along as a row of its own, which joins nothing
    first = F.struct(F.col("key").cast("string").alias("part"), F.col("n").alias("f"), F.lit(False).alias("rare"))
    others = F.transform("rest", lambda r: F.struct(r["part"].alias("part"), r["f"].alias("f"), F.lit(True).alias("rare")))
    rows = per_doc.select("key", "doc_id", "n_bytes", F.inline(F.concat(F.array(first), others)))
    each = words.select("part", F.col("n").alias("each"), F.lit(True).alias("rare"))
    joined = rows.join(each, ["part", "rare"], "left")
    counted = joined.groupBy("key", "doc_id", "n_bytes").agg(F.sum(F.col("f") * F.coalesce("each", F.lit(1))).alias("n_tokens"))
    return counted.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
