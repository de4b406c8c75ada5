"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each model is a ridge logistic regression
on counts of words and of word beginnings (inflected and compound forms of one stem) and
on the probabilities of the categories before it; for training those
probabilities are out-of-fold predictions, so a later model never sees an earlier one
that was fitted on the same row. Categories are learned from the label: toxic rows of the
sample are parted into ``kinds`` groups by spherical k-means over their features, each
group is a category, and the label itself is the last one.

The models are fitted on a bounded, documented sample: at most ``sample`` labelled rows
(those with the smallest hash of their doc_id). All words and beginnings of theirs whose
share of toxic and other rows differs by a z score of ``least_z`` or more are features.
Scoring covers every whole text.

Nulls: a null text has no words; null labels and labels without a document are left out;
a doc_id labelled twice counts as toxic if one label says so. With no row, or rows of
one class only, a category's probability is its share of the sample (0 of none).
Repeated rows and null doc_ids are scored like any row; extra columns are ignored (kept
by ``keep_clean``); an empty table gives no row.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded, documents, slices, spherical_k_means
from tidewatch.session import stored

LABEL = "toxic"
PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


#: Lengths of word beginnings.
STEMS = range(4, 9)
#: Words that a worker remembers.
CACHE = 100_000
#: Features, the most telling ones, by which toxic rows are grouped into kinds.
STRONGEST = 2_000


def words(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8; ASCII punctuation and white space part words (bytes are parted many times faster than characters)."""
    return text.lower().encode().translate(PUNCTUATION).split()


def traits(word: bytes) -> list[str]:
    """A word's features: itself and its beginnings."""
    w = word.decode()
    return [w, *(w[:k] + "*" for k in STEMS if len(w) >= k)]


class Known(dict):
    """Remembers which features of a vocabulary a word has."""

    def __init__(self, vocab) -> None:
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: bytes) -> tuple[str, ...]:
        if len(self) > CACHE:
            self.clear()
        self[word] = found = tuple(t for t in traits(word) if t in self.vocab)
        return found


class Rows:
    """A sparse matrix by entries, with dense columns behind it; column 0 is the intercept."""

    def __init__(self, n: int, width: int, row: np.ndarray, col: np.ndarray, value: np.ndarray, extra: tuple = ()) -> None:
        self.n, self.width, self.row, self.col, self.value, self.extra = n, width, row, col, value, extra

    @staticmethod
    def of(x: np.ndarray) -> Rows:
        row, col = np.nonzero(x)
        return Rows(*x.shape, row, col, x[row, col])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return sum((e * v for e, v in zip(self.extra, w[self.width :])), np.bincount(self.row, self.value * w[self.col], self.n))

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(self.col, self.value * r[self.row], self.width), [e @ r for e in self.extra]]

    def and_column(self, e: np.ndarray) -> Rows:
        return Rows(self.n, self.width, self.row, self.col, self.value, (*self.extra, e))

    def dense(self, at: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Rows ``at`` of some features (column 0 is no feature)."""
        place, order = np.full(self.n, -1), np.full(self.width, -1)
        place[at], order[features + 1] = np.arange(len(at)), np.arange(len(features))
        own = (place[self.row] >= 0) & (order[self.col] >= 0)
        out = np.zeros((len(at), len(features)), np.float32)
        out[place[self.row[own]], order[self.col[own]]] = self.value[own]
        return out


class Chain:
    """Fitted models: a vocabulary and per category a weight vector over [1, words, earlier probabilities]."""

    def __init__(self, vocab: list[str], names: list[str], weights: list[np.ndarray]) -> None:
        self.at, self.names, self.weights = {w: i for i, w in enumerate(vocab)}, names, weights
        self.known = Known(self.at)
        # stems have four letters or more, so a word with a feature begins like one
        self.heads = {f.rstrip("*").encode()[:4] for f in vocab}

    def features(self, text: str) -> Counter:
        heads, of = self.heads, self.known.__getitem__
        return Counter([f for w in words(text) if w[:4] in heads for f in of(w)])

    def matrix(self, counts: list[dict]) -> Rows:
        cells = [(i, self.at[w] + 1, n) for i, c in enumerate(counts) for w, n in c.items()]
        row, col, n = (np.array(x, np.int64) for x in zip(*cells)) if cells else (np.empty(0, np.int64),) * 3
        return Rows(len(counts), len(self.at) + 1, np.r_[np.arange(len(counts)), row], np.r_[np.zeros(len(counts), np.int64), col], np.r_[np.ones(len(counts)), np.log1p(n)])

    def predict(self, texts: list[str], rows: int = 500) -> np.ndarray:
        """Probabilities, one column per category."""
        if len(texts) > rows:
            return np.vstack([self.predict(texts[i : i + rows], rows) for i in range(0, len(texts), rows)])
        x = self.matrix([self.features(t) for t in texts])
        for w in self.weights:
            x = x.and_column(sigmoid(x.dot(w)))
        return np.column_stack(x.extra) if x.extra else np.empty((len(texts), 0))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: Rows | np.ndarray, y: np.ndarray, use: np.ndarray | None = None, ridge: float = 2.0, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression over the rows in ``use`` by Newton steps, each solved by conjugate gradients; the intercept is unpenalised."""
    x = Rows.of(x) if isinstance(x, np.ndarray) else x
    use = np.ones(x.n) if use is None else use.astype(float)
    w = np.zeros(x.width + len(x.extra))
    told = y[use > 0]
    if not len(told) or told.min() == told.max():
        w[0] = -30.0 if not len(told) or told.mean() == 0 else 30.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-9
    for _ in range(rounds):
        p = sigmoid(x.dot(w))
        curve = use * (p * (1 - p) + 1e-9)
        r = x.tdot(use * (y - p)) - penalty * w
        step, way, size = np.zeros(len(w)), r.copy(), r @ r
        least = 1e-10 * size
        for _ in range(60):
            turn = x.tdot(curve * x.dot(way)) + penalty * way
            a = size / (way @ turn)
            step += a * way
            r -= a * turn
            now = r @ r
            if now <= least:
                break
            way, size = r + now / size * way, now
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(x: Rows | np.ndarray, ys: list[np.ndarray], fold: np.ndarray, folds: int) -> list[np.ndarray]:
    """Weights per category; later ones see the out-of-fold probabilities of the earlier ones."""
    full, weights = Rows.of(x) if isinstance(x, np.ndarray) else x, []
    for y in ys:
        weights.append(fit_linear(full, y))
        out = np.zeros(len(y))
        for k in range(folds):
            out[fold == k] = sigmoid(full.dot(fit_linear(full, y, fold != k)))[fold == k]
        full = full.and_column(out)
    return weights


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000, kinds: int = 3, least_z: float = 4.0, folds: int = 5) -> Chain:
    """The chain, fitted on a bounded sample of labelled documents."""
    spark = docs.sparkSession
    told = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = stored(documents(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]), "labelled")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            c = [set(f for w in words(t) for f in traits(w)) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "word": [list(x) for x in c]})

    told = texts.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")).first()
    pos, neg = told.pos, told.neg
    each = texts.mapInPandas(counted, "y int, word array<string>").select("y", F.explode("word").alias("word"))
    a, b = F.sum((F.col("y") == 1).cast("int")), F.sum((F.col("y") != 1).cast("int"))
    odds = F.log((a + 0.5) / (pos - a + 0.5)) - F.log((b + 0.5) / (neg - b + 0.5))
    z = odds / F.sqrt(1 / (a + 0.5) + 1 / (pos - a + 0.5) + 1 / (b + 0.5) + 1 / (neg - b + 0.5))
    ranked = each.groupBy("word").agg(F.abs(z).alias("z"), F.count("*").alias("df")).where((F.col("df") > 1) & (F.col("z") >= least_z))
    strength = dict(sorted((r.word, r.z) for r in ranked.select("word", "z").collect()))
    chain = Chain(list(strength), [*(f"kind_{k + 1}" for k in range(kinds)), LABEL], [])
    shared = spark.sparkContext.broadcast(chain)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in slices(batches):
            c = [own.features(t) for t in pdf["text"]]
            cols = [np.fromiter(map(own.at.__getitem__, x), np.int32, len(x)).tobytes() for x in c]
            sizes = [np.fromiter(x.values(), np.int32, len(x)).tobytes() for x in c]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "mark": [zlib.crc32(t.encode()) for t in pdf["text"]], "cols": cols, "sizes": sizes})

    # of each text its features alone come to the driver, as numbers
    rows = texts.mapInPandas(featured, "doc_id long, y int, mark long, cols binary, sizes binary").toPandas().sort_values(["doc_id", "mark"], kind="stable")
    cols, sizes = ([np.frombuffer(v, np.int32) for v in rows[c]] for c in ("cols", "sizes"))
    row = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    flat = lambda parts: np.concatenate([*parts, np.empty(0, np.int32)])
    x = Rows(len(rows), len(strength) + 1, np.r_[np.arange(len(rows)), row], np.r_[np.zeros(len(rows), np.int64), flat(cols) + 1], np.r_[np.ones(len(rows)), np.log1p(flat(sizes))])
    y = (rows["y"].to_numpy() == 1).astype(float)
    fold = (rows["doc_id"].to_numpy(np.int64) * 2654435761 >> 16) % folds
    strong = np.argsort(-np.array([*strength.values()]), kind="stable")[:STRONGEST]
    chain.weights = fit_chain(x, categories(x, y, kinds, np.sort(strong)) + [y], fold, folds)
    return chain


def categories(x: Rows, y: np.ndarray, kinds: int, strong: np.ndarray) -> list[np.ndarray]:
    """Per kind which rows are toxic and nearest to its centre by the features ``strong``; a row without such features is of no kind."""
    own = np.flatnonzero(y == 1)
    unit = x.dense(own, strong)
    norm = np.linalg.norm(unit, axis=1)
    own, unit = own[norm > 0], unit[norm > 0]
    unit /= norm[norm > 0][:, None]
    nearest = (unit @ spherical_k_means(unit, kinds).T).argmax(1) if len(own) else np.empty(0, int)
    out = []
    for k in range(kinds):
        at = np.zeros(len(y))
        at[own[nearest == k]] = 1
        out.append(at)
    return out


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_<category>..., rejected) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = pd.DataFrame(shared.value.predict(list(pdf["text"])), columns=names)
            yield pd.concat([pdf[["doc_id"]].astype("Int64").reset_index(drop=True), p.assign(rejected=p.iloc[:, -1] >= threshold)], axis=1)

    return documents(docs).mapInPandas(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", rejected boolean")


def keep_clean(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("boolean")
    def rejected(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict(list(text))[:, -1] >= threshold)

    return bounded(docs).where(~rejected(F.coalesce(F.col("text"), F.lit(""))))
