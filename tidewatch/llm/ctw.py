"""Language-model scoring by context-tree weighting over bytes.

Each byte is coded as eight binary decisions. A decision's node (1..255, the bits of the
byte so far) has a context tree over the ``depth`` bytes before it; every tree node keeps
how often each bit followed and estimates it with the Krichevsky-Trofimov rule, and the
estimates of all depths are mixed with the context-tree weights (half for stopping at a
node, half for its children).

1. ``counted``: one pass over all texts counts tokens and ``depth + 1``-byte grams per
   task, then Spark sums them. Grams of held-out texts take part with count 0, so that
   every gram of the corpus gets its probability from the tree.
2. ``tree``: grams lie by the last ``SPLIT`` context bytes over the tasks. There the tree
   is weighted from the leaves up to depth ``SPLIT``; the few levels above are weighted by
   joins; then the mixtures come down again and give each gram's log10 probability. A
   context that training never met ends the path at the deepest node that it did, so each
   decision stays a proper distribution.
3. ``score``: a second pass adds up each text's grams and tokens. The ``head`` most
   frequent grams and tokens (a proven bound) are broadcast; all others are joined, so
   neither the driver nor a task ever holds the model, and no text is read once a shard.

A text is its bytes and an end symbol, after ``depth`` start symbols (byte 0xFF, which
UTF-8 never holds). Tokens are told apart by 64-bit hashes.

Nulls: a null text is empty (one end token); a null doc_id is a training row. Repeated
rows count and are scored as often as they stand. Very long texts are handled in one
piece each. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Table, U, documents, lowered, ragged, slices, word_hashes
from tidewatch.session import cut, stored

DEPTH = 5
SPLIT = 3
HEAD = 2_000_000
#: The end token's hash, and kinds of counted items.
END, GRAM, TOKEN = U(0x5F3759DF00000001), 0, 1


def grams(raw: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-byte grams that end at each byte and end symbol, and each text's number of them."""
    start = b"\xff" * depth
    sizes = np.array([len(b) + 1 for b in raw], np.int64)
    flat = np.frombuffer(start + (b"\xff" + start).join(raw) + b"\xff", np.uint8) if raw else np.empty(0, np.uint8)
    x = flat.astype(U)
    g = x[depth:].copy()
    for d in range(1, depth + 1):
        g |= x[depth - d : len(x) - d] << U(8 * d)
    starts = np.cumsum(sizes + depth) - (sizes + depth)
    return g[ragged(starts, sizes)], sizes


def tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends, and each text's number of them."""
    h, sizes = word_hashes(raw)
    return np.insert(h, np.cumsum(sizes), END), sizes + 1


class Counts:
    """Keys counted with bounded memory: ``add`` gives what has to leave."""

    def __init__(self, kind: int, most: int = 1_200_000) -> None:
        self.kind, self.most, self.held, self.size = kind, most, [], 0

    def add(self, keys: np.ndarray, weight: int) -> list[pd.DataFrame]:
        k, n = np.unique(keys, return_counts=True)
        self.held.append((k, n * weight))
        self.size += len(k)
        if self.size <= self.most:
            return []
        self.merge()
        return self.flush() if self.size > 3 * self.most // 4 else []

    def merge(self) -> None:
        k, back = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        self.held = [(k, np.bincount(back, np.concatenate([n for _, n in self.held])).astype(np.int64))]
        self.size = len(k)

    def flush(self) -> list[pd.DataFrame]:
        if not self.held:
            return []
        self.merge()
        (k, n), self.held, self.size = self.held[0], [], 0
        return [pd.DataFrame({"kind": np.full(len(part), self.kind, np.int32), "key": part.view(np.int64), "n": m}) for part, m in zip(np.array_split(k, len(k) // 200_000 + 1), np.array_split(n, len(n) // 200_000 + 1))]


def counted(texts: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n): training counts of grams and tokens; grams of held-out texts alone have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Counts(GRAM), Counts(TOKEN)
        for pdf in slices(batches):
            out = pdf["held_out"].to_numpy(bool)
            raw = [lowered(t) for t in pdf["text"]]
            for part, weight in (([r for r, h in zip(raw, out) if not h], 1), ([r for r, h in zip(raw, out) if h], 0)):
                if part:
                    yield from held[0].add(grams(part, depth)[0], weight)
                    if weight:
                        yield from held[1].add(tokens(part)[0], weight)
        for h in held:
            yield from h.flush()

    # the tasks have summed up already: first the exchange, then one aggregation
    return texts.mapInPandas(run, "kind int, key long, n long").repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x):
    """ln Gamma by Stirling's series after a shift by eight; for arrays and columns."""
    log = F.log if isinstance(x, Column) else np.log
    z, product = x + 8, x
    for i in range(1, 8):
        product = product * (x + i)
    inverse = 1 / z
    return (z - 0.5) * log(z) - z + 0.9189385332046727 + inverse * (1 / 12 - inverse * inverse * (1 / 360 - inverse * inverse / 1260)) - log(product)


def kt(n0, n1):
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - float(np.log(np.pi))


class Level:
    """Nodes of one depth for the symbols (context, byte) of sorted arrays: per bit i a node id by symbol, and counts by node."""

    def __init__(self, ctx: np.ndarray, byte: np.ndarray, n: np.ndarray) -> None:
        self.ctx, self.byte, self.n = ctx, byte, n
        self.node, self.n0, self.n1, self.first = [], [], [], []
        other = np.r_[True, ctx[1:] != ctx[:-1]]
        for i in range(8):
            top = byte >> U(8 - i)
            new = other | np.r_[True, top[1:] != top[:-1]]
            at = np.cumsum(new) - 1
            one = (byte >> U(7 - i)) & U(1) == 1
            m = int(at[-1]) + 1
            self.node.append(at)
            self.first.append(np.flatnonzero(new))
            self.n0.append(np.bincount(at, np.where(one, 0, n), m))
            self.n1.append(np.bincount(at, np.where(one, n, 0), m))

    def above(self, depth: int) -> tuple["Level", np.ndarray]:
        """The level of depth ``depth`` and the place there of each symbol here."""
        ctx = self.ctx & U((1 << 8 * depth) - 1)
        order = np.lexsort((self.byte, ctx))
        c, b = ctx[order], self.byte[order]
        new = np.r_[True, (c[1:] != c[:-1]) | (b[1:] != b[:-1])]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        return Level(c[at], b[at], np.add.reduceat(self.n[order], at)), place


class Tree:
    """The part of the context tree under whole contexts of ``split`` bytes, weighted from the leaves up."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int, split: int) -> None:
        ctx, byte = gram >> U(8), gram & U(255)
        self.order = np.lexsort((byte, ctx))
        level = Level(ctx[self.order], byte[self.order], n[self.order])
        self.levels, self.places, self.pw, self.beta = [level], [], [], []
        pw = [kt(a, b) for a, b in zip(level.n0, level.n1)]
        self.pw.append(pw)
        self.beta.append([np.ones(len(p)) for p in pw])
        for d in range(depth - 1, split - 1, -1):
            up, place = level.above(d)
            now, stop = [], []
            for i in range(8):
                kids = np.bincount(up.node[i][place[level.first[i]]], pw[i], len(up.n0[i]))
                own = kt(up.n0[i], up.n1[i])
                total = np.log(0.5) + np.logaddexp(own, kids)
                now.append(total)
                stop.append(np.exp(np.log(0.5) + own - total))
            pw, level = now, up
            self.levels.append(up)
            self.places.append(place)
            self.pw.append(pw)
            self.beta.append(stop)

    def tops(self) -> pd.DataFrame:
        """(ctx, j, n0, n1, pw) of the nodes of depth ``split``."""
        top, parts = self.levels[-1], []
        for i in range(8):
            f = top.first[i]
            j = (U(1) << U(i)) | (top.byte[f] >> U(8 - i))
            parts.append(pd.DataFrame({"ctx": top.ctx[f].view(np.int64), "j": j.astype(np.int32), "n0": top.n0[i], "n1": top.n1[i], "pw": self.pw[-1][i]}))
        return pd.concat(parts, ignore_index=True)

    def scores(self, ctx: np.ndarray, j: np.ndarray, a: np.ndarray, r: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of each gram, given what comes down to the top nodes (ctx, j): mixed part a, weight left r, probability p of a path that ends above."""
        key = (ctx << U(8)) | j.astype(U)
        order = np.argsort(key)
        key, a, r, p = key[order], a[order], r[order], p[order]
        out = 0.0
        for i in range(8):
            for k in range(len(self.levels) - 1, -1, -1):
                level = self.levels[k]
                f = level.first[i]
                if k == len(self.levels) - 1:
                    at = np.searchsorted(key, (level.ctx[f] << U(8)) | (U(1) << U(i)) | (level.byte[f] >> U(8 - i)))
                    mixed, left, end = a[at], r[at], p[at]
                else:
                    up = self.levels[k + 1].node[i][self.places[k][f]]
                    mixed, left, end = mixed[up], left[up], end[up]
                n0, n1, beta = level.n0[i], level.n1[i], self.beta[k][i]
                guess = (n1 + 0.5) / (n0 + n1 + 1.0)
                end = np.where(n0 + n1 > 0, mixed + left * guess, end)
                mixed, left = mixed + left * beta * guess, left * (1 - beta)
            level = self.levels[0]
            one = (level.byte >> U(7 - i)) & U(1) == 1
            q = end[level.node[i]]
            out = out + np.log10(np.where(one, q, 1 - q))
        back = np.empty(len(out))
        back[self.order] = out
        return back


def _groups(rows: int = 60_000):
    """Batches sorted by ``group``, cut so that no group is parted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < rows:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = (pdf["grp"] == pdf["grp"].iloc[-1]).to_numpy()
            if not last.all():
                yield pdf[~last].reset_index(drop=True)
            held, size = [pdf[last]], int(last.sum())
        if size:
            yield pd.concat(held, ignore_index=True)

    return run


def _upper(tops: DataFrame, split: int) -> DataFrame:
    """(ctx, j, a, r, p) for the nodes of depth ``split``: what comes down to them from the levels above, which are few."""
    low = F.lit(float(np.log(0.5)))
    levels = [tops]
    for depth in range(split - 1, -1, -1):
        up = levels[-1].groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * depth) - 1)).alias("ctx"), "j").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("kids"))
        up = up.withColumn("kt", kt(F.col("n0"), F.col("n1")))
        top, gap = F.greatest("kt", "kids"), F.abs(F.col("kt") - F.col("kids"))
        up = up.withColumn("pw", low + top + F.log1p(F.exp(-gap)))
        levels.append(cut(up.select("ctx", "j", "n0", "n1", "pw", F.exp(low + F.col("kt") - F.col("pw")).alias("beta"))))
    guess = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    down = None
    for depth, level in enumerate(levels[::-1]):
        here = level
        if depth == 0:
            here = here.withColumns({"a": F.lit(0.0), "r": F.lit(1.0), "p": F.lit(0.5)})
        else:
            above = down.select(F.col("ctx").alias("up"), F.col("j").alias("uj"), "a", "r", "p")
            here = here.join(above, (F.col("ctx").bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1)) == F.col("up")) & (F.col("j") == F.col("uj")))
        if depth == split:
            return here.select("ctx", "j", "a", "r", "p")
        met = F.col("n0") + F.col("n1") > 0
        down = here.select("ctx", "j", (F.col("a") + F.col("r") * F.col("beta") * guess).alias("a"), (F.col("r") * (1 - F.col("beta"))).alias("r"), F.when(met, F.col("a") + F.col("r") * guess).otherwise(F.col("p")).alias("p"))


def tree(counts: DataFrame, depth: int, split: int = SPLIT) -> DataFrame:
    """(key, s): log10 probability of each gram (key, n), given its context."""
    split = min(split, depth)
    group = lambda ctx: F.expr(ctx).bitwiseAND(F.lit((1 << 8 * split) - 1))
    rows = counts.select(group("shiftright(key, 8)").alias("grp"), "key", "n").repartition("grp").sortWithinPartitions("grp")

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups()(batches):
            yield Tree(pdf["key"].to_numpy(np.int64).view(U), pdf["n"].to_numpy(float), depth, split).tops()

    tops = cut(rows.mapInPandas(up, "ctx long, j int, n0 double, n1 double, pw double"))
    came = _upper(tops, split).select(F.col("ctx").alias("grp"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("n"), "j", "a", "r", "p")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("j", "int"), ("a", "double"), ("r", "double"), ("p", "double"))]
    both = counts.select(group("shiftright(key, 8)").alias("grp"), "key", "n", *none).union(came).repartition("grp").sortWithinPartitions("grp")

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups()(batches):
            is_top = pdf["j"].notna().to_numpy()
            own, top = pdf[~is_top], pdf[is_top]
            key = own["key"].to_numpy(np.int64).view(U)
            s = Tree(key, own["n"].to_numpy(float), depth, split).scores(top["grp"].to_numpy(np.int64).view(U), top["j"].to_numpy(np.int64), *(top[c].to_numpy(float) for c in ("a", "r", "p")))
            yield pd.DataFrame({"key": key.view(np.int64), "s": s})

    return both.mapInPandas(down, "key long, s double")


def _head(values: DataFrame, most: int) -> Table:
    """The most frequent items, ``most`` at most: all above a count that a histogram of counts gives."""
    step = F.floor(F.log2(F.greatest("n", F.lit(1))) * 16).cast("int")
    sizes = dict(values.groupBy(step.alias("b")).count().collect())
    least, have = 10**9, 0
    for b in sorted(sizes, reverse=True):
        have += sizes[b]
        if have > most:
            break
        least = b
    t = values.where(step >= least).select("key", "v").toArrow()
    return Table(t.column("key").to_numpy().astype(np.int64).view(U), t.column("v").to_numpy().astype(float))


def score(docs: DataFrame, held_out: int = 2, folds: int = 7, depth: int = DEPTH, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    A document is held out of training if crc32(doc_id as text) mod ``folds`` is
    ``held_out``; depth: context bytes, 6 at most; head: most grams that are broadcast,
    and a quarter of it the most tokens.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6")
    spark = docs.sparkSession
    texts = documents(docs).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(False)))
    counts = stored(counted(texts, depth), "counts")
    words = counts.where(F.col("kind") == TOKEN)
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = float(np.log10(total + kinds + 1))
    pairs = counts.where(F.col("kind") == GRAM).select("key", "n")
    values = stored(tree(pairs, depth).join(pairs, "key").select(F.lit(GRAM).alias("kind"), "key", "n", F.col("s").alias("v")).union(words.select("kind", "key", "n", F.log10(F.col("n") + 1.0).alias("v"))), "values")
    shared = spark.sparkContext.broadcast(tuple(_head(values.where(F.col("kind") == k), m) for k, m in ((GRAM, head), (TOKEN, head // 4))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_grams, of_tokens = shared.value
        for pdf in slices(batches):
            raw = [lowered(t) for t in pdf["text"]]
            out = pdf[["rid", "doc_id", "held_out"]].assign(bytes=[len(r) + 1 for r in raw])
            rare = []
            for keys, sizes, table, sums in ((*grams(raw, depth), of_grams, "score"), (*tokens(raw), of_tokens, "base")):
                v, found = table.get(keys)
                v[~found] = 0
                starts = np.cumsum(sizes) - sizes
                out[sums] = np.add.reduceat(v, starts)
                lost = np.flatnonzero(~found)
                rare.append(np.split(keys[lost].view(np.int64), np.searchsorted(lost, starts[1:])))
                if sums == "base":
                    known = np.add.reduceat(found.astype(np.int64), starts)
                    out = out.assign(n_tokens=sizes, n_known=known, base=out["base"] - scale * sizes)
            yield out.assign(rare_grams=rare[0], rare_tokens=rare[1]).astype({"doc_id": "Int64"})

    schema = "rid long, doc_id long, held_out boolean, bytes long, score double, base double, n_tokens long, n_known long, rare_grams array<long>, rare_tokens array<long>"
    parts = stored(texts.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(run, schema), "scores")
    sides = [parts.select("rid", F.lit(k).alias("kind"), F.explode(c).alias("key")) for k, c in ((GRAM, "rare_grams"), (TOKEN, "rare_tokens"))]
    rare = sides[0].union(sides[1]).join(values.select("kind", "key", "v"), ["kind", "key"]).groupBy("rid").agg(*[F.sum(F.when(F.col("kind") == k, x).otherwise(F.lit(0).cast(t))).alias(c) for k, x, t, c in ((GRAM, F.col("v"), "double", "more"), (TOKEN, F.col("v"), "double", "more_base"), (TOKEN, F.lit(1).cast("long"), "long", "more_known"))])
    out = parts.drop("rare_grams", "rare_tokens").join(rare, "rid", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0).cast(dict(out.dtypes)[a].replace("bigint", "long")))).alias(a)
    out = out.select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "more_base"), plus("score", "more"), "bytes")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.col("base").alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"))
