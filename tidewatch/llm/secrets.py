"""Secret scans with character Markov models, in DataFrame functions only.

Base spans come from three patterns, leftmost and non-overlapping per kind. The method
adds spans: long runs of token characters are scored by two first-order character models,
one of random strings and one of ordinary identifiers, and a run is a secret if its
log-likelihood ratio is high in total and per character. Labelled samples, each distinct
value once and none as more than ``VALUE_PAIRS`` pairs: random are the values of all base
spans that are neither hexadecimal nor built like names, and generated digests (of one in
sixteen documents); ordinary are the long runs that no base span touches and that are built like names
(``NAME``: words, numbers and their separators). Of a run that meets
base spans, each uncovered piece is scored by itself, however short.

Positions are code points, end exclusive: the lengths of what lies between matches
(``split``) and of the matches (``regexp_extract_all``) are summed by a window over the
matches of a document. Only the two models, at most ``len(ALPHABET)**2`` pairs each, reach
the driver.

Nulls: a null text is empty. Rows are told apart by doc_id and text; rows that repeat
both return one row each with the same result. Extra columns are ignored; an empty table
gives no row, and with no labelled string every ratio is zero and nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import documents
from tidewatch.session import stored

#: Kinds in order: pattern, group that must be long enough, its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
RUN = r"[A-Za-z0-9+/_.=-]{16,}"
#: Words in one case, capitalised or joined with capitals, each with up to four digits behind; and numbers.
_PART = "(?:(?:[a-z]+|[A-Z]+|[a-z]{2,}(?:[A-Z][a-z]{2,})+|(?:[A-Z][a-z]{2,})+)[0-9]{0,4}|[0-9]{1,8})"
NAME = f"^[+/_.=-]*{_PART}(?:[+/_.=-]+{_PART})*[+/_.=-]*$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


def _matches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, kind, at, gap, whole, value): every match with the length of text before it since the last."""
    held = None
    for kind, (pattern, group, _) in {**KINDS, "random": (RUN, 0, 16)}.items():
        rows = docs.where(F.col("text").rlike(pattern))
        zipped = F.arrays_zip(
            F.transform(F.split("text", pattern, -1), F.length).alias("gap"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("whole"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value"),
        )
        rows = rows.select("doc_id", "th", F.lit(kind).alias("kind"), F.posexplode(zipped).alias("at", "m")).select("doc_id", "th", "kind", "at", F.col("m.gap").alias("gap"), F.col("m.whole").alias("whole"), F.col("m.value").alias("value"))
        held = rows if held is None else held.union(rows)
    return held.where(F.col("whole").isNotNull())


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, stop, value, covered) of base spans and of runs; covered: a run that meets a base span."""
    key = ["doc_id", "th"]
    found = _matches(docs).repartition(*key).dropDuplicates([*key, "kind", "at"])
    upto = Window.partitionBy(*key, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("whole")
    found = found.withColumn("stop", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("stop") - size)
    long_enough = F.lit(False)
    for kind, (_, _, least) in KINDS.items():
        long_enough = long_enough | ((F.col("kind") == kind) & (F.length("value") >= least))
    base = F.col("kind") != "random"
    found = found.where(~base | long_enough)
    order = Window.partitionBy(*key).orderBy("start", "stop", "kind")
    reached = F.max(F.when(base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    met = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(coming < F.col("stop"), F.lit(False))
    return found.select(*key, "kind", "start", "stop", "value", (~base & met).alias("covered"))


def remainders(found: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, stop, value, covered): the pieces of covered runs that lie in no base span, as covered runs."""
    key = ["doc_id", "th"]
    base = F.col("kind") != "random"
    one = F.when(base, 1).otherwise(0)
    run = F.when(~base, F.struct("start", "value"))
    edge = lambda at, step: F.struct(F.col(at).alias("at"), (one * step).alias("b"), ((1 - one) * step).alias("r"), (run if step > 0 else F.lit(None).cast("struct<start: bigint, value: string>")).alias("run"))
    edges = found.where(base | F.col("covered")).select(*key, F.explode(F.array(edge("start", 1), edge("stop", -1))).alias("e"))
    edges = edges.groupBy(*key, F.col("e.at").cast("long").alias("start")).agg(F.sum("e.b").alias("b"), F.sum("e.r").alias("r"), F.max("e.run").alias("run"))
    order = Window.partitionBy(*key).orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = edges.select(*key, "start", F.lead("start").over(order).alias("stop"), F.sum("b").over(upto).alias("in_base"), F.sum("r").over(upto).alias("in_run"), F.last("run", ignorenulls=True).over(upto).alias("run"))
    value = F.substring(F.col("run.value"), (F.col("start") - F.col("run.start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    return swept.where("in_base = 0 and in_run > 0").select(*key, F.lit("random").alias("kind"), "start", "stop", value.alias("value"), F.lit(True).alias("covered"))


def _codes(value: Column) -> Column:
    """Index of each character pair in a square table over the alphabet."""
    at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def pairs(x: Column) -> Column:
        less = F.greatest(F.size(x) - 1, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), less), F.slice(x, F.lit(2), less), lambda a, b: a * len(ALPHABET) + b)

    return F.get(F.transform(F.array(at), pairs), F.lit(0))


#: A value counts as so many pairs at most, however long; and the weight of single characters in a pair's estimate.
VALUE_PAIRS, BACKOFF = 64, 8.0


def chains(counts: dict[bool, list[float]]) -> list[float]:
    """ln P(b|a; random) - ln P(b|a; ordinary) of each pair of alphabet characters, from weighted pair counts.

    P(b|a) is estimated from the pairs and, with the weight of ``BACKOFF`` pairs, from how
    often b follows at all (half a count added), so that few samples already tell classes apart.
    """
    n = len(ALPHABET)
    rows = {}
    for kind, c in counts.items():
        single = [0.5 + sum(c[a * n + b] for a in range(n)) for b in range(n)]
        whole = sum(single)
        rows[kind] = [math.log((c[a * n + b] + BACKOFF * single[b] / whole) / (sum(c[a * n : a * n + n]) + BACKOFF)) for a in range(n) for b in range(n)]
    return [x - y for x, y in zip(rows[True], rows[False])]


def samples(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(random, value): the distinct labelled strings of both classes.

    Hexadecimal values have a pattern of their own; among the samples they would only hide
    what follows a digit in other random strings.
    """
    like_name = F.col("value").rlike(NAME)
    base = F.col("kind") != "random"
    random = base & (F.col("kind") != "hex") & ~like_name & ~F.col("value").rlike("^[0-9a-f]+$")
    labelled = found.where(~F.col("covered") & (random | (~base & like_name))).select(base.alias("random"), "value")
    made = docs.where(F.crc32(F.col("doc_id").cast("string")) % 16 == 0)
    digest = lambda salt: F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), F.col("doc_id").cast("string")), 256)))
    made = made.select(F.lit(True).alias("random"), F.explode(F.array(*map(digest, ("random", "string", "sample")))).alias("value"))
    return labelled.union(made).distinct()


def ratios(found: DataFrame, docs: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character pair, both chains trained on the labelled samples."""
    codes = samples(found, docs).select("random", _codes(F.col("value")).alias("codes"))
    weight = F.least(F.lit(1.0), VALUE_PAIRS / F.greatest(F.size("codes"), F.lit(1)))
    pairs = codes.select("random", F.explode("codes").alias("pair"), weight.alias("w")).groupBy("random", "pair").agg(F.sum("w").alias("w"))
    n = len(ALPHABET)
    counts = {True: [0.0] * (n * n), False: [0.0] * (n * n)}
    for r in pairs.collect():
        counts[r["random"]][r["pair"]] += r["w"]
    return chains(counts)


def secret_spans(docs: DataFrame, total: float = 12.0, per_character: float = 0.6) -> DataFrame:
    """(doc_id, th, kind, start, stop): base spans, and runs (kind random) that the models call random."""
    found = stored(spans(docs), "spans")
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios(found, docs))), ",").cast("array<double>")
    ratio = F.aggregate(_codes(F.col("value")), F.lit(0.0), lambda s, i: s + F.get(table, i))
    whole = found.where((F.col("kind") != "random") | ~F.col("covered"))
    judged = whole.unionByName(remainders(found)).withColumn("ratio", F.when(F.col("kind") == "random", ratio))
    hit = (F.col("kind") != "random") | ((F.col("ratio") >= total) & (F.col("ratio") >= per_character * F.length("value")))
    return judged.where(hit).select("doc_id", "th", "kind", "start", "stop")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, th): th tells texts of the same doc_id apart."""
    return documents(docs).withColumn("th", F.xxhash64("text"))


def _listed(docs: DataFrame) -> DataFrame:
    """Per document with spans: counts and spans, ordered by start, then kind."""
    hits = secret_spans(docs)
    order = F.array_position(F.array(*map(F.lit, [*KINDS, "random"])), F.col("kind"))
    item = F.struct(F.col("start"), order.alias("o"), F.col("stop"), F.col("kind"))
    return hits.groupBy("doc_id", "th").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS], F.array_sort(F.collect_list(item)).alias("items"))


def _met(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["th"] == right["th"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    rows = keyed(docs)
    found = _listed(rows)
    text = lambda items: F.array_join(F.transform(items, lambda i: F.concat_ws(":", i["kind"], i["start"].cast("string"), i["stop"].cast("string"))), ",")
    ids = rows.select("doc_id", "th")
    out = ids.join(found, _met(ids, found), "left")
    base = F.filter("items", lambda i: i["kind"] != "random")
    return out.select(ids["doc_id"], *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce(text(base), F.lit("")), 256).alias("base_sha256"), F.coalesce(text(F.col("items")), F.lit("")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span's text replaced by ``mark`` (spans that meet are replaced together) and n_chars renewed.

    All columns stay as they are, whatever their names; a null text stays null and an
    empty table gives no row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"))
    found = _listed(keyed(docs)).select("doc_id", "th", "items")
    # spans that meet are folded into one, in order of start
    folded = F.aggregate(
        "items", F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)"),
        lambda done, i: F.when((F.size(done) > 0) & (F.element_at(done, -1)["b"] > i["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], i["stop"]).alias("b"))))).otherwise(F.concat(done, F.array(F.struct(i["start"].alias("a"), i["stop"].alias("b"))))),
    )
    found = found.select("doc_id", "th", folded.alias("cuts"))
    out = rows.join(found, _met(rows, found), "left").select("row", "text", "cuts")
    piece = F.expr("transform(sequence(0, size(cuts)), i -> substring(text, cast(if(i = 0, 0, cuts[i - 1].b) as int) + 1, cast(if(i = size(cuts), length(text), get(cuts, i).a) - if(i = 0, 0, cuts[i - 1].b) as int)))")
    hit = F.col("cuts").isNotNull()
    fresh = F.when(hit, F.array_join(piece, mark)).otherwise(F.col("row.text"))
    new = {"text": fresh, "n_chars": F.when(hit, F.length(fresh).cast("long")).otherwise(F.col("row")["n_chars"])} if "n_chars" in docs.columns else {"text": fresh}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
