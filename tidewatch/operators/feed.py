"""The feed: items as of an instant, ranked, in pages that go on where the last one ended."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scoring import decay
from tidewatch.operators.asof import in_force
from tidewatch.operators.versions import as_of, newest

#: Rows of a page at most (fixed value).
MOST = 200
AFTER = ["pinned", "priority", "score", "item_key"]


@dataclass(frozen=True)
class Asked:
    """What a page is of: the frozen instant, the filters (None: all) and the row after which it begins (None: the first)."""

    now: str
    beat: str | None = None
    kind: str | None = None
    profile: str = "signal"
    after: tuple[bool, int | None, float, int] | None = None

    def token(self) -> Column:
        """The cursor of the page that begins after a row with the columns ``AFTER``."""
        fixed = [F.lit(v).alias(k) for k, v in (("now", self.now), ("beat", self.beat or "all"), ("kind", self.kind or "all"), ("profile", self.profile))]
        text = F.to_json(F.struct(F.lit(1).alias("v"), *fixed, F.struct(*AFTER).alias("after")), {"ignoreNullFields": "false"})
        return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))

    @staticmethod
    def of(token: str) -> Asked:
        """What a cursor asks for; a ValueError says what is wrong with a cursor."""
        try:
            d = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
            a = d["after"]
            datetime.fromisoformat(d["now"])
            ok = d["v"] == 1 and set(d) == {"v", "now", "beat", "kind", "profile", "after"} and set(a) == set(AFTER)
            ok = ok and type(a["pinned"]) is bool and (a["priority"] is None or type(a["priority"]) is int) and type(a["score"]) in (int, float) and d["profile"] in ("signal", "read")
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError(f"invalid feed cursor: {e}") from e
        if not ok:
            raise ValueError("invalid feed cursor: fields")
        none = lambda x: None if x == "all" else x
        return Asked(d["now"], none(d["beat"]), none(d["kind"]), d["profile"], tuple(a[k] for k in AFTER))


def rows(asked: Asked, versions: DataFrame, scores: DataFrame, half_lives: DataFrame, states: DataFrame, kinds: DataFrame, pins, runs: DataFrame, members: DataFrame) -> DataFrame:
    """The feed's rows as of ``asked.now`` that pass its filters, with rank keys, state and cluster size.

    ``versions``: item_key, fetched_at, ingest_seq, source_id and what pins need; ``scores``:
    item_key, beat, computed_at, seq, signal, read; ``half_lives``: beat, hl; ``states``:
    item_key, saved_at, dismissed_at; ``kinds``: source_id, kind; ``pins(versions, profile,
    now)``: item_key, priority; ``runs``: run_at; ``members``: run_at, item_key, n. Dismissed
    items never come back; an item shows for its beat with the highest decayed score (the
    first name of equal ones) among scores of then; its cluster is that of the run in force
    when the score was made, in that run only.
    """
    at = F.lit(asked.now).cast("timestamp_ntz")
    items = as_of(versions, ["item_key"], asked.now).join(kinds, "source_id", "left")
    items = items if asked.kind is None else items.where(F.col("kind") == asked.kind)
    gone = states.where("dismissed_at IS NOT NULL").select("item_key")
    items = items.join(gone, "item_key", "left_anti").join(states.select("item_key", "saved_at"), "item_key", "left")
    made = scores.where(F.col("computed_at") <= at)
    made = made if asked.beat is None else made.where(F.col("beat") == asked.beat)
    made = newest(made, ["item_key", "beat"], "computed_at", "seq").join(half_lives, "beat")
    faded = made.withColumn("score", F.round(F.col(asked.profile) * decay(F.col("computed_at"), asked.now, F.col("hl")), 6))
    top = faded.groupBy("item_key").agg(F.min_by(F.struct("beat", "score", "computed_at"), F.struct((-F.col("score")).alias("s"), "beat")).alias("b")).select("item_key", "b.*")
    found = items.join(top, "item_key").join(pins(items, asked.profile, asked.now), "item_key", "left").withColumn("pinned", F.col("priority").isNotNull())
    sized = in_force(found.select("item_key", "computed_at"), "computed_at", runs, "run_at", "week")
    sized = sized.join(members, ["run_at", "item_key"], "left").select("item_key", F.coalesce("n", F.lit(1)).alias("cluster_size"))
    return found.join(sized, "item_key").select("item_key", "source_id", "kind", "beat", "score", "pinned", "priority", "cluster_size", "saved_at")


def _later(after: tuple) -> Column:
    """Rows strictly after a place: pinned ones first, then by priority (none last), falling score, falling key."""
    pinned, priority, score, key = after
    level = lambda p: F.when(p, 0).otherwise(1)
    steps = [(level(F.col("pinned")), F.lit(0 if pinned else 1), False), (F.coalesce("priority", F.lit(2**31 - 1)), F.lit(2**31 - 1 if priority is None else priority), False), (F.col("score"), F.lit(float(score)), True), (F.col("item_key"), F.lit(key), True)]
    out = F.lit(False)
    for column, value, falling in reversed(steps):
        out = (column < value if falling else column > value) | ((column == value) & out)
    return out


def page(feed: DataFrame, asked: Asked, limit: int) -> DataFrame:
    """One page of ``rows``: place in it, total of all pages, and on its last row, if more follow, the cursor of the next."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be 1 to {MOST}")
    order = [F.desc("pinned"), F.asc_nulls_last("priority"), F.desc("score"), F.desc("item_key")]
    rest = feed if asked.after is None else feed.where(_later(asked.after))
    some = rest.orderBy(*order).limit(limit + 1)  # a bounded page, then numbered
    some = some.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("total", feed.agg(F.count("*")).scalar())
    more = F.lead("item_key").over(Window.orderBy(*order)).isNotNull()
    next_after = F.when((F.col("place") == limit) & more, replace(asked, after=None).token())
    return some.withColumn("next_after", next_after).where(F.col("place") <= limit)
