"""Conversation structure repair by weighted interval parsing.

A conversation's roles must read ``(s?(ua)+)?``: perhaps a system row, then user and assistant
by turns, or nothing. The repair grammar is in Chomsky normal form. Its nonterminals are pairs
``pq`` of what was written last (``0`` for nothing yet, else ``s``, ``u`` or ``a``) before and
after a span of rows; its rules are ``pq -> pr rq``; its terminals are the edits of a row:
Keep, Rerole and Delete. Cells hold the least (cost, audit) of each pair over a span, the
audit being the edits' initials. Insertions have no row: the cell of the empty span is closed
under the rules, and stands on both sides of each row's cell.

Spans are combined bottom-up by length: 1, 2, 4 and so on. A pair's parse can be parted behind
any row, as some ``r`` stands there, so one parting of a span finds its least cell, and the
work is linear in the rows. Audits of equal cost over a span never begin one another (the
longer one would insert more), so the least of a joined pair is joined from the least ones.

Rows of equal conversation, turn, role and text are counted before the shuffle. A range sort
by (conversation, turn, role, text hash) spreads a conversation of any length over tasks;
each task turns at most ``ROWS`` rows into one chunk of cells, and a conversation's chunks are
combined after. Whether a role and text was seen before is told by a marker row, sorted in
front of the first of its kind, so no task holds a conversation's texts. The texts follow
the found audit in order, row by row. A conversation's audit, a value of the result, is the
largest thing held (in the 11 cells of its pairs).

Nulls: a null role or text is one space, so the text is blank and the role none of the three;
null turns come first and don't count for gaps; rows of a null conv_id are one conversation.
Rows of one turn are in the order of role and of their text's MD5. Repeated rows are
duplicates, but for the first. An empty role can't be kept. A conversation without rows has
zeros and an empty audit. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded
from tidewatch.session import stored

#: Rows of a chunk at most, and characters of text after which it ends.
ROWS, TEXT = 256, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What may follow what: a user row comes first, or behind a system or assistant row.
STEPS = {"s": "0", "u": "0sa", "a": "u"}
PAIRS = ["00", "0s", "0u", "0a", "ss", "su", "sa", "uu", "ua", "au", "aa"]
RULES = [(i, [(PAIRS.index(p + r), PAIRS.index(r + q)) for r in "0sua" if p + r in PAIRS and r + q in PAIRS]) for i, (p, q) in enumerate(PAIRS)]
#: White space that makes no text.
SPACE = " \t\n\x0b\f\r"

#: The least (cost, audit) of each pair, None where a span can't be it.
Cell = tuple


def joined(x: Cell, y: Cell) -> Cell:
    """The cell of two neighbouring spans, by the binary rules."""
    out = []
    for _, ways in RULES:
        best = None
        for a, b in ways:
            left, right = x[a], y[b]
            if left is None or right is None:
                continue
            cost = left[0] + right[0]
            if best is None or cost < best[0] or cost == best[0] and left[1] + right[1] < best[1]:
                best = (cost, left[1] + right[1])
        out.append(best)
    return tuple(out)


def least(x: Cell, y: Cell) -> Cell:
    return tuple(min((c for c in both if c is not None), default=None) for both in zip(x, y))


def written(roles: str, cost: int, edit: str) -> Cell:
    """The cell of an edit that writes one of ``roles``."""
    return tuple((cost, edit) if q in roles and p in STEPS.get(q, "") else None for p, q in PAIRS)


def unwritten(cost: int, edit: str) -> Cell:
    return tuple((cost, edit) if p == q else None for p, q in PAIRS)


def _closed() -> Cell:
    cell, one = unwritten(0, ""), written("ua", INSERT, "I")
    while (more := least(cell, joined(cell, one))) != cell:
        cell = more
    return cell


#: The empty span: any insertions.
EMPTY = _closed()


@lru_cache(maxsize=None)
def row_cell(initial: str, gone: bool, truncated: bool) -> Cell:
    """The cell of one row; ``initial`` is s, u, a or empty for other roles, ``gone`` says that it must be deleted."""
    cell = unwritten(DELETE, "D")
    if not gone:
        late = TRUNCATED if truncated else 0
        cell = least(cell, written("ua", REROLE + late, "R"))
        if initial:
            cell = least(cell, written(initial, KEEP + late, "K"))
    return joined(joined(EMPTY, cell), EMPTY)


#: Short spans come again and again.
short = lru_cache(maxsize=1 << 14)(joined)


def parsed(cells: list[Cell]) -> Cell:
    """The cell of a whole span from those of its consecutive parts."""
    size = 1
    while len(cells) > 1:
        join = short if size < 8 else joined
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
        size *= 2
    return cells[0] if cells else EMPTY


def repeated(cell: Cell, n: int) -> list[Cell]:
    """Cells of n equal rows in a row: by powers of two."""
    out = []
    while n:
        if n & 1:
            out.append(cell)
        cell, n = (joined(cell, cell) if n > 1 else cell), n >> 1
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows with faults by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it the user's.
    """
    rows = bounded(conversations).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("way", F.crc32(F.encode(key, "UTF-8")) % 20).where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("way") == 3, 2).otherwise(1).cast("long").alias("copies"))


def chunks(rows: DataFrame) -> DataFrame:
    """Stored chunks of rows in order: conv_id, part, seq, the rows' roles, texts and copies, their faults and cells."""
    runs = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("mark", F.md5("text"))
    runs = stored(runs, "runs")
    lowest = F.when(F.count("turn") == F.count("*"), F.min("turn"))
    firsts = runs.groupBy("conv_id", "role", "mark").agg(lowest.alias("turn"))
    firsts = firsts.select("conv_id", "turn", "role", F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), "mark")
    order = ["conv_id", "turn", "role", "mark"]
    both = runs.unionByName(firsts)
    solid = F.rtrim("text", F.lit(SPACE))
    both = both.withColumn("blank", solid == "").withColumn("cut", ~F.right(solid, F.lit(1)).isin(".", "!", "?"))
    # a marker and its row have the same key, so they are never parted; the marker, with no copies, is first
    placed = both.repartitionByRange(*order).sortWithinPartitions(*order, "copies")
    placed = placed.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})
    kinds = "conv_id string, part int, seq long, roles array<string>, texts array<string>, copies array<long>, low string, high string, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, cells array<struct<cost:long,audit:string>>"
    return stored(placed.mapInPandas(_chunks, kinds), "chunks")


class _Chunk:
    """Rows of one conversation, in order, with their faults."""

    def __init__(self, conv: str | None, part: int, seq: int) -> None:
        self.conv, self.part, self.seq = conv, part, seq
        self.roles, self.texts, self.copies, self.cells = [], [], [], []
        self.turns, self.chars, self.faults = [], 0, {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn: str | None, role: str, text: str, copies: int, first: bool, blank: bool, cut: bool) -> None:
        initial = role[:1] if role[:1] in "sua" else ""
        again = copies if blank or not first else copies - 1
        self.faults["blank" if blank else "duplicate"] += again
        if again < copies:
            self.faults["truncated"] += cut
            self.cells.append(row_cell(initial, False, cut))
        self.cells += repeated(row_cell(initial, True, False), again)
        self.faults["illegal"] += copies - 1 + (bool(self.roles) and unlike(self.roles[-1], role))
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.chars += len(text)
        if turn is not None and self.turns[-1:] != [turn]:
            self.turns.append(turn)

    @property
    def full(self) -> bool:
        return len(self.roles) >= ROWS or self.chars >= TEXT

    def row(self) -> tuple:
        t = self.turns
        return (
            self.conv, self.part, self.seq, self.roles, self.texts, self.copies, t[0] if t else None, t[-1] if t else None, len(t),
            *self.faults.values(), self.roles[0][:1], self.roles[-1][:1], [c and {"cost": c[0], "audit": c[1]} for c in parsed(self.cells)],
        )


def unlike(before: str, after: str) -> bool:
    """Whether two neighbouring rows break the order of roles."""
    return before[:1] + after[:1] not in ("su", "ua", "au")


COLUMNS = "conv_id part seq roles texts copies low high turns blank duplicate truncated illegal head tail cells".split()


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, seq, chunk, first, out, chars = TaskContext.get().partitionId(), 0, None, False, [], 0
    for pdf in batches:
        columns = [pdf[c].tolist() for c in ("conv_id", "turn", "role", "text", "copies", "blank", "cut")]
        for conv, turn, role, text, copies, blank, cut in zip(*columns):
            if not copies:
                first = True
                continue
            if chunk is not None and (chunk.full or chunk.conv != conv):
                out.append(chunk.row())
                chars += chunk.chars
                chunk = None
            if chars >= TEXT:
                yield pd.DataFrame(out, columns=COLUMNS)
                out, chars = [], 0
            if chunk is None:
                chunk, seq = _Chunk(conv, part, seq), seq + 1
            chunk.add(turn, role, text, int(copies), first, bool(blank), bool(cut))
            first = False
    if chunk is not None:
        out.append(chunk.row())
    if out:
        yield pd.DataFrame(out, columns=COLUMNS)


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, Iterator[tuple]]]:
    """Each conversation's rows, without the conversation, as they come; a group must be used up before the next."""
    columns = lambda pdf: (pdf[c].tolist() for c in pdf.columns)
    rows = (r for pdf in batches for r in zip(*columns(pdf)))
    for conv, group in groupby(rows, lambda r: r[0]):
        yield conv, (r[1:] for r in group)


def summaries(conv_ids: DataFrame, made: DataFrame) -> DataFrame:
    """conv_id, gaps, the counts of faults, the least cost and its audit of every conversation in ``conv_ids``."""
    fields = ["part", "seq", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail", "cells"]
    every = conv_ids.select(F.col("conv_id").cast("long").cast("string").alias("conv_id")).distinct().withColumn("part", F.lit(-1))
    rows = made.select("conv_id", *fields).unionByName(every, allowMissingColumns=True)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for conv, group in grouped(batches):
            counts, turns, low, high, tail, cells = dict.fromkeys(SUMMARY, 0), 0, None, None, None, []
            for part, _, lo, hi, n, blank, duplicate, truncated, illegal, head, end, span in group:
                if part < 0:
                    continue
                for name, value in zip(SUMMARY[1:5], (blank, duplicate, truncated, illegal)):
                    counts[name] += int(value)
                if tail is not None:
                    counts["illegal"] += unlike(tail, head)
                tail = end
                if n:
                    lo, hi = int(lo), int(hi)
                    turns += int(n) - (lo == high)
                    low, high = (lo if low is None else low), hi
                cells.append(tuple(c and (c["cost"], c["audit"]) for c in span))
            counts["gaps"] = high - low + 1 - turns if turns else 0
            cell = parsed(cells)
            counts["cost"], audit = min(cell[PAIRS.index(p)] for p in ("00", "0a") if cell[PAIRS.index(p)])
            out.append((conv, *counts.values(), audit))
            if len(out) >= 10_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["conv_id", *SUMMARY, "audit"])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", *fields)
    return ordered.mapInPandas(fold, "conv_id string, " + ", ".join(f"{c} long" for c in SUMMARY) + ", audit string")


def edited(audits: DataFrame, made: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text of the rows that each conversation keeps or gains, in order within partitions.

    A conversation without such rows has one row of nulls, so that it isn't lost.
    """
    fields = ["part", "audit", "roles", "texts", "copies"]
    rows = made.select("conv_id", "seq", "part", "roles", "texts", "copies")
    rows = rows.unionByName(audits.select("conv_id", "audit", F.lit(-1).alias("part")), allowMissingColumns=True)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", *fields)

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, chars = [], 0
        for conv, group in grouped(batches):
            place = -1
            for name, role, text in _edits(group):
                place += 1
                out.append((conv, place, name, role, text))
                chars += len(text)
                if chars >= TEXT or len(out) >= 50_000:
                    yield frame(out)
                    out, chars = [], 0
            if place < 0:
                out.append((conv, None, None, None, None))
        if out:
            yield frame(out)

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["conv_id", "place", "edit", "role", "text"]).astype({"place": "Int64"})

    return ordered.mapInPandas(edit, "conv_id string, place long, edit string, role string, text string")


def _edits(group: Iterable) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit makes of a conversation's rows; the audit comes first."""
    audit, at, last = "", 0, "0"

    def made(name: str, role: str | None, text: str) -> tuple[str, str, str]:
        nonlocal last
        role = role or ("assistant" if last == "u" else "user")
        last = role[:1]
        return name, role, text

    for part, found, roles, texts, copies in group:
        if part < 0:
            audit = found
            continue
        for role, text, n in zip(roles, texts, copies):
            for _ in range(int(n)):
                while audit[at] == "I":
                    yield made("I", None, "")
                    at += 1
                if audit[at] != "D":
                    yield made(audit[at], role if audit[at] == "K" else None, text)
                at += 1
    for _ in audit[at:]:
        yield made("I", None, "")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of ``role:text`` of each conversation's edited rows, joined by line breaks."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for conv, group in grouped(batches):
            total = hashlib.sha256()
            for place, _, role, text in group:
                if not pd.isna(place):
                    total.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            out.append((conv, total.hexdigest()))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])

    return rows.mapInPandas(digest, "conv_id string, repaired_sha256 string")


def repair(rows: DataFrame, conv_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary of every conversation, its rows after the edits) of rows with ``copies`` as ``damaged`` gives them."""
    made = chunks(rows)
    summary = stored(summaries(conv_ids, made), "audits")
    number = F.col("conv_id").cast("long")
    return summary.withColumn("conv_id", number), edited(summary, made).withColumn("conv_id", number)


def repaired(conversations: DataFrame) -> DataFrame:
    """Every conversation after damage: its faults, the cheapest edits and the digest of the repaired rows."""
    summary, rows = repair(damaged(conversations), conversations)
    own = digests(rows.withColumn("conv_id", F.col("conv_id").cast("string"))).select(F.col("conv_id").cast("long").alias("its"), "repaired_sha256")
    return summary.join(own, F.col("conv_id").eqNullSafe(F.col("its"))).drop("its")
