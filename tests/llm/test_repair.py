import hashlib
import itertools
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidewatch.llm import repair

WHITE = " \t\n\x0b\f\r"


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if way == 0:
            continue
        if way == 1:
            text = ""
        if way == 2:
            text = "".join(c for c in text if c not in ".!?")
        out[conv] += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {conv: sorted(rs, key=order) for conv, rs in out.items()}


def plain_repair(rows):
    """One row at a time: the least (cost, audit, rows written) by what was written last."""
    seen, best = set(), {"0": (0, "", ())}
    faults = dict.fromkeys(["blank", "duplicate", "truncated"], 0)

    def add(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    def insert(states):
        grown = True
        while grown:
            before = {k: v[:2] for k, v in states.items()}
            for last, (cost, audit, done) in list(states.items()):
                role = "assistant" if last == "u" else "user"
                add(states, role[0], (cost + 2, audit + "I", (*done, f"{role}:")))
            grown = before != {k: v[:2] for k, v in states.items()}
        return states

    best = insert(best)
    for _, role, text in rows:
        solid = text.rstrip(WHITE)
        blank, again, cut = not solid, (role, text) in seen, bool(solid) and solid[-1] not in ".!?"
        seen.add((role, text))
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
        if fault:
            faults[fault] += 1
        after = {}
        for last, (cost, audit, done) in best.items():
            add(after, last, (cost + 3, audit + "D", done))
            if blank or again:
                continue
            if role[:1] == "s" and last == "0" or role[:1] == "u" and last in "0sa" or role[:1] == "a" and last == "u":
                add(after, role[0], (cost + cut, audit + "K", (*done, f"{role}:{text}")))
            new = "assistant" if last == "u" else "user"
            add(after, new[0], (cost + 2 + cut, audit + "R", (*done, f"{new}:{text}")))
        best = insert(after)
    cost, audit, done = min(best[k] for k in ("0", "a") if k in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())


def all_parses(rows):
    """Every edit string of short conversations, insertions of up to two rows anywhere."""
    found = []
    for plan in itertools.product(*(["".join(x) for n in range(3) for x in itertools.product("I", repeat=n)] + [""] if k % 2 == 0 else "KRD" for k in range(2 * len(rows) + 1))):
        audit, cost, last, ok, at = "".join(plan), 0, "0", True, 0
        for e in audit:
            if e == "I":
                cost, last = cost + 2, "a" if last == "u" else "u"
                continue
            initial, gone, cut = rows[at]
            at += 1
            if e == "D":
                cost += 3
                continue
            cost += cut + (2 if e == "R" else 0)
            new = ("a" if last == "u" else "u") if e == "R" else initial
            ok &= not gone and (last in repair.STEPS.get(new, "")) and bool(new)
            last = new
        if ok and last in "0a":
            found.append((cost, audit))
    return min(found)


def test_cells_against_every_edit_string():
    rnd = random.Random(3)
    for _ in range(40):
        rows = [(rnd.choice(["s", "u", "a", ""]), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(0, 4))]
        cell = repair.parsed([repair.row_cell(*r) for r in rows])
        assert min(cell[i] for i in (0, 3) if cell[i]) == all_parses(rows)


def test_any_parting_of_a_span_gives_the_same_cell():
    rnd = random.Random(4)
    for _ in range(20):
        rows = [repair.row_cell(rnd.choice(["s", "u", "a", ""]), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(9)]
        cells = {(i, i + 1): c for i, c in enumerate(rows)}
        for size in range(2, 10):
            for i in range(10 - size):
                ways = [repair.joined(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
                assert len(set(ways)) == 1
                cells[i, i + size] = ways[0]
        assert cells[0, 9] == repair.parsed(rows)
    one = repair.row_cell("u", True, False)
    assert repair.parsed(repair.repeated(one, 13)) == repair.parsed([one] * 13)


def run(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, part int").repartition(partitions)
    got = repair.repaired(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r[1:]) for r in got.collect()}


def odd_conversations():
    rnd = random.Random(5)
    texts = ["", " \n", "Yes.", "No!", "why", "And so?  \n", "x" * 3000 + ".", "é\x1c", " ", None]
    rows = []
    for conv in [None, *range(60), 2**60 + 1]:
        for turn in range(rnd.randint(1, 12)):
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn * 3 - 7]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "Uu", None]), rnd.choice(texts)))
    return rows + rows[:9] + [(7, 1, "user", "Yes.")] * 40


def test_repair_against_a_plain_version(spark):
    rows = odd_conversations()
    got = run(spark, rows)
    assert got == {conv: plain_repair(rs) for conv, rs in damage(rows).items()}


def test_a_long_conversation_is_parted_over_tasks(spark):
    rnd = random.Random(6)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), f"{rnd.randint(0, 900)}{rnd.choice('.!x')}") for t in range(3000)] + [(1, 5, "user", "same.")] * 2000 + [(2, 3, "user", "one.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made = repair.chunks(repair.damaged(df))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert made.where("conv_id = 1").select("part").distinct().count() > 1
    assert made.select(F.max(F.size("roles"))).first()[0] <= repair.ROWS
    assert run(spark, rows, 5) == {conv: plain_repair(rs) for conv, rs in damage(rows).items()}


def test_conversations_without_rows(spark):
    dropped = [t for t in range(400) if zlib.crc32(f"9:{t}".encode()) % 20 == 0][:2]
    assert run(spark, [(9, t, "user", "a.") for t in dropped]) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, []) == {}
    summary, rows = repair.repair(repair.damaged(spark.createDataFrame([(1, 1, "assistant", "Hi.")], "conv_id long, turn long, role string, text string")), spark.range(1, 2).toDF("conv_id"))
    assert [tuple(r) for r in rows.orderBy("place").collect()] == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hi.")]
