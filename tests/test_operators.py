import pytest
from pyspark.sql import functions as F

from tidewatch.functions import names as N
from tidewatch.functions import text as T
from tidewatch.operators import graph, versions
from tidewatch.sources import feeds
from tidewatch.streaming import state


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_as_of_is_inclusive_and_checks_the_horizon(spark):
    v = spark.createDataFrame([("a", "2024-01-01 00:00:00.000", 1, "x"), ("a", "2024-01-02 00:00:00.000", 2, "y"), ("a", "2024-01-02 00:00:00.000", 3, "z")], "item_key string, t string, ingest_seq long, v string").withColumn("fetched_at", F.col("t").cast("timestamp")).drop("t")
    at = lambda t: [r.v for r in versions.as_of(v, ["item_key"], t).collect()]
    assert (at("2024-01-02 00:00:00"), at("2024-01-01 23:59:59.999"), at("2023-12-31 00:00:00")) == (["z"], ["x"], [])
    with pytest.raises(ValueError):
        versions.as_of(v, ["item_key"], "2023-01-01 00:00:00", horizon="2024-01-01 00:00:00")


def test_upsert_moves_forward_only(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 5, "c")], "k long, at long, v string")
    new = spark.createDataFrame([(1, 6, "A"), (2, 5, "B"), (4, 1, "D")], "k long, at long, v string")
    assert rows(versions.upsert_if_newer(old, new, ["k"], "at")) == [(1, 6, "A", "updated"), (2, 5, "b", "ignored"), (3, 5, "c", "kept"), (4, 1, "D", "inserted")]


def test_state_replay_first_wins_and_unsave_clears(spark):
    log = spark.createDataFrame([(1, 1, 1, "save"), (1, 2, 2, "unsave"), (1, 3, 3, "save"), (1, 4, 4, "save"), (2, 1, 5, "read"), (2, 2, 6, "read"), (2, 3, 7, "dismiss"), (2, 4, 8, "dismiss")], "item_key long, ts long, seq long, action string")
    assert rows(versions.replay_state(log)) == [(1, None, 3, None, 0), (2, 1, None, 3, 1)]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 340)] + [(5, 5)]
    edges = spark.createDataFrame(path, "a long, b long")
    # in one task, and in rounds
    got, rounds = ({r.node: r.component for r in graph.connected_components(edges, "a", "b", small=n).collect()} for n in (1000, 0))
    assert got == rounds == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(300, 340)]}


def test_urls_are_canonical_and_stay_so(spark):
    cases = {"HTTP://WWW.ArXiv.org/A/?b=2&a=1&utm_x=1#f": "https://arxiv.org/A?a=1&b=2", "http://a.substack.com/p/": "https://a.substack.com/p", "http://other.net": "http://other.net/", "https://x.org/?a=2&a=1&fbclid=3": "https://x.org/?a=2&a=1", "ftp://x.org/": None}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    once = df.select("u", T.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in once.collect()} == cases
    assert once.where("c is not null").where(T.canonical_url(F.col("c")) != F.col("c")).count() == 0


def test_titles_and_terms(spark):
    df = spark.createDataFrame([("The Cat's—big DAY, again and again",), ("one two",), ("",)], "t string")
    got = [r.s for r in df.select(T.shingles(T.title_tokens(F.col("t"))).alias("s")).collect()]
    assert got == [["cats big day", "big day again", "day again again"], ["one two"], []]
    hits = spark.createDataFrame([("An Open-source tool",), ("reopen source",), ("open  source",)], "t string").where(F.col("t").rlike(T.term_pattern("open source")))
    assert hits.count() == 2


def test_source_backoff(spark):
    log = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, True)] + [(1, f"2024-01-01 01:00:0{i}", 2 + i, False) for i in range(2)] + [(2, "2024-01-01 00:00:00", 9, False)] + [(3, f"2024-01-01 00:00:0{i}", 20 + i, False) for i in range(8)], "source_id long, t string, seq long, ok boolean").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r.source_id: (r.consecutive_failures, r.next_eligible_at.isoformat()) for r in state.replay_sources(log).collect()}
    assert got == {1: (2, "2024-01-01T05:00:01"), 2: (1, "2024-01-01T02:00:00"), 3: (8, "2024-01-01T06:00:07")}


def test_a_failed_attempt_erases_no_answer(spark):
    log = spark.createDataFrame([(1, 1, 1, None, "error", None), (1, 2, 2, "present", None, "k"), (1, 3, 3, None, "unreadable", "z"), (2, 1, 4, None, "error", None)], "k long, at long, seq long, outcome string, failure string, item string")
    got = versions.keep_answers(log, ["k"], "at", "seq", ["outcome"], ["failure"], ["item"])
    assert rows(got) == [(1, "present", 2, "unreadable", 3, 1, "k"), (2, None, None, "error", 1, 1, None)]


def test_worklist_orders_untried_failed_stale_fresh(spark):
    repos = spark.createDataFrame([(1, 5), (2, 9), (3, 0), (4, 0), (5, 0), (6, 0)], "k long, stars long")
    at = lambda c: F.to_timestamp_ntz(F.col(c))
    known = spark.createDataFrame([(3, None, None, "2024-01-09 00:00:00"), (4, None, None, "2024-01-08 00:00:00"), (5, "present", "2024-01-02 00:00:00", "2024-01-02 00:00:00"), (6, "absent", "2024-01-02 00:00:00", "2024-01-02 00:00:00")], "k long, outcome string, a string, t string").select("k", "outcome", at("a").alias("answered_at"), at("t").alias("attempted_at"))
    assert [r.k for r in versions.worklist(repos, known, "k", "2024-01-10 00:00:00", 9).collect()] == [2, 1, 4, 3, 6, 5]


def test_names_and_slugs(spark):
    cases = [("  ", "empty"), (None, "empty"), ("a/b", "separator"), ("a ", "whitespace_edge"), ("a\x01b", "control_char"), (".a", "dot_leading"), ("a:b", "reserved_char"), ("COM1.x", "device_name"), ("console", None), ("é" * 100, "too_long"), ("é" * 98, None)]
    got = spark.createDataFrame(cases, "name string, want string").select("want", N.name_reason(F.col("name")).alias("got")).collect()
    assert [r.want for r in got] == [r.got for r in got]
    titles = [("Éa — B!", "ea-b"), ("日本", "untitled"), (None, "untitled"), ("ab " * 40, "-".join(["ab"] * 26)), ("x" * 90, "x" * 80)]
    got = spark.createDataFrame(titles, "t string, want string").select("want", N.slug(F.col("t")).alias("got")).collect()
    assert [r.want for r in got] == [r.got for r in got]


def test_search_union_keeps_the_first_and_counts_the_rest(spark):
    item = "array<struct<id: long, fork: boolean, archived: boolean>>"
    pages = spark.createDataFrame([("t", 1, 1, [(1, False, False), (2, True, False)]), ("t", 2, 1, [(1, True, True), (3, False, False)])], f"topic string, request int, page int, items {item}")
    plan = spark.createDataFrame([("t", 1, 2, 40), ("t", 2, 1, 2), ("u", 1, 1, 0)], "topic string, request int, planned int, reported int")
    assert rows(feeds.search_union(pages)) == [("t", 1, 1, False, False), ("t", 1, 2, True, False), ("t", 2, 3, False, False)]
    assert rows(feeds.search_coverage(plan, pages)) == [("t", 3, 2, 42, 4, 1, 1, 2), ("u", 1, 0, 0, 0, 0, 0, 0)]


def test_folds_in_batches_equal_one_replay(spark):
    rows = [(i % 5, f"2024-01-01 00:{i:02d}:00", i, ["read", "save", "unsave", "dismiss"][(i * 7 // 3) % 4], i % 3 == 0) for i in range(60)]
    log = spark.createDataFrame(rows, "item_key long, t string, seq long, action string, ok boolean").withColumn("ts", F.col("t").cast("timestamp_ntz")).withColumn("source_id", F.col("item_key"))
    want = rows_of(versions.replay_state(log)), rows_of(state.replay_sources(log.select("source_id", "ts", "seq", "ok")))
    # batches in order of time, and shuffled: what comes late counts by its own time
    for order in (range(0, 60, 12), (36, 0, 48, 24, 12)):
        items = sources = None
        for lo in order:
            batch = log.where((F.col("seq") >= lo) & (F.col("seq") < lo + 12))
            items, sources = state.fold_items(batch, items), state.fold_sources(batch.select("source_id", "ts", "seq", "ok"), sources)
        assert (rows_of(state.item_states(items)), rows_of(state.next_polls(sources.withColumn("n", F.size("after"))))) == want


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_anchored_counter_starts_anew_after_seven_days(spark):
    from tidewatch.operators import monitor

    at = [("a", "2024-01-01 12:00:00", 3), ("a", "2024-01-08 11:59:59", 4), ("a", "2024-01-08 12:00:00", 5), ("a", "2024-01-20 00:00:00", 6), ("a", "2024-01-21 00:00:00", 1), ("b", "2024-01-01 00:00:00", 2)]
    df = spark.createDataFrame(at, "source_id string, t string, items long").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r.source_id: (r.window_started_at.isoformat(), r.yielded) for r in monitor.anchored_yield(df).collect()}
    assert got == {"a": ("2024-01-20T00:00:00", 7), "b": ("2024-01-01T00:00:00", 2)}


def test_publication_dates_and_half_lives(spark):
    from tidewatch.functions.dates import publication_date
    from tidewatch.plans.detail import half_life

    cases = {
        "2024-02-29T10:00:00.1239+02:00": "2024-02-29T08:00:00.123000", "2023-02-29T10:00:00Z": None, "2024-01-01T24:00:00Z": None, "2024-01-01T00:00:00": None, "2024-01-01T00:00:00+14:00": "2023-12-31T10:00:00",
        "2024-01-01T00:00:00+14:30": None, " 2024-03-04 ": "2024-03-04T00:00:00", "Tue, 5 Mar 49 01:02:03 GMT": "2049-03-05T01:02:03", "5 Mar 50 01:02:03 GMT": None, "05 mar 2024 01:02:03 -0130": "2024-03-05T02:32:03",
        "05 Mar 2024 01:02:03 EST": None, "05 Foo 2024 01:02:03 Z": None, "1700000000": "2023-11-14T22:13:20", "1": None, "soon": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", publication_date(F.col("s")).cast("timestamp_ntz").alias("d"))
    assert {r.s: r.d and r.d.isoformat() for r in df.collect()} == cases
    good = spark.createDataFrame([("markets", "press"), ("1-URGENT", "x")], "b string, t string")
    assert [r[0] for r in good.select(half_life(F.col("b"), F.col("t"))).collect()] == [24.0, 2000.0]
    with pytest.raises(Exception, match="no half-life"):
        spark.createDataFrame([("other", "press")], "b string, t string").select(half_life(F.col("b"), F.col("t"))).collect()


def test_feeds_that_leave_entries_open(spark):
    from tidewatch.sources import xml

    body = "<rss><channel><item><link>a</link><title>A &amp; b</title><item><link>c</link><title>C</title><description>d</description></item><item><title>no link</title></item></channel></rss>"
    got = xml.rss_items(spark.createDataFrame([(1, body), (2, None), (3, "no feed")], "k int, body string"), "body").collect()
    assert [(r.k, r.url, r.title, r.summary) for r in got] == [(1, "a", "A & b", None), (1, "c", "C", "d")]


def test_first_paragraph_of_prose(spark):
    from tidewatch.functions.prose import first_paragraph

    cases = {
        "---\ntitle: x\n---\n# Head\n\n```\ncode that looks like a sentence of prose\n```\n\nThis tool reads **feeds** and `files`.\nIt is fast &amp; small.\n- item": "This tool reads feeds and files. It is fast & small.",
        "[![badge](a)](b) ![x](y)\n\n[one link label here](u) | [another link label](v)\n\nA paragraph with [one link](u) in it, after all.": "A paragraph with one link in it, after all.",
        "<!-- a comment of many words -->\n> quoted words that go on and on\n\n    indented code line of words\n\nToo short.\n\nEnough words to be prose now.": "Enough words to be prose now.",
        "~~~\nnever closed, words words words words": None, "": None, None: None, "a " * 200: ("a " * 150).strip(),
        "One two three four five six seven\n## Next": "One two three four five six seven",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.p for r in df.select("s", first_paragraph(F.col("s")).alias("p")).collect()} == cases


def test_overlap_takes_no_short_or_generic_names_and_the_earliest_match(spark):
    from tidewatch.operators import monitor

    repos = spark.createDataFrame([("a/big-tool", "Big-Tool"), ("a/cli", "cli"), ("b/awesome-list", "awesome-list")], "repo_key string, name string")
    stories = spark.createDataFrame([("s1", "About the big tool", "https://x.org/", 3), ("s1", "About the big tool", "https://github.com/A/Big-Tool.git", 5), ("s2", "a tool that is big", "https://x.org/", 1), ("s3", "cli and awesome list", "https://github.com/a/CLI/issues", 2)], "story_key string, title string, url string, fetched_at int")
    got = {r.repo_key: (r.mentions, r.strength, r.first_at) for r in monitor.discussion_overlap(repos, stories, 6, ("awesomelist",)).collect()}
    assert got == {"a/big-tool": (1, 0.6, 3), "a/cli": (1, 1.0, 2)}


def plain_paragraph(text):
    """The rules of ``first_paragraph`` on one text, line by line."""
    import html
    import re

    from tidewatch.functions import prose

    if text is None:
        return None
    for pattern, by in prose.MARKUP:
        text = re.sub(pattern.replace("\\z", "\\Z"), by.replace("@", "\\1"), text)
    skip, held = None, []
    for n, line in enumerate([*html.unescape(text).split("\n"), ""]):
        t = line.strip(prose.WHITE)
        if skip:
            if n and t.startswith(skip) and not t.strip("`~-"):
                skip = None
            continue
        if n == 0 and t == "---":
            skip, held = "---", []
            continue
        rule = bool(t) and not t.strip(prose.RULES) and not t.startswith("~~~")
        block = t[:1] in ("|", ">") or t[:2] == ".." or re.match(r"(#{1,6}|[-+*]|\d{1,9}[.)])([ \t]|$)|\[[^\]]+\]:", t)
        if t and not rule and not block and not t.startswith(("```", "~~~")) and (held or not line.startswith(("    ", "\t"))):
            held.append(t)
            continue
        if held and not rule:
            joined = " ".join(held)
            joined = re.sub(r"(^|[^\w*])[*_]+|(?<![\w*])_+", lambda m: m[1] or "", joined)
            joined = re.sub(r"[*_]+(?=[^\w*]|$)|_+(?=\W|$)", "", joined).replace("`", "").replace("~~", "")
            joined = " ".join(joined.split())
            labels = re.findall(f"{prose.OPEN}([^{prose.CLOSE}]*){prose.CLOSE}", joined)
            bare = joined.replace(prose.OPEN, "").replace(prose.CLOSE, "")
            share = sum(map(len, labels)) / max(1, len(bare))
            told = [w for w in bare.split(" ") if re.search("[A-Za-z]", w)]
            if len(bare) >= 20 and len(told) >= 4 and not (labels and share >= 0.9) and not (len(labels) >= 2 and share > 0.6):
                return bare if len(bare) <= 300 else re.sub(r" [^ ]*$", "", bare[:300]).strip()
        held = []
        if t.startswith(("```", "~~~")):
            skip = t[:3]
    return None


def test_first_paragraph_against_a_plain_version(spark):
    import random

    from tidewatch.functions.prose import first_paragraph

    rnd = random.Random(8)
    parts = ["Words of a sentence that is long enough to be prose.", "short", "# Head of it", "- an item with many words in it", "> quoted words in a row here", "```", "~~~", "---", "===", "", "", "", "    indented words of code in a row", "| a | b |", "[label one](u) [label two](v)", "See [the label](u) for words about **bold** and `code` &amp; more &#8212; of it.", "![x](y)", "<p align=center>Words in a paragraph of HTML, enough of them.</p>", "<ul><li><a href=x>many words in a link here</a></li></ul>", "<h2>A heading of several words here</h2>", "<a href='u'>one link with many words in it</a>", "<!-- hidden words", "-->", "<script>var words = many;</script>", "1. numbered item of words here", "[ref]: https://x.org", "&copy; words &nosuch; and words &lt;b&gt; again", "word " * 90]
    texts = [None, "", "---\nx: y words of front matter here\n---\nAfter the matter come words."] + ["\n".join(rnd.choices(parts, k=rnd.randint(1, 9))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r.i: r.p for r in df.select("i", first_paragraph(F.col("s")).alias("p")).collect()}
    assert [(texts[i], p) for i, p in got.items() if p != plain_paragraph(texts[i])] == []
    assert sum(p is not None for p in got.values()) > 200


def test_character_references(spark):
    import html

    from tidewatch.functions.prose import unescaped

    cases = ["", "a & b", "&amp;amp;", "&lt;b&gt; &eacute;&Eacute; &hellip;", "&#65;&#x41;&#128512;&#x1F600;", "&nosuch; &;", "a&amp;"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert {r.s: r.u for r in df.select("s", unescaped(F.col("s")).alias("u")).collect()} == {c: html.unescape(c) for c in cases}


def written_stream(spark, path, files):
    """A stream of one file after the other; ``files`` are lists of rows."""
    for i, rows_ in enumerate(files):
        spark.createDataFrame(rows_, "k long, t string, n long").select("k", F.col("t").cast("timestamp_ntz").alias("ts"), "n").coalesce(1).write.parquet(f"{path}/part={i:02d}")
    return spark.readStream.schema("k long, ts timestamp_ntz, n long").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")


def test_stream_of_anchored_counters_in_any_order_of_files(spark, tmp_path):
    import random

    from tidewatch.operators import monitor
    from tidewatch.streaming import keyed

    rnd = random.Random(9)
    events = [(rnd.randint(1, 6), f"2024-01-{rnd.randint(1, 28):02d} {rnd.randint(0, 23):02d}:00:00", rnd.randint(1, 9)) for _ in range(120)]
    batch = spark.createDataFrame(events, "source_id long, t string, items long").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    want = {r.source_id: (r.window_started_at, r.yielded) for r in monitor.anchored_yield(batch).collect()}
    for name, order in (("sorted", sorted(events, key=lambda e: e[1])), ("shuffled", events)):
        rows_ = written_stream(spark, str(tmp_path / name), [order[i : i + 30] for i in range(0, 120, 30)])
        last, late = keyed.last_rows(keyed.anchored_counts(rows_.select(F.col("k").alias("source_id"), "ts", F.col("n").alias("items")), "31 days"), "source_id")
        got = {r.source_id: (r.at, r.yielded) for r in last.select("source_id", F.timestamp_micros("window_us").cast("timestamp_ntz").alias("at"), "yielded").collect()}
        assert (got, late) == (want, 0)


def test_rows_behind_the_watermark_are_late(spark, tmp_path):
    from tidewatch.streaming import keyed

    files = [[(1, "2024-01-20 10:30:00", 1), (1, "2024-01-19 09:10:00", 1)], [(1, "2024-01-20 08:59:00", 1), (1, "2024-01-19 23:00:00", 1)], [(2, "2024-01-10 00:00:00", 1), (1, "2024-01-20 08:30:00", 1)]]
    rows_ = written_stream(spark, str(tmp_path / "a"), files)
    last, late = keyed.last_rows(keyed.hourly(rows_, "3 hours"), "hour")
    # after the first file the mark stands at 7:30 of the 20th; rows are late to it from the batch after next
    assert late == 1
    assert {(r.hour.isoformat(), r.n) for r in last.collect()} == {("2024-01-20T10:00:00", 1), ("2024-01-19T09:00:00", 1), ("2024-01-19T23:00:00", 1), ("2024-01-20T08:00:00", 2)}
    counts, late = keyed.last_rows(keyed.anchored_counts(rows_.select(F.col("k").alias("source_id"), "ts", F.col("n").alias("items")), "3 hours"), "source_id")
    assert late == 1 and [tuple(r)[::2] for r in counts.collect()] == [(1, 5)]


def test_term_index_against_each_terms_pattern(spark):
    import random
    import re

    from tidewatch.operators import terms as X

    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(60)] + ["Alpha", "alpha", "BETA", "é", "ÉTÉ", "snake_case", "c"]
    gaps = [" ", " ", " ", "-", ", ", "\n", ". ", "  ", " - ", "+", "++ ", "'"]
    text = lambda n: "".join(w + rnd.choice(gaps) for w in rnd.choices(vocab, k=n))
    rows_ = [(i, text(rnd.randint(0, 12)), rnd.choice([None, "", text(8), text(30)])) for i in range(150)] + [(900, None, None)]
    df = spark.createDataFrame(rows_, "k long, title string, summary string")
    terms = {(" ".join(rnd.choices(vocab, k=rnd.randint(1, 3))), rnd.random() < 0.4) for _ in range(400)}
    terms |= {("w1-w2", False), ("alpha", True), ("Alpha", False), ("c++", False), ("w3, w4", False), ("w5.", True), ("", False), ("--", False), ("nowhere at all", False), ("été", False)}
    terms |= {(f"none{i} w1", False) for i in range(3000)}
    want = set()
    for t, exact in terms:
        words = re.split(r"[\s-]+", t.strip(" -\n"))
        if not any(re.search(r"\w", w) for w in words):
            continue
        p = re.compile(r"(?<!\w)" + r"[\s-]+".join(map(re.escape, words)) + r"(?!\w)", 0 if exact else re.I)
        for k, title, summary in rows_:
            hit = lambda s: bool(s and p.search(s))
            if hit(" ".join(s for s in (title, summary) if s is not None)):
                want.add((k, t, exact, hit(title), hit(summary)))
    got = [tuple(r) for r in X.find_terms(df, "k", ["title", "summary"], list(terms)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert X.find_terms(df, "k", ["title"], []).count() == 0


def test_stored_search_index_and_its_upkeep(spark, tmp_path):
    from tidewatch.operators.search import SearchIndex

    def versions_of(rows_):
        df = spark.createDataFrame(rows_, "item_key long, t string, ingest_seq long, title string, body string")
        return df.withColumn("fetched_at", F.col("t").cast("timestamp")).drop("t")

    index = SearchIndex(spark, str(tmp_path / "i"), ["title", "body"], buckets=4)
    first = [(1, "2024-01-01", 1, "Red fox", "A quick red-fox, again: RED fox."), (2, "2024-01-01", 2, "Blue whale", "the fox is red"), (3, "2024-01-01", 3, None, ""), (4, "2024-01-01", 4, "Élan vital", "fox red fox")]
    assert {r.action for r in index.upsert(versions_of(first)).collect()} == {"inserted"}
    found = lambda q, **w: [(r.item_key, r.snippet) for r in index.search(q, **w).collect()]
    assert found("red-fox") == [(1, "[Red] [fox]"), (4, "fox [red] [fox]")]
    assert {k for k, _ in found("fox red")} == {1, 2, 4} and found("ÉLAN") == [(4, "[Élan] vital")] and found("fox nothing") == []
    assert index.search(" \n ") is None and index.search("?!") is None
    assert found("whale", weights=[9.0, 1.0]) == [(2, "[Blue] whale".replace("[Blue] whale", "Blue [whale]"))]
    ranks = {r.item_key: r.rank for r in index.search("fox").collect()}
    heavy = {r.item_key: r.rank for r in index.search("fox", weights=[5.0, 1.0]).collect()}
    assert heavy[1] > ranks[1] and heavy[2] == ranks[2]
    # a revision replaces, an older version and the same one again are ignored
    second = [(1, "2024-01-03", 9, "Green fox", "no colour"), (2, "2023-12-31", 1, "Old whale", "stale"), (4, "2024-01-01", 4, "Élan vital", "fox red fox"), (5, "2024-01-02", 5, "New", "red fox")]
    assert {r.item_key: r.action for r in index.upsert(versions_of(second)).collect()} == {1: "updated", 2: "ignored", 4: "ignored", 5: "inserted"}
    want = [(4, "fox [red] [fox]"), (5, "[red] [fox]")]
    assert sorted(found("red-fox")) == want and found("stale") == [] and found("quick") == [] and found("green") == [(1, "[Green] fox")]
    before = [tuple(r) for r in index.search("fox").collect()]
    n = spark.read.parquet(str(tmp_path / "i" / "postings")).count()
    index.compact()
    assert [tuple(r) for r in index.search("fox").collect()] == before
    assert spark.read.parquet(str(tmp_path / "i" / "postings")).count() < n


def test_upserts_write_only_what_moved(spark, tmp_path):
    from tidewatch.operators import tables

    path = str(tmp_path / "t")
    df = lambda rows_: spark.createDataFrame(rows_, "k long, at long, v string")
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    act = lambda rows_: {r.k: r.action for r in tables.upsert_into(path, df(rows_), ["k"], "at", 8).collect()}
    assert act([(i, 5, "a") for i in range(20)]) == {i: "inserted" for i in range(20)}
    before = files()
    assert act([(1, 6, "B"), (1, 4, "old"), (2, 5, "same"), (30, 1, "new")]) == {1: "updated", 2: "ignored", 30: "inserted"}
    after = files()
    assert 0 < len(set(before) & set(after)) < len(before)
    assert act([(1, 6, "B"), (30, 1, "new")]) == {1: "ignored", 30: "ignored"} and files() == after
    got = {r.k: (r.at, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {i: (5, "a") for i in range(20)} | {1: (6, "B"), 30: (1, "new")}


def test_sweeps_cover_all_once_and_a_broken_one_is_redone(spark, tmp_path):
    from tidewatch.operators import tables

    base, items = str(tmp_path), spark.range(7).toDF("k")
    work = lambda due: due.select("k", F.explode(F.sequence(F.lit(1), (F.col("k") % 3).cast("int") + 1)).alias("fact")).where("k <> 4")
    run = lambda **w: {r.k: r.facts for r in tables.sweep(base, items, "k", "v1", [F.desc("k")], 3, w.pop("work", work), **w).collect()}
    assert run() == {6: 1, 5: 3, 4: 0}

    def breaks(due):
        return work(due).withColumn("fact", F.when(F.col("k") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("fact")).cast("int"))

    with pytest.raises(Exception, match="broken"):
        run(work=breaks)
    assert run() == {3: 1, 2: 3, 1: 2} and run() == {0: 1} and run() == {}
    assert {r.k: r.n for r in tables.swept(spark, base, "k").groupBy("k").agg(F.count("*").alias("n")).collect()} == {6: 1, 5: 3, 3: 1, 2: 3, 1: 2, 0: 1}
    assert {r.k for r in tables.sweep(base, items, "k", "v2", [F.desc("k")], 2, work).collect()} == {6, 5}
    assert set(run(force=True)) == {6, 5, 4}
    assert tables.swept(spark, base, "k").count() == 11


def test_the_run_in_force_at_each_instant(spark):
    import bisect
    import random
    from datetime import datetime, timedelta

    from tidewatch.operators.asof import in_force

    rnd, day0 = random.Random(13), datetime(2024, 1, 1)
    runs = sorted({day0 + timedelta(hours=rnd.randint(0, 24 * 200)) for _ in range(400)})
    at = [rnd.choice(runs) if rnd.random() < 0.2 else day0 + timedelta(hours=rnd.randint(-100, 24 * 230), minutes=30) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(at)] + [(9000, None)] + [(9001 + i, day0 + timedelta(days=90, hours=5)) for i in range(300)], "k long, t timestamp_ntz")
    given = spark.createDataFrame([(r,) for r in runs] * 2 + [(None,)], "run timestamp_ntz")
    for period in ("day", "month"):
        got = {r.k: (r.t, r.run) for r in in_force(df, "t", given, "run", period, 4).collect()}
        assert len(got) == 1801 and got[9000] == (None, None)
        for t, run in got.values():
            n = bisect.bisect_right(runs, t) if t else 0
            assert run == (runs[n - 1] if n else None)
    assert {r.run for r in in_force(df, "t", given.limit(0), "run").collect()} == {None}


def test_feed_pages_go_on_where_they_ended(spark):
    from tidewatch.operators import feed as FD

    rows_ = [(i, f"s{i % 3}", "news", "b", float(i // 4), i % 5 == 0, (i % 2 + 1) if i % 5 == 0 else None, 1, None) for i in range(23)]
    df = spark.createDataFrame(rows_, "item_key long, source_id string, kind string, beat string, score double, pinned boolean, priority int, cluster_size long, saved_at timestamp_ntz")
    want = [r[0] for r in sorted(rows_, key=lambda r: (not r[5], r[6] or 99, -r[4], -r[0]))]
    asked, seen, pages = FD.Asked("2024-01-20 12:00:00", kind="news", profile="read"), [], 0
    while True:
        page = FD.page(df, asked, 5).orderBy("place").collect()
        assert {r.total for r in page} == {23} and [r.place for r in page] == list(range(1, len(page) + 1))
        seen, pages = seen + [r.item_key for r in page], pages + 1
        if page[-1].next_after is None:
            break
        asked = FD.Asked.of(page[-1].next_after)
        assert (asked.now, asked.beat, asked.kind, asked.profile) == ("2024-01-20 12:00:00", None, "news", "read") and asked.after[3] == page[-1].item_key
    assert seen == want and pages == 5
    # a page that ends with the last row has no cursor
    assert [r.next_after for r in FD.page(df, FD.Asked("2024-01-20 12:00:00"), 23).collect()] == [None] * 23
    for bad in ("", "x", "e30", page[0].next_after or "!!"):
        with pytest.raises(ValueError, match="invalid feed cursor"):
            FD.Asked.of(bad)
    with pytest.raises(ValueError):
        FD.page(df, asked, 201)


def test_a_pass_counts_all_rows_and_writes_the_good_ones(spark, tmp_path):
    from tidewatch.operators.passes import as_row, counted_write

    df = spark.range(100).select("id", F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"))
    counts = counted_write(df, str(tmp_path / "p"), F.col("v") % 2 == 0, {"rows": F.count("*"), "missing": F.count_if(F.col("v").isNull()), "total": F.sum("v")})
    assert counts == {"rows": 100, "missing": 15, "total": sum(i for i in range(100) if i % 7)}
    assert rows(spark.read.parquet(str(tmp_path / "p")).select("id")) == sorted(((i,) for i in range(100) if i % 7 and i % 2 == 0), key=repr)
    assert [tuple(r) for r in as_row(df, counts).collect()] == [tuple(counts.values())]
    assert counted_write(df.limit(0), str(tmp_path / "q"), F.lit(True), {"rows": F.count("*"), "total": F.sum("v")}) == {"rows": 0, "total": 0}


def test_related_names_are_exact_with_large_items(spark):
    import random
    from collections import Counter, defaultdict

    from tidewatch.operators.related import related

    rnd = random.Random(14)
    rows_ = [(f"e{rnd.randint(0, 60):02d}", i) for i in range(150) for _ in range(rnd.randint(1, 6))]
    for item in (900, 901, 902):
        rows_ += [(f"e{k:02d}", item) for k in range(61) if rnd.random() < 0.6]
    rows_ += rows_[:20] + [("alone", 5)]
    baskets, counts = defaultdict(set), Counter(e for e, _ in set(rows_))
    for e, i in set(rows_):
        if counts[e] >= 2:
            baskets[i].add(e)
    shared = defaultdict(Counter)
    for names in baskets.values():
        for a in names:
            shared[a].update(names - {a})
    want = {(a, b, n, place + 1) for a, c in shared.items() for place, (b, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:4])}
    df = spark.createDataFrame(rows_, "entity string, item_key long").repartition(3)
    for large in (8, 30, 1000):
        assert {tuple(r) for r in related(df, 4, 2, large).collect()} == want
    # an item of 10,000 names makes no pairs of them
    wide = spark.range(10_000).select(F.format_string("n%05d", "id").alias("entity"), F.explode(F.array(F.lit(1), F.lit(2))).alias("item_key")).union(spark.createDataFrame([("n00003", 7), ("n00009", 7)], "entity string, item_key int"))
    got = {(r.entity, r["place"]): (r.related, r.weight) for r in related(wide, 3).where("entity in ('n00000', 'n00003', 'n09999')").collect()}
    assert got == {("n00000", 1): ("n00001", 2), ("n00000", 2): ("n00002", 2), ("n00000", 3): ("n00003", 2), ("n00003", 1): ("n00009", 3), ("n00003", 2): ("n00000", 2), ("n00003", 3): ("n00001", 2), ("n09999", 1): ("n00000", 2), ("n09999", 2): ("n00001", 2), ("n09999", 3): ("n00002", 2)}


def test_overlap_pairs_no_stories_by_a_token_that_many_names_share(spark):
    from tidewatch.operators import monitor

    # half of the numbers are in no title, which leaves their names nothing but the common token
    repos = spark.range(200).select(F.concat(F.lit("o/repo-"), "id").alias("repo_key"), F.concat(F.lit("Repo-"), "id").alias("name")).union(spark.createDataFrame([("o/long", "the-repo-7-and"), ("o/none", None)], "repo_key string, name string"))
    stories = spark.range(200).select("id", F.concat(F.lit("see the repo "), (F.col("id") % 100).cast("string"), F.lit(" and repo and")).alias("title"), F.lit("https://x.org/").alias("url"), F.col("id").alias("fetched_at")).withColumnRenamed("id", "story_key").union(spark.createDataFrame([(900, None, None, 1), (901, "repo", "https://github.com/o/none", 2)], "story_key long, title string, url string, fetched_at long"))
    out = monitor.discussion_overlap(repos, stories, 5)
    want = {f"o/repo-{i}": (2, 0.6, i) for i in range(100)} | {"o/long": (2, 0.6, 7), "o/none": (1, 1.0, 2)}
    assert {r.repo_key: (r.mentions, r.strength, r.first_at) for r in out.collect()} == want
    # no join lists candidates that a condition has to sort out
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().lower().split("\n") if "join " in x]
    assert len(joins) == 2 and not any("contains(" in x for x in joins)


def test_overlay_of_sites_equals_its_sql_where_keys_of_both_files_meet(spark, tmp_path):
    import duckdb

    from tidewatch.operators import monitor
    from tidewatch.plans.monitor import overlaid_sites
    from tidewatch.registry import ORACLE_SQL

    part = [(k, f"Brand#{k % 7}", k % 50) for k in (1, 5, 999_999, 1_000_000, 1_000_001, 1_000_005, 1_000_007)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, f"Supplier#{k}") for k in (1, 5, 6)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, overlaid_sites(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(ORACLE_SQL["overlaid_sites"]).fetchall())
    assert {k: name for k, name, _ in got if k > 1_000_000} == {1_000_001: "Supplier#1", 1_000_005: "overlay", 1_000_006: "Supplier#6", 1_000_007: "Brand#1"}
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    over = [(1, "x"), (1, "z"), (1, "y")]
    for rows_ in (over, over[::-1]):
        assert sorted(map(tuple, monitor.overlaid(base, spark.createDataFrame(rows_, "k int, v string"), "k").collect())) == [(1, "z"), (2, "b")]


def test_page_paragraphs_equal_their_sql_with_every_kind_of_character_reference(spark, tmp_path):
    import duckdb

    from tidewatch.plans.extraction import page_paragraphs, prose_paragraphs
    from tidewatch.registry import ORACLE_SQL

    refs = ["&copy;", "&middot;", "&eacute;", "&apos;", "&#8212;", "&#x1F600;", "&#X41;", "&#0;", "&#xD800;", "&#1114112;", "&nosuch;", "&amp;lt;", "&lt", "& ", "&;", "&amp;amp;", "&sup2;", "&thetasym;", "&#000000065;", "&NBSP;", "&Eacute;x&", "a&b;c"]
    texts = [f"<p>Words {r} of a paragraph {r}that is long enough.</p>" for r in refs] + ["<h1>Head</h1>&nbsp;<p>Tail &hellip; words of it, and more&#10;&#10;after a break of lines.</p>", None, "&"]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    df.toDF("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t, query in (("pages", page_paragraphs), ("documents", prose_paragraphs)):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        got = {r.item_key: r.paragraph for r in query(spark, str(tmp_path)).collect()}
        assert got == dict(con.sql(ORACLE_SQL[query.__name__]).fetchall())
    assert got[0].startswith("Words © of") and got[3].startswith("Words ' of") and "&nosuch;" in got[10] and "&lt;" in got[11]


def test_spread_deals_one_row_group_to_every_core(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidewatch.session import spread

    # many bytes in one row group: split by bytes, but all rows lie in one split
    pq.write_table(pa.table({"k": list(range(2000)), "t": [f"{i:05d}" * 3000 for i in range(2000)]}), f"{tmp_path}/t.parquet", compression="none", use_dictionary=False)
    used = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and used(df) == 1
    assert used(spread(df)) >= spark.sparkContext.defaultParallelism and spread(df).count() == 2000
