"""The first paragraph of prose of a document in light markup or HTML.

HTML is rewritten to light markup first: headings, list items and table cells begin lines of
their own, other blocks are set apart by blank lines. Then one fold over the lines keeps three
things: what is being skipped (a fence or front matter, by the mark that ends it), the lines of
the paragraph that is open, and the first paragraph that was good enough.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of prose (fixed values): words and characters at least, characters at most.
LEAST_WORDS, LEAST_CHARS, MOST_CHARS = 4, 20, 300
#: Shares of linked characters (fixed values): of any paragraph, and of one with several links.
ALL_LINK, ROW_OF_LINKS = 0.9, 0.6

WHITE = " \t\x0b\f\r"
#: Marks before and behind a link's label.
OPEN, CLOSE = "\x01", "\x02"
#: What is rewritten before lines are read: (pattern, what stands in its place; ``@`` for the group).
MARKUP = [
    ("\r\n", "\n"),
    ("(?s)<!--.*?(?:-->|\\z)", ""),
    (r"(?is)<(?:script|style|head|svg)\b.*?</(?:script|style|head|svg)[ \n]*>", "\n\n"),
    (r"!\[[^\]]*\]\([^)]*\)|(?i:<img\b[^>]*>)", ""),
    (r"(?is)<a\b[^>]*>(.*?)</a[ \n]*>", f"{OPEN}@{CLOSE}"),
    (r"\[([^\[\]]*)\](?:\([^()]*\)|\[[^\[\]]*\])", f"{OPEN}@{CLOSE}"),
    (r"<?https?://[^\s<>()]+>?", ""),
    (r"(?i)</?pre\b[^>]*>", "\n```\n"),
    (r"(?i)<br\b[^>]*>", "\n"),
    (r"(?i)<h[1-6]\b[^>]*>", "\n\n# "),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<t[dh]\b[^>]*>", "\n| "),
    (r"(?i)<(?:blockquote|dt|title)\b[^>]*>", "\n> "),
    (r"(?i)</?(?:p|div|ul|ol|dl|table|tr|section|article|main|header|footer|body|html|figure|center|details|nav|hr)\b[^>]*>|</(?:h[1-6]|li|t[dh]|blockquote|dt|dd|title)[^>]*>", "\n\n"),
    (r"</?[A-Za-z][^<>]*>", ""),
]
#: Beginnings of lines that belong to no paragraph: headings, list items, definitions of links.
STRUCTURE = r"^(?:#{1,6}|[-+*]|[0-9]{1,9}[.)])(?:[ \t]|$)|^\[[^\]]+\]:"
#: Characters of which rules, underlines and the second lines of tables are made.
RULES = "-=|:*_~^ "
#: Emphasis at the edge of a word.
EMPHASIS = [(r"(^|[^\p{L}\p{N}*_])[*_]+", "@"), (r"[*_]+([^\p{L}\p{N}*_]|$)", "@"), (r"`|~~", ""), (r"[ \t\n\x0b\f\r]+", " ")]


#: HTML's named characters, and XML's fifth.
NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by.replace("@", "$1"))
    return text


def unescaped(text: Column) -> Column:
    """The text with HTML's character references, named and numeric, as characters; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    code = lambda digits, base: F.conv(digits, base, 10).cast("int")
    char = lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def read(piece: Column) -> Column:
        name = F.substring_index(piece, ";", 1)
        number = F.when(name.rlike(r"^#[0-9]{1,7}\z"), code(F.substring(name, 2, 9), 10)).when(name.rlike(r"^#[xX][0-9a-fA-F]{1,6}\z"), code(F.substring(name, 3, 9), 16))
        found = F.coalesce(char(number), F.when(name.rlike(r"^[A-Za-z0-9]{2,8}\z"), F.try_element_at(names, name)))
        known = F.instr(piece, ";").between(3, 10) & found.isNotNull()
        return F.when(known, F.concat(found, F.substr(piece, F.instr(piece, ";") + 1))).otherwise(F.concat(F.lit("&"), piece))

    joined = lambda pieces: F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), read), ""))
    return bound(text, lambda t: F.when(F.instr(t, "&") > 0, bound(F.split(t, "&"), joined)).otherwise(t))


def lines(text: Column) -> Column:
    """array<struct<t, kind>>: the text's lines with what each is, and a blank one at the end.

    Kinds: blank, fence, rule, block, code (indented) and text.
    """

    def known(pair: Column) -> Column:
        line, t = pair["line"], pair["t"]
        starts = lambda *marks: F.coalesce(*[F.when(t.startswith(m), True) for m in marks], F.lit(False))
        kind = (
            F.when(t == "", "blank").when(starts("```", "~~~"), "fence").when(F.translate(t, RULES, "") == "", "rule")
            .when(starts("|", ">", "..") | t.rlike(STRUCTURE), "block").when(line.startswith("    ") | line.startswith("\t"), "code").otherwise("text")
        )
        return F.struct(t.alias("t"), kind.alias("kind"))

    marked = _rewritten(F.regexp_replace(text, "^﻿", ""), MARKUP)
    split = F.concat(F.split(unescaped(marked), "\n"), F.array(F.lit("")))
    return F.transform(F.transform(split, lambda line: F.struct(line.alias("line"), F.trim(line, F.lit(WHITE)).alias("t"))), known)


def _good(paragraph: Column) -> Column:
    """The paragraph's text, cut to the most characters; null if it is too short or mostly links."""
    flat = F.trim(_rewritten(F.array_join(paragraph, " "), EMPHASIS))
    one = F.transform(F.array(flat), lambda t: F.struct(F.translate(t, OPEN + CLOSE, "").alias("t"), F.length(F.regexp_replace(t, f"[^{OPEN}]", "")).alias("links"), F.length(F.translate(F.regexp_replace(t, f"{OPEN}[^{CLOSE}]*{CLOSE}", ""), OPEN + CLOSE, "")).alias("free")))

    def prose(p: Column) -> Column:
        linked = 1 - p["free"] / F.greatest(F.length(p["t"]), F.lit(1))
        words = F.size(F.filter(F.split(p["t"], " "), lambda w: w.rlike("[A-Za-z]")))
        return (F.length(p["t"]) >= LEAST_CHARS) & (words >= LEAST_WORDS) & ~((p["links"] >= 1) & (linked >= ALL_LINK)) & ~((p["links"] >= 2) & (linked > ROW_OF_LINKS))

    # each value is worked out once
    cut = lambda t: bound(F.substring(t, 1, MOST_CHARS), lambda short: F.substring(short, F.lit(1), F.length(short) - F.length(F.substring_index(short, " ", -1))))
    return bound(F.get(F.filter(one, prose), F.lit(0))["t"], lambda t: F.trim(F.when(F.length(t) > MOST_CHARS, cut(t)).otherwise(t)))


def first_paragraph(text: Column) -> Column:
    """The first paragraph of prose: no structure, 4 words and 20 characters or more, not mostly links; at most 300 characters, cut before a word."""
    begun = F.struct(
        F.when(text.rlike("^﻿?---[ \\t\\r]*(\\n|$)"), F.lit("---")).otherwise(F.lit("")).alias("skip"),
        F.array().cast("array<string>").alias("open"), F.lit(None).cast("string").alias("found"), F.lit(0).alias("at"),
    )

    def step(state: Column, row: Column) -> Column:
        t, kind, skip = row["t"], row["kind"], state["skip"]
        ends_skip = (skip != "") & (state["at"] > 0) & t.startswith(skip) & (F.length(F.translate(t, "`~-", "")) == 0)
        goes_on = (kind == "text") | ((kind == "code") & (F.size(state["open"]) > 0))
        ended = (skip == "") & ~goes_on & (kind != "rule") & (F.size(state["open"]) > 0)
        return F.struct(
            F.when(ends_skip, "").when((skip == "") & (kind == "fence"), F.substring(t, 1, 3)).otherwise(skip).alias("skip"),
            F.when((skip == "") & goes_on, F.concat(state["open"], F.array(t))).otherwise(F.array().cast("array<string>")).alias("open"),
            F.when(ended, _good(state["open"])).alias("found"),
            (state["at"] + 1).alias("at"),
        )

    def merge(state: Column, row: Column) -> Column:
        return F.when(state["found"].isNotNull(), state).otherwise(step(state, row))

    return F.aggregate(lines(text), begun, merge, lambda s: s["found"])


def first_paragraph_sql(text: str) -> str:
    """DuckDB's expression of the same."""
    quoted = lambda s: " || ".join(f"chr({ord(c)})" if c in "\r\n\x01\x02" else f"'{c}'" for c in s) if s else "''"
    chain = lambda e, rules: _chain(e, [(p, by.replace("@", "\\1")) for p, by in rules], quoted)
    marked = chain(f"regexp_replace({text}, '^﻿', '')", MARKUP)
    marked = _unescaped_sql(marked)
    white = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    structure = STRUCTURE.replace("'", "''")
    rows = f"""list_transform(list_append(string_split({marked}, chr(10)), ''), lambda l: {{'t': trim(l, {white}), 'kind': CASE WHEN trim(l, {white}) = '' THEN 'blank'
        WHEN starts_with(trim(l, {white}), '```') OR starts_with(trim(l, {white}), '~~~') THEN 'fence' WHEN translate(trim(l, {white}), '{RULES}', '') = '' THEN 'rule'
        WHEN starts_with(trim(l, {white}), '|') OR starts_with(trim(l, {white}), '>') OR starts_with(trim(l, {white}), '..') OR regexp_matches(trim(l, {white}), '{structure}') THEN 'block'
        WHEN starts_with(l, '    ') OR starts_with(l, chr(9)) THEN 'code' ELSE 'text' END}})"""
    flat = "trim(" + chain("array_to_string(s.open, ' ')", EMPHASIS) + ")"
    bare = f"translate({flat}, chr(1) || chr(2), '')"
    free = f"(1 - length(translate(regexp_replace({flat}, chr(1) || '[^' || chr(2) || ']*' || chr(2), '', 'g'), chr(1) || chr(2), ''))::DOUBLE / greatest(length({bare}), 1))"
    links = f"(length({flat}) - length(replace({flat}, chr(1), '')))"
    cut = f"left({bare}, {MOST_CHARS})"
    good = f"""CASE WHEN length({bare}) >= {LEAST_CHARS} AND len(list_filter(string_split({bare}, ' '), lambda w: regexp_matches(w, '[A-Za-z]'))) >= {LEAST_WORDS}
        AND NOT ({links} >= 1 AND {free} >= {ALL_LINK}) AND NOT ({links} >= 2 AND {free} > {ROW_OF_LINKS})
        THEN trim(CASE WHEN length({bare}) > {MOST_CHARS} THEN left({cut}, length({cut}) - length(list_last(string_split({cut}, ' ')))) ELSE {bare} END) END"""
    goes_on = "(r.kind = 'text' OR r.kind = 'code' AND len(s.open) > 0)"
    return f"""list_reduce({rows}, lambda s, r: CASE WHEN s.found IS NOT NULL THEN s ELSE {{
        'skip': CASE WHEN s.skip <> '' AND s.nth > 0 AND starts_with(r.t, s.skip) AND translate(r.t, '`~-', '') = '' THEN '' WHEN s.skip = '' AND r.kind = 'fence' THEN left(r.t, 3) ELSE s.skip END,
        'open': CASE WHEN s.skip = '' AND {goes_on} THEN list_append(s.open, r.t) ELSE []::VARCHAR[] END,
        'found': CASE WHEN s.skip = '' AND NOT {goes_on} AND r.kind <> 'rule' AND len(s.open) > 0 THEN {good} END,
        'nth': s.nth + 1}} END,
        {{'skip': CASE WHEN regexp_matches({text}, '^﻿?---[ \\t\\r]*(\\n|$)') THEN '---' ELSE '' END, 'open': []::VARCHAR[], 'found': NULL::VARCHAR, 'nth': 0}}).found"""


def _unescaped_sql(text: str) -> str:
    """DuckDB's expression of ``unescaped``."""
    names = ", ".join(f"'{name}': chr({ord(char)})" for name, char in NAMES.items())
    # a piece between ampersands: its name, the code of a number, what stands for it
    pieces = f"list_transform(string_split({text}, '&')[2:], lambda p: {{'p': p, 'name': split_part(p, ';', 1)}})"
    digits = "CASE WHEN regexp_full_match(x.name, '#[0-9]{1,7}') THEN substr(x.name, 2)::INTEGER WHEN regexp_full_match(x.name, '#[xX][0-9a-fA-F]{1,6}') THEN ('0x' || substr(x.name, 3))::INTEGER END"
    coded = f"list_transform({pieces}, lambda x: {{'p': x.p, 'name': x.name, 'code': {digits}}})"
    found = f"CASE WHEN x.code BETWEEN 1 AND 55295 OR x.code BETWEEN 57344 AND 1114111 THEN chr(x.code) ELSE map {{{names}}}[x.name] END"
    read = f"list_transform({coded}, lambda x: CASE WHEN instr(x.p, ';') BETWEEN 3 AND 10 THEN coalesce({found} || substr(x.p, instr(x.p, ';') + 1), '&' || x.p) ELSE '&' || x.p END)"
    return f"(string_split({text}, '&')[1] || array_to_string({read}, ''))"


def _chain(expression: str, rules: list[tuple[str, str]], quoted) -> str:
    for pattern, by in rules:
        expression = f"regexp_replace({expression}, {quoted(pattern)}, {quoted(by)}, 'g')" if any(c in pattern + by for c in "\r\n\x01\x02") else f"regexp_replace({expression}, '{pattern}', '{by}', 'g')"
    return expression
