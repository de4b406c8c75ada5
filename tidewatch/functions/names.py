"""Column expressions for file names, slugs, labels and the evidence behind a summary."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewatch.functions.text import strip_markup, words

# Words that add nothing to a headline, what file systems and links reserve, limits.
CONTENT_STOP = (
    "a an the and or but of in on for to with by from as at is are was were be been being it its "
    "this that these those we our you your they their he she his her not no if then than so such "
    "into over under after before new has have had will would can could may might do does did"
).split()
BODY_WORDS, NOVEL_WORDS, MATERIAL_CHARS, WORDS_A_MINUTE = 400, 8, 6000, 200
SLUG_CHARS, KEY_CHARS, NAME_BYTES = 80, 12, 200
RESERVED = r'[:*?"<>|\[\]#^]'
DEVICE = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"
#: White space at an edge, in any script.
SPACE = r"[\t-\r\p{Z}\x{FEFF}]"


@F.pandas_udf(StringType())
def unaccented(title: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, which no built-in function offers."""
    return title.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M")))


def slug(title: Column) -> Column:
    """ASCII letters and digits joined by dashes, at most 80, cut at a dash; "untitled" where nothing is left."""
    plain = F.regexp_replace(F.lower(unaccented(title)), "[^a-z0-9]+", "-")
    whole = F.regexp_replace(plain, "^-+|-+$", "")
    head = F.substring(whole, 1, SLUG_CHARS)
    at_dash = F.regexp_extract(head, "^(.+)-[^-]*$", 1)
    short = F.when(F.length(whole) <= SLUG_CHARS, whole).when(at_dash != "", at_dash).otherwise(head)
    return F.when(F.coalesce(short, F.lit("")) == "", "untitled").otherwise(short)


def note_path(saved_at: Column, title: Column, item_key: Column, zone: str) -> Column:
    """saved/{local day}-{slug}-{first 12 of the key}.md"""
    day = F.date_format(F.from_utc_timestamp(saved_at.cast("timestamp"), zone), "yyyy-MM-dd")
    return F.concat(F.lit("saved/"), day, F.lit("-"), slug(title), F.lit("-"), F.substring(item_key, 1, KEY_CHARS), F.lit(".md"))


def name_reason(name: Column) -> Column:
    """Why a name can't be a file's, by the first rule it breaks; null where it can (a null name is empty)."""
    return (
        F.when(name.isNull() | name.rlike(f"^{SPACE}*$"), "empty")
        .when(name.contains("/") | name.contains("\\"), "separator")
        .when(name.rlike(f"^{SPACE}|{SPACE}$"), "whitespace_edge")
        .when(name.rlike(r"[\x00-\x1f\x7f]"), "control_char")
        .when(name.startswith("."), "dot_leading")
        .when(name.rlike(RESERVED), "reserved_char")
        .when(name.rlike(DEVICE), "device_name")
        .when(F.octet_length(name) + 3 > NAME_BYTES, "too_long")
    )


def content_words(text: Column) -> Column:
    """Distinct words of three letters or more that are not in the fixed list."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s-]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*CONTENT_STOP)))


def novel_words(title: Column, text: Column) -> Column:
    """Content words of the text that the title lacks."""
    return F.size(F.array_except(content_words(text), content_words(title)))


def evidence(title: Column, excerpt: Column, body: Column) -> Column:
    """struct(words, novel, level, minutes, truncated): a body of 400 words, else an excerpt that adds 8 words to the title."""
    n = F.size(words(strip_markup(F.coalesce(body, F.lit("")))))
    novel = F.size(F.array_except(content_words(strip_markup(F.coalesce(excerpt, F.lit("")))), content_words(F.coalesce(title, F.lit("")))))
    level = F.when(n >= BODY_WORDS, "body").when(novel >= NOVEL_WORDS, "excerpt").otherwise("headline")
    minutes = F.when(n >= BODY_WORDS, F.greatest(F.lit(1), F.round(n / WORDS_A_MINUTE).cast("int")))
    cut = (n >= BODY_WORDS) & (F.length(strip_markup(body)) > MATERIAL_CHARS)
    return F.struct(n.alias("words"), novel.alias("novel"), level.alias("level"), minutes.alias("minutes"), F.coalesce(cut, F.lit(False)).alias("truncated"))


def label(text: Column) -> Column:
    """A Markdown link label: brackets and backslashes escaped, angle brackets as entities."""
    out = F.regexp_replace(text, r"([\\\[\]])", r"\\$1")
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def target(url: Column) -> Column:
    """A link target in angle brackets, with the characters that would end it encoded."""
    return F.replace(F.replace(F.replace(url, F.lit(" "), F.lit("%20")), F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))


def some_of(values: Column, most: int) -> Column:
    """"a, b +n more" of an array."""
    head = F.array_join(F.slice(values, 1, most), ", ")
    return F.when(F.size(values) > most, F.concat(head, F.lit(" +"), (F.size(values) - most).cast("string"), F.lit(" more"))).otherwise(head)
