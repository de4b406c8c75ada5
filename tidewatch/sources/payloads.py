"""Entries of known payload shapes as item rows (url, title, published_at, summary, author)."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewatch.functions.dates import publication_date
from tidewatch.functions.text import excerpt

ITEM = ("url", "title", "published_at", "summary", "author")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once a row however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def text_at(v: Column, path: str) -> Column:
    """The string at a path of a variant; a value of another type is null."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def not_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _item(url: Column, title: Column, published: Column, summary: Column, author: Column) -> Column:
    """The item, null unless it has a URL and a title that are not blank."""
    whole = F.struct(url.alias("url"), title.alias("title"), published.alias("published_at"), summary.alias("summary"), author.alias("author"))
    return F.when(not_blank(url).isNotNull() & not_blank(title).isNotNull(), whole)


def _none() -> Column:
    return F.lit(None).cast("string")


def exploited(v: Column) -> Column:
    """Catalog of exploited vulnerabilities: the page is looked up by its id."""
    key = text_at(v, "$.cveID")
    url = F.concat(F.lit("https://www.cisa.gov/known-exploited-vulnerabilities-catalog?field_cve="), F.url_encode(not_blank(key)))
    return _item(url, text_at(v, "$.vulnerabilityName"), text_at(v, "$.dateAdded"), text_at(v, "$.shortDescription"), _none())


def vulnerability(v: Column) -> Column:
    """Vulnerability records: the first English description; a local time without zone is UTC."""
    key, at = text_at(v, "$.cve.id"), text_at(v, "$.cve.published")
    told = F.try_variant_get(v, "$.cve.descriptions", "array<struct<lang: string, value: string>>")
    english = F.get(F.filter(told, lambda d: d["lang"] == "en"), F.lit(0))["value"]
    utc = F.when(at.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$"), F.concat(at, F.lit("Z"))).otherwise(at)
    return _item(F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), not_blank(key)), key, utc, english, _none())


def discussion(v: Column) -> Column:
    """Search hits of a discussion site: its own page where the hit links nowhere."""
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), not_blank(text_at(v, "$.objectID")))
    return _item(F.coalesce(not_blank(text_at(v, "$.url")), page), text_at(v, "$.title"), text_at(v, "$.created_at"), text_at(v, "$.story_text"), text_at(v, "$.author"))


def register_document(v: Column) -> Column:
    """Documents of a government register."""
    return _item(text_at(v, "$.html_url"), text_at(v, "$.title"), text_at(v, "$.publication_date"), text_at(v, "$.abstract"), _none())


def weather_alert(v: Column) -> Column:
    """Weather alerts: headline, else event; sent, else effective."""
    p = lambda c: text_at(v, f"$.properties.{c}")
    either = lambda a, b: F.coalesce(not_blank(p(a)), not_blank(p(b)))
    return _item(text_at(v, "$.id"), either("headline", "event"), either("sent", "effective"), p("description"), p("senderName"))


SHAPES = {"exploited": exploited, "vulnerability": vulnerability, "discussion": discussion, "register": register_document, "weather": weather_alert}


def items(df: DataFrame, shape: str, entry: str) -> DataFrame:
    """The other columns of ``df`` and the item of each JSON ``entry`` of one shape; entries without one are dropped."""
    rest = [c for c in df.columns if c != entry]
    return df.select(*rest, once(F.try_parse_json(entry), SHAPES[shape]).alias("_item")).where("_item is not null").select(*rest, "_item.*")


def strip_publisher(title: Column, publisher: Column) -> Column:
    """The title without `` - publisher`` at its end, unless nothing would be left."""
    tail = F.concat(F.lit(" - "), publisher)
    short = F.substring(title, F.lit(1), F.length(title) - F.length(tail))
    return F.when(title.endswith(tail) & (F.trim(short) != ""), short).otherwise(title)


def repository(v: Column) -> Column:
    """(repo, reason): a code-host search entry as a typed repository, or why it is none."""
    return once(v, lambda v: once(_repository_fields(v), lambda r: once(publication_date(r["pushed"]), lambda at: _typed(r, at))))


def _repository_fields(v: Column) -> Column:
    """The fields of an entry that have the type they should have."""
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    number = lambda p: F.when(kind(p) == "BIGINT", F.try_variant_get(v, p, "bigint"))
    flag = lambda p: F.when(kind(p) == "BOOLEAN", F.try_variant_get(v, p, "boolean"))
    return F.struct(
        number("$.id").alias("id"), text_at(v, "$.owner.login").alias("owner"), text_at(v, "$.name").alias("name"), flag("$.fork").alias("fork"), flag("$.archived").alias("archived"),
        text_at(v, "$.pushed_at").alias("pushed"), F.coalesce(kind("$.pushed_at") != "VOID", F.lit(False)).alias("dated"), number("$.stargazers_count").alias("stars"), number("$.open_issues_count").alias("issues"),
        not_blank(text_at(v, "$.license.spdx_id")).alias("licence"), text_at(v, "$.description").alias("description"), not_blank(text_at(v, "$.language")).alias("language"),
    )


def _typed(r: Column, at: Column) -> Column:
    segment = lambda c: F.coalesce(c.rlike(r"^[^/\s]+$"), F.lit(False))
    count = lambda c: F.coalesce(c >= 0, F.lit(False))
    reason = (
        F.when(~F.coalesce(r["id"] > 0, F.lit(False)), "id")
        .when(~segment(r["owner"]), "owner").when(~segment(r["name"]), "name")
        .when(r["fork"].isNull() | r["archived"].isNull(), "flags")
        .when(r["dated"] & at.isNull(), "pushed_at")
        .when(~count(r["stars"]), "stars").when(~count(r["issues"]), "issues")
    )
    repo = F.struct(
        r["id"].alias("repo_id"), F.concat_ws("/", r["owner"], r["name"]).alias("full_name"), once(r["description"], excerpt).alias("description"), r["language"].alias("language"),
        F.when(r["licence"] != "NOASSERTION", r["licence"]).alias("licence"), r["stars"].alias("stars"), r["issues"].alias("issues"), at.alias("pushed_at"), r["fork"].alias("fork"), r["archived"].alias("archived"),
    )
    return once(reason, lambda why: F.struct(F.when(why.isNull(), repo).alias("repo"), why.alias("reason")))


def _pruned(value):
    if isinstance(value, dict):
        return {k: _pruned(v) for k, v in value.items() if k == "html_url" or not k.endswith("_url")}
    return [_pruned(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def prune_urls(payload: pd.Series) -> pd.Series:
    """JSON without the keys that end in _url, at any depth, but for html_url; text that is no JSON is null."""

    def one(text):
        try:
            return json.dumps(_pruned(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return payload.map(one)


def longest_body(payload: Column) -> Column:
    """The longest of content:encoded, content, description and summary of a JSON payload, each a string or an object with #text; of equal ones the last."""
    names = ["content:encoded", "content", "description", "summary"]
    told = lambda v: F.array(*[F.coalesce(text_at(v, f"$['{k}']"), text_at(v, f"$['{k}']['#text']")) for k in names])
    sized = lambda v: F.transform(told(v), lambda t, i: F.struct(F.length(t).alias("n"), i.alias("i"), t.alias("t")))
    return once(F.try_parse_json(payload), lambda v: F.array_max(F.filter(sized(v), lambda c: c["t"].isNotNull()))["t"])
