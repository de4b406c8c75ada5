"""Feed and sitemap documents as entry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RSS = "link string, title string, description string, `content:encoded` string, `dc:creator` string, author string, pubDate string"
ATOM = "link array<struct<_rel: string, _href: string>>, title string, summary string, content string, published string, updated string, author struct<name: string>"
SITEMAP = "loc string, `news:news` struct<`news:title`: string, `news:publication_date`: string, `news:publication`: struct<`news:name`: string, `news:language`: string>>"


def blocks(body: Column, tag: str) -> Column:
    """The text of each ``<tag>`` up to its end or to the next beginning, so that an entry left open swallows no other."""
    raw = F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}[\s>].*?(?=<{tag}[\s>]|$)"), F.lit(0))
    closed = lambda b: F.when(F.contains(b, F.lit(f"</{tag}>")), F.concat(F.substring_index(b, f"</{tag}>", 1), F.lit(f"</{tag}>")))
    cut = lambda b: F.concat(F.regexp_replace(b, r"(?s)</(channel|rss|feed|urlset)>.*$", ""), F.lit(f"</{tag}>"))
    return F.transform(raw, lambda b: F.coalesce(closed(b), cut(b)))


def _parsed(df: DataFrame, body: str, tag: str, schema: str) -> DataFrame:
    rest = [c for c in df.columns if c != body]
    rows = df.select(*rest, F.col(body), F.posexplode(blocks(F.col(body), tag)).alias("pos", "_block"))
    return rows.withColumn("_e", F.from_xml("_block", schema, {"mode": "PERMISSIVE", "attributePrefix": "_"}))


def _accepted(df: DataFrame, rest: list[str], **item: Column) -> DataFrame:
    out = df.select(*rest, "pos", *[c.alias(n) for n, c in item.items()])
    return out.where((F.trim("url") != "") & (F.trim("title") != ""))


def rss_items(df: DataFrame, body: str) -> DataFrame:
    """Items of RSS documents with a link and a title: summary is the description, else the encoded content; author the creator, else the author."""
    rest = [c for c in df.columns if c != body]
    e = lambda n: F.col("_e")[n]
    return _accepted(_parsed(df, body, "item", RSS), rest, url=e("link"), title=e("title"), published_at=e("pubDate"), summary=F.coalesce(e("description"), e("content:encoded")), author=F.coalesce(e("dc:creator"), e("author")))


def atom_entries(df: DataFrame, body: str) -> DataFrame:
    """Entries of Atom documents: first alternate link, summary else content, published else updated, the entry's author else the feed's."""
    rest = [c for c in df.columns if c != body]
    e = lambda n: F.col("_e")[n]
    link = F.get(F.filter(e("link"), lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate")), F.lit(0))["_href"]
    head = F.substring_index(F.col(body), "<entry", 1)
    own = F.regexp_extract(head, r"(?s)<author>.*?<name>(.*?)</name>", 1)
    return _accepted(_parsed(df, body, "entry", ATOM), rest, url=link, title=e("title"), published_at=F.coalesce(e("published"), e("updated")), summary=F.coalesce(e("summary"), e("content")), author=F.coalesce(e("author")["name"], F.when(own != "", own)))


def sitemap_items(df: DataFrame, body: str) -> DataFrame:
    """Rows of a news sitemap with a location and a news title."""
    rest = [c for c in df.columns if c != body]
    news = F.col("_e")["news:news"]
    return _accepted(_parsed(df, body, "url", SITEMAP), rest, url=F.col("_e")["loc"], title=news["news:title"], published_at=news["news:publication_date"], lang=news["news:publication"]["news:language"])
