"""Column expressions over titles, bodies and URLs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that titles are compared without (fixed values).
STOP = ["a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "is", "as", "by", "with", "from", "into", "after", "over", "amid", "its", "it", "be", "are", "was", "were", "that", "this", "but", "or", "not", "no", "up", "down", "out", "about", "than", "then", "so"]
#: Query parameters that only track (fixed values).
TRACKING = r"^(utm_|at_).*$|^(fbclid|gclid|mc_cid|mc_eid)$"
#: Hosts, and ends of hosts, that are known to serve https (fixed values).
HTTPS_HOSTS = ["arxiv.org", "apnews.com", "federalregister.gov", "nvd.nist.gov", "cisa.gov", "krebsonsecurity.com", "bleepingcomputer.com", "owasp.org", "huggingface.co", "simonwillison.net", "deepmind.google", "npr.org", "pbs.org", "whitehouse.gov", "supremecourt.gov", "weather.gov", "news.google.com", "github.com"]
HTTPS_ENDS = [".blogspot.com", ".substack.com"]
#: First path segments of a code host that are no owners (fixed values).
NO_OWNERS = ["about", "account", "apps", "blog", "codespaces", "collections", "contact", "copilot", "customer-stories", "dashboard", "discussions", "education", "enterprise", "events", "explore", "features", "home", "issues", "join", "login", "logout", "marketplace", "mobile", "new", "nonprofit", "notifications", "open-source", "organizations", "orgs", "premium-support", "pricing", "pulls", "readme", "search", "security", "sessions", "settings", "signup", "site", "solutions", "sponsors", "stars", "team", "the-readme-project", "topics", "trending", "users", "watching", "why-github"]


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def normal_title(title: Column) -> Column:
    """Composed (NFC) lower case, no apostrophes, everything but letters and digits a single space.

    No built-in function composes characters, so one Arrow function does; ASCII is composed
    as it is, and no text of it is sent there.
    """
    other = F.when(~title.rlike(r"^[\x00-\x7F]*$"), title)
    plain = F.regexp_replace(F.lower(F.coalesce(composed(other), title)), "['’]", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def title_tokens(title: Column) -> Column:
    words = F.split(normal_title(title), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP))


def shingles(tokens: Column) -> Column:
    """Distinct word trigrams; fewer than three tokens give one shingle of all, none gives none."""

    def grams(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 2, F.lit(1))), lambda i: F.array_join(F.slice(t, i, 3), " "))

    # bound to a lambda variable, so that the tokens are made once and not once a shingle
    one = F.transform(F.array(tokens), lambda t: F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams(t))))
    return F.get(one, F.lit(0))


def truncate(text: Column, most: int = 300) -> Column:
    """At most ``most`` characters (code points), cut at the last space of that piece if it has one, without white space at the end."""
    piece = F.substring(text, 1, most)
    head = F.regexp_extract(piece, r"(?s)^(.+) ", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.when(head != "", head).otherwise(piece), r"\s+$", ""))


def excerpt(text: Column, most: int = 300) -> Column:
    """White space collapsed, truncated; blank is null."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat != "", truncate(flat, most))


def strip_markup(html: Column) -> Column:
    """Text of a document without scripts, styles, tags and entities."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"&[#A-Za-z0-9]+;", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def term_pattern(term: str) -> str:
    """A term's words joined by spaces or hyphens, not inside a word."""
    body = r"[\s-]+".join(term.replace("-", " ").split())
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_]){body}(?![\p{{L}}\p{{N}}_])"


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no www, https where known, no fragment, no tracking, sorted parameters, no trailing slash."""
    bare = F.substring_index(F.trim(url), "#", 1)
    scheme = F.lower(F.regexp_extract(bare, r"(?i)^(https?)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"(?i)^https?://([^/?]*)", 1)), r"^(www\.)+", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?i)^https?://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).rlike(TRACKING))
    ordered = F.transform(F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("n"), i.alias("i"), p.alias("p")))), lambda s: s["p"])
    known = host.isin(*HTTPS_HOSTS)
    for end in HTTPS_ENDS:
        known = known | host.endswith(end)
    safe = F.when(known, "https").otherwise(scheme)
    end = F.when(F.size(ordered) > 0, F.concat(F.lit("?"), F.array_join(ordered, "&"))).otherwise("")
    return F.when(scheme != "", F.concat(safe, F.lit("://"), host, F.when(path == "", "/").otherwise(path), end))


def url_error(url: Column) -> Column:
    """Why a URL has no canonical form; null if it has one."""
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "empty").when(~F.trim(url).rlike(r"(?i)^https?://[^/?#]"), "not http(s)")


def code_host_ref(url: Column) -> Column:
    """``owner/name`` in lower case of the repository that a URL of a code host names, else null.

    The host and its raw host take the first two path segments, a pages host its owner and
    at most one segment; ``.git`` is cut, reserved owners and gists name none.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    seg = F.filter(F.split(path, "/"), lambda p: p != "")
    at = lambda i: F.get(seg, F.lit(i))
    paged = host.endswith(".github.io")
    direct = host.isin("github.com", "raw.githubusercontent.com") & (F.size(seg) >= 2)
    owner = F.when(direct, at(0)).when(paged & (F.size(seg) <= 1), F.regexp_replace(host, r"\.github\.io$", ""))
    name = F.when(direct, at(1)).when(paged & (F.size(seg) == 0), host).when(paged, at(0))
    name = F.regexp_replace(name, r"\.git$", "")
    ok = owner.rlike("^[A-Za-z0-9][A-Za-z0-9-]*$") & name.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.lower(owner).isin(*NO_OWNERS)
    return F.when(ok, F.lower(F.concat_ws("/", owner, name)))


def slug_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def has_token_run(tokens: Column, run: Column) -> Column:
    """Whether the tokens of ``run`` stand next to each other in ``tokens``."""
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return (F.size(run) > 0) & F.contains(spaced(tokens), spaced(run))


def strip_preamble(text: Column) -> Column:
    """Without the announcement that a preprint feed puts before its abstracts."""
    return F.regexp_replace(text, r"(?i)^arXiv:\S+\s+Announce Type:\s*\S+\s*\n+\s*Abstract:\s*", "")


def scoring_text(title: Column, summary: Column, entities: Column) -> Column:
    """What interests are matched against: title, summary and entity names."""
    return F.concat_ws(" ", title, summary, F.array_join(entities, " "))
