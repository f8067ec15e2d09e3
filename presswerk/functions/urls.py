"""Addresses: one spelling, host, publisher, and the ids made from them."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from presswerk.functions.text import col, collapse

# Suffixes under which three labels make a registrable domain; path and query words of fronts and ads.
SECOND_LEVEL = ("co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "com.br", "co.jp")
FRONT_SEGMENTS = ("news", "latest", "topstories", "rssindex", "world", "us", "business", "politics", "tech", "health", "lifestyle", "sports", "audio", "podcasts", "video", "videos", "gallery")
FRONT_LAST = ("index", "latest", "topstories", "rssindex")
MEDIA = ("jpg", "jpeg", "png", "webp", "gif", "mp4", "m3u8")
AD_KEYS = ("ad", "ad_headline", "ad_image_name", "ad_position", "adt", "bdst", "esourceid", "mtaid", "placement_name", "splitterid", "cchannel", "ccreative", "cmethod", "cproduct", "csource", "ctype")


def one_spelling(url: str | None) -> str | None:
    """Scheme and host in lower case, ``/`` for no path, sorted and re-encoded query, no fragment."""
    if url is None or not url.strip():
        return None
    raw = url.strip()
    try:
        parts = urlsplit(raw)
    except ValueError:
        return raw
    if not parts.scheme and not parts.netloc:
        return raw
    path = parts.path.partition(";")[0] if ";" in parts.path.rpartition("/")[2] else parts.path
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return urlunsplit((parts.scheme.lower() or "https", parts.netloc.lower(), path or "/", query, ""))


@F.pandas_udf(StringType())
def canonical_url(s: pd.Series) -> pd.Series:
    """See ``one_spelling``; query decoding and encoding have no exact built-in expression."""
    return s.map(one_spelling)


def host(c: str | Column) -> Column:
    """Host in lower case without ``www.``, null if there is none."""
    authority = F.regexp_extract(F.lower(col(c)), r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":\d*$", "")
    return F.nullif(F.regexp_replace(bare, r"^www\.", ""), F.lit(""))


def publisher(c: str | Column) -> Column:
    """Registrable domain of an address; ``unknown`` without a host."""
    labels = F.filter(F.split(host(c), r"\."), lambda x: x != "")
    last = F.array_join(F.slice(labels, -2, 2), ".")
    long = F.size(labels) >= 3
    name = F.when(F.size(labels) < 2, host(c)).when(long & last.isin(*SECOND_LEVEL), F.array_join(F.slice(F.when(long, labels).otherwise(F.array(F.lit(""), F.lit(""), F.lit(""))), -3, 3), ".")).otherwise(last)
    return F.coalesce(F.when(host(c).isNull(), None).otherwise(name), F.lit("unknown"))


def publishers(links: str | Column) -> Column:
    return F.array_distinct(F.transform(col(links), publisher))


def _path(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_section_front(c: str | Column) -> Column:
    """A front or media file and no story: no path, only section words, or an index."""
    segments = F.filter(F.split(F.lower(_path(col(c))), "/"), lambda x: x != "")
    n = F.size(segments)
    last = F.element_at(F.concat(F.array(F.lit("")), segments), -1)
    known = F.forall(segments, lambda x: x.isin(*FRONT_SEGMENTS))
    ext = F.when(F.contains(last, F.lit(".")), F.element_at(F.split(last, r"\."), -1)).otherwise("")
    return (n == 0) | ext.isin(*MEDIA) | ((n <= 2) & known) | ((n <= 2) & last.isin(*FRONT_LAST))


def is_ad_tracking(c: str | Column) -> Column:
    """Whether the query follows an advertisement or a campaign."""
    query = F.regexp_extract(col(c), r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")

    def tracks(pair: Column) -> Column:
        key = F.lower(F.substring_index(pair, "=", 1))
        value = F.when(F.contains(pair, F.lit("=")), F.regexp_replace(pair, "^[^=]*=", "")).otherwise("")
        return key.startswith("utm_") | key.startswith("ad_") | key.isin(*AD_KEYS, "iid") | ((F.length(value) > 40) & F.contains(F.lower(value), F.lit("revshare")))

    return F.exists(pairs, tracks)


def article_id(url: str | Column, source: str | Column, title: str | Column, published: str | Column, content: str | Column) -> Column:
    """Digest of the canonical address, or of source, title, time and the beginning of the content."""
    rest = F.concat_ws("|", *[F.coalesce(col(c), F.lit("")) for c in (source, title, published)], F.substring(F.coalesce(col(content), F.lit("")), 1, 256))
    return F.sha2(F.coalesce(F.nullif(col(url), F.lit("")), rest), 256)


def cluster_id(ids: str | Column, section: str | Column, anchor: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(col(ids)), "|"), col(section), col(anchor)), 256)


def source_links(links: str | Column) -> Column:
    """Links as Markdown: web addresses by number, others as code."""
    one = F.transform(col(links), lambda x, i: F.when(x.rlike("^https?://"), F.concat(F.lit("[source "), (i + 1).cast("string"), F.lit("]("), x, F.lit(")"))).otherwise(F.concat(F.lit("`"), x, F.lit("`"))))
    return F.array_join(one, ", ")
