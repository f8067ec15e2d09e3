"""Article rows: shape, normalisation, limits, deduplication, merge and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswerk.functions.markup import extracted
from presswerk.functions.text import clip, collapse, contains_any, normal_text, strip
from presswerk.functions.urls import article_id, canonical_url, is_ad_tracking, is_section_front

_DEFAULTS = {"extraction_status": "skipped", "extraction_method": "none", "text_length": 0, "eligible_for_brief": True, "editorial_tier": "domain_desk", "front_page_eligible": False}
_STRINGS = "article_id source category discovery_method discovery_quality title url published_at summary content raw_html extracted_text extraction_status extraction_method".split()
ARTICLE = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in _STRINGS),
        T.StructField("text_length", T.IntegerType()),
        *(T.StructField(n, T.StringType()) for n in ("final_content_for_ai", "source_access_tier", "content_for_ai", "content_quality")),
        T.StructField("eligible_for_brief", T.BooleanType()),
        *(T.StructField(n, T.StringType()) for n in ("exclusion_reason", "editorial_tier")),
        T.StructField("front_page_eligible", T.BooleanType()),
        T.StructField("fetched_at", T.StringType()),
    ]
)


def conformed(rows: DataFrame) -> DataFrame:
    """The rows in the article shape: missing columns added, defaults where a value is null, other columns dropped."""
    have = set(rows.columns)
    out = []
    for f in ARTICLE.fields:
        value = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(value, F.lit(_DEFAULTS[f.name])) if f.name in _DEFAULTS else value).alias(f.name))
    return rows.select(*out)


def first_of(*names: str, of: Sequence[str]) -> Column:
    """The first of the named columns that exists and isn't blank."""
    have = set(of)
    found = [strip(F.col(f"`{n}`").cast("string")) for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def discovery_quality(title: Column, url: Column, published: Column, text: Column) -> Column:
    full = title.isNotNull() & url.isNotNull()
    return F.when(full & published.isNotNull() & text.isNotNull(), "full_metadata").when(full, "partial_metadata").otherwise("weak_metadata")


def content_cascade(title: str, summary: str, content: str, extracted: str, least_extracted: int = 400, least_content: int = 280, least_summary: int = 140, most: int = 12000) -> Column:
    """``struct(text, quality)``: extracted text, else content, else summary, else title; length grades the quality."""
    e, c, s, t = (normal_text(x) for x in (extracted, content, summary, title))
    text = F.coalesce(clip(F.coalesce(e, c, s), most), t)
    quality = (
        F.when(F.length(e) >= least_extracted, "full_text")
        .when(e.isNotNull(), "partial_text")
        .when(F.length(c) >= least_content, "full_text")
        .when(c.isNotNull(), "partial_text")
        .when(F.length(s) >= least_summary, "summary_only")
        .when(s.isNotNull(), "partial_text")
        .when(t.isNotNull(), "headline_only")
        .otherwise("empty")
    )
    return F.struct(text.alias("text"), quality.alias("quality"))


def normalised(entries: DataFrame, source: str, category: str, method: str, fetched_at: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """Entries of a feed or an interface as article rows; ``fields`` names the columns tried for each value."""
    have = entries.columns
    pick = {k: first_of(*v, of=have) for k, v in fields.items()}
    rows = entries.select(
        F.lit(source).alias("source"),
        F.lit(category).alias("category"),
        F.lit(method).alias("discovery_method"),
        F.coalesce(pick["title"], F.lit("(untitled)")).alias("title"),
        canonical_url(pick["url"]).alias("url"),
        pick["published_at"].alias("published_at"),
        pick["summary"].alias("summary"),
        pick["content"].alias("content"),
        F.lit(fetched_at).alias("fetched_at"),
    )
    body = F.coalesce("summary", "content")
    rows = rows.withColumn("discovery_quality", discovery_quality(F.col("title"), F.col("url"), F.col("published_at"), body))
    rows = rows.withColumn("article_id", article_id("url", "source", "title", "published_at", "content"))
    rows = rows.withColumn("_none", F.lit(None).cast("string"))
    rows = rows.withColumn("_c", content_cascade("title", "summary", "content", "_none"))
    rows = rows.withColumn("final_content_for_ai", F.col("_c.text")).withColumn("content_quality", F.col("_c.quality"))
    return conformed(rows.withColumn("content_for_ai", F.col("final_content_for_ai")).withColumn("text_length", F.length("final_content_for_ai")))


RSS_FIELDS = {"title": ("title",), "url": ("link", "id", "guid"), "published_at": ("pubDate", "published", "updated"), "summary": ("summary", "description"), "content": ("content", "encoded")}
API_FIELDS = {"title": ("title", "headline"), "url": ("url", "link", "id"), "published_at": ("published_at", "published", "updated_at"), "summary": ("summary", "description"), "content": ("content", "body")}


def enriched(rows: DataFrame, pages: DataFrame, least_chars: int = 400) -> DataFrame:
    """Rows with the text of their pages: ``extracted_text``, ``extraction_status`` and ``extraction_method``.

    ``pages`` has ``url, page, status`` (one row an address). Interface rows take their own content as text, feed-only
    rows are skipped, walled ones blocked; the rest are read from their page, or failed where there is none. Rows with
    ``attempt`` false (no budget left) are skipped.
    """
    held = pages.groupBy("url").agg(F.min_by("page", "status").alias("_page"), F.min("status").alias("_status"))
    rows = rows.drop("extracted_text", "extraction_status", "extraction_method").join(held, "url", "left")
    tier, own = F.coalesce("source_access_tier", F.lit("")), normal_text("content")
    readable = ~tier.isin("rss_only", "api_fulltext", "blocked_or_paywalled")
    rows = rows.withColumn("_got", F.when(readable, extracted("_page", least_chars)))
    got = F.col("_got")
    skip = (tier == "rss_only") | (~F.coalesce(F.col("attempt"), F.lit(True)) if "attempt" in rows.columns else F.lit(False))
    api = tier == "api_fulltext"
    of_own = F.when(own.isNull(), "failed").when(F.length(own) >= least_chars, "ok").otherwise("partial")
    status = (
        F.when(tier == "blocked_or_paywalled", "blocked")
        .when(api, of_own)
        .when(skip, "skipped")
        .when(F.col("_status") == "blocked", "blocked")
        .when(F.col("_page").isNull(), "failed")
        .otherwise(got["status"])
    )
    fetched = status.isin("ok", "partial") & ~api
    return rows.withColumns(
        {
            "extracted_text": F.when(api, own).when(fetched, got["text"]),
            "extraction_status": status,
            "extraction_method": F.when(api & own.isNotNull(), "api_payload").when(fetched, got["method"]).otherwise("none"),
        }
    ).drop("_page", "_status", "_got")


def source_limit(rows: DataFrame, most: int, position: str = "row_id", source: str = "source") -> DataFrame:
    """The first ``most`` rows of each source by position. A hot source is cut in its tasks before the shuffle ends:
    Spark turns the filter on the rank into a partial per-group limit."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(position))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def fair_share(sources: DataFrame, run_cap: int, source_cap: int) -> DataFrame:
    """``(name, budget)``: the run's attempts dealt evenly to the sources that can be fetched, in order of name.

    The register of sources is small (one row per source), so one window over it is fine.
    """
    can = sources.where(F.coalesce("enabled", F.lit(True)) & (F.col("access_type") != "scrape") & (F.col("source_access_tier") == "rss_plus_extract"))
    place = F.row_number().over(Window.orderBy("name"))
    n = F.count("*").over(Window.partitionBy())
    dealt = F.floor(F.lit(run_cap) / n) + F.when(place <= F.lit(run_cap) % n, 1).otherwise(0)
    return can.select("name", F.least(dealt, F.lit(source_cap)).cast("int").alias("budget"))


def within_budget(rows: DataFrame, budgets: DataFrame, position: str = "row_id") -> DataFrame:
    """Each row with ``attempt``: whether its place within its source lies within the source's budget.

    ``position`` is unique. Only as many rows of a source as the largest budget are ranked (a limit that each task
    applies first), so no source is sorted whole; the few marked rows are joined back.
    """
    dealt = budgets.select(F.col("name").alias("source"), F.col("budget").alias("_budget"))
    most = int(budgets.agg(F.max("budget")).first()[0] or 0)
    place = F.row_number().over(Window.partitionBy("source").orderBy(position))
    first = rows.select("source", position).withColumn("_place", place).where(F.col("_place") <= most)
    marked = first.join(dealt, "source").where(F.col("_place") <= F.col("_budget")).select(position, F.lit(True).alias("attempt"))
    return rows.join(marked, position, "left").withColumn("attempt", F.coalesce("attempt", F.lit(False)))


def first_wins(rows: DataFrame, position: str = "row_id") -> DataFrame:
    """The first row of each address; of rows without one, the first of each article id; rows with neither all stay."""
    url, ident = strip("url"), strip("article_id")
    kind = F.when(url.isNotNull(), F.concat(F.lit("u"), url)).when(ident.isNotNull(), F.concat(F.lit("a"), ident)).otherwise(F.concat(F.lit("r"), F.col(position).cast("string")))
    keyed = rows.withColumn("_key", kind)
    # an aggregate before the join keeps hot keys to one small row per task
    first = keyed.groupBy("_key").agg(F.min(position).alias("_first"))
    return keyed.join(first, "_key").where(F.col(position) == F.col("_first")).drop("_key", "_first")


def merged(existing: DataFrame, incoming: DataFrame, order: str = "row_id") -> DataFrame:
    """The store after an upsert. A row with an address replaces the row of that address but keeps its article id;
    one without replaces the row of its article id. The last of several rows wins."""
    columns = existing.columns
    every = existing.withColumn("_new", F.lit(0)).unionByName(incoming.select(*columns).withColumn("_new", F.lit(1)))
    return latest(every, ["_new", order]).select(*columns)


def latest(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Of all rows of an address (of an article id, where there is none) the last by ``order``, with the first one's
    article id. Merging parts and then the results gives what one merge of all gives."""
    columns = rows.columns
    key = F.when(strip("url").isNotNull(), F.concat(F.lit("u"), F.col("url"))).otherwise(F.concat(F.lit("a"), F.col("article_id")))
    at = F.struct(*order)
    won = rows.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*columns), at).alias("_row"), F.min_by("article_id", at).alias("_id"))
    out = won.select("_row.*", "_id", "_key")
    return out.withColumn("article_id", F.when(F.col("_key").startswith("u"), F.col("_id")).otherwise(F.col("article_id"))).select(*columns)


def in_order(rows: DataFrame, published: str = "published_at") -> DataFrame:
    """Newest first, then by source, title and id; rows without a time come last."""
    return rows.orderBy(F.desc_nulls_last(published), "source", "title", "article_id")


def recent(rows: DataFrame, now: str, days: int, skew_hours: int = 12, published: str = "published", fetched: str | None = None) -> DataFrame:
    """Rows whose time lies within ``days`` before ``now`` and at most ``skew_hours`` after it."""
    moment = F.coalesce(published, fetched) if fetched else F.col(published)
    end = F.to_timestamp(F.lit(now))
    return rows.where((moment >= end - F.make_dt_interval(F.lit(days))) & (moment <= end + F.make_dt_interval(F.lit(0), F.lit(skew_hours))))


def clean_rows(rows: DataFrame, urls: Sequence[str], texts: Sequence[str], year: int, most_age: int = 1) -> DataFrame:
    """Without untitled rows, old years in titles, fronts, campaign links and rows with unwanted words."""
    title = collapse("title")
    years = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\b(19\d{2}|20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    stale = F.coalesce(F.array_max(years) < year - most_age, F.lit(False))
    hay = F.concat_ws(" ", "title", "summary", "content")
    bad_url = F.coalesce(is_section_front("url") | is_ad_tracking("url") | contains_any("url", urls), F.lit(False))
    return rows.where(title.isNotNull() & ~F.lower(title).isin("(untitled)", "untitled") & ~stale & ~bad_url & ~contains_any(hay, texts))


def source_counts(rows: DataFrame) -> DataFrame:
    """Per source: rows by extraction status, and how many reach the brief and the front page."""
    by = [F.count_if(F.col("extraction_status") == s).alias(f"n_{s}") for s in ("ok", "partial", "blocked", "failed", "skipped")]
    return rows.groupBy("source").agg(
        F.count("*").alias("n_rows"),
        *by,
        F.count_if(F.coalesce("eligible_for_brief", F.lit(True))).alias("n_eligible"),
        F.count_if(F.coalesce("front_page_eligible", F.lit(False))).alias("n_front"),
    )


def totals(counts: DataFrame) -> DataFrame:
    names = [c for c in counts.columns if c != "source"]
    return counts.agg(F.count("*").alias("n_sources"), *[F.sum(c).alias(c) for c in names])


def merged_text(c_title: str = "title") -> Column:
    """Title, summary, final and own content of a row as one text."""
    return collapse(F.concat_ws(" ", c_title, "summary", F.coalesce("final_content_for_ai", "content_for_ai"), "content"), empty=True)


def searched(rows: DataFrame, text: Column, query: str | None = None, section: str | None = None) -> DataFrame:
    """Rows whose text has the query (trimmed, case ignored; blank is all) in one section or ``all``."""
    wanted = (query or "").strip().lower()
    out = rows.where(F.contains(F.lower(text), F.lit(wanted))) if wanted else rows
    return out.where(F.col("section") == section) if section and section != "all" else out


