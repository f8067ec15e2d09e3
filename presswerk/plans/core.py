"""Queries of the core: problem 1 and the operators of the news engine, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswerk.config import SelectionRules
from presswerk.functions.markup import extracted, paragraphs, without_noise
from presswerk.functions.text import clean_reason, clean_summary, entities, key_points, normal_title, sentence_count, title_words
from presswerk.functions.urls import canonical_url, is_ad_tracking, is_section_front, publisher
from presswerk.operators import briefs, records, stories
from presswerk.operators.timestamps import normalise_instants
from presswerk.plans.core_sql import SQL
from presswerk.session import spread, stage, table
from presswerk.sources import registry

NOW, DAYS = "2024-06-01 00:00:00", 30
RULES = SelectionRules(section_minimums={"market": 4, "general": 10, "personal_interest": 1})


def articles(spark: SparkSession, d: str) -> DataFrame:
    """The stored articles with ``published``: the instant of every readable ``published_at``, whatever its form."""
    rows = table(spark, d, "articles")
    read = normalise_instants(rows.select("row_id", "source", "published_at"), table(spark, d, "sources"), utc_fields=(), canonical_too=True)
    return rows.join(read.select("row_id", F.try_to_timestamp("utc").alias("published")), "row_id", "left")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_instants(table(spark, d, "articles"), table(spark, d, "sources")).select("row_id", "field", "utc")


def article_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("row_id", normal_title("title").alias("title_norm"), F.size(title_words("title")).alias("n_words"))


def article_sections(spark: SparkSession, d: str) -> DataFrame:
    return stories.section(table(spark, d, "articles")).select("row_id", "section")


def section_sources(spark: SparkSession, d: str) -> DataFrame:
    return stories.section(table(spark, d, "articles")).groupBy("section", "source").agg(F.count("*").alias("n_rows"), F.count_distinct("article_id").alias("n_articles"))


def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return records.first_wins(table(spark, d, "articles").select("row_id", "url", "article_id")).select("row_id")


def source_limit(spark: SparkSession, d: str) -> DataFrame:
    return records.source_limit(table(spark, d, "articles").select("row_id", "source"), 20)


def source_addresses(spark: SparkSession, d: str) -> DataFrame:
    rows = registry.resolved_sources(table(spark, d, "sources"))
    return rows.select("name", "source_access_tier", "rss_url", "api_url", "scrape_url", F.size("faults").alias("n_faults"))


def reader_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = registry.active_profile(table(spark, d, "reader_profiles"))
    return rows.select("profile_id", "profile_name", F.size("interests").alias("n_interests"), F.array_join("priority_sections", ",").alias("sections"))


def fair_share(spark: SparkSession, d: str) -> DataFrame:
    return records.fair_share(table(spark, d, "sources"), 60, 8)


def extraction_attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("row_id", "source")
    return records.within_budget(rows, records.fair_share(table(spark, d, "sources"), 60, 8)).select("row_id", "attempt")


def upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("row_id", "batch_no", "article_id", "url", "title")
    return records.merged(rows.where("batch_no = 0"), rows.where("batch_no > 0")).select("article_id", "url", "row_id")


def recent_rows(spark: SparkSession, d: str) -> DataFrame:
    return records.recent(articles(spark, d).select("row_id", "published"), NOW, DAYS).select("row_id")


def clean_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("row_id", "title", "summary", "content", "url")
    return records.clean_rows(rows, ["/deals/", "utm_", "?iid="], ["coupon", "sponsored", "underscored"], 2025).select("row_id")


def publisher_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select(publisher("url").alias("publisher"), "source")
    return rows.groupBy("publisher").agg(F.count("*").alias("n_rows"), F.count_distinct("source").alias("n_sources"))


def url_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").where("url IS NOT NULL")
    return rows.select("row_id", is_section_front("url").alias("front"), is_ad_tracking("url").alias("ad"))


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").where("url IS NOT NULL").select("row_id", canonical_url("url").alias("url"))


def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "articles").where("raw_html IS NOT NULL").select("row_id", "raw_html")).select("row_id", paragraphs(without_noise("raw_html")).alias("p"))
    return rows.select("row_id", F.size("p").alias("n_paragraphs"), F.coalesce(F.aggregate("p", F.lit(0), lambda t, x: t + F.length(x)), F.lit(0)).alias("n_chars"))


def page_extraction(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "articles").where("raw_html IS NOT NULL").select("row_id", "raw_html")).select("row_id", F.inline(F.array(extracted("raw_html"))))
    return rows.select("row_id", "status", "method", F.length("text").alias("n_chars"))


def content_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "articles").select("row_id", "title", "summary", "content", "extracted_text")).select("row_id", records.content_cascade("title", "summary", "content", "extracted_text").alias("c"))
    return rows.select("row_id", "c.quality", F.length("c.text").alias("n_chars"))


def article_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("source", F.explode(entities("final_content_for_ai")).alias("name"))
    counted = rows.groupBy("source", "name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), F.lower("name"), "name"))
    return counted.withColumn("place", rank).where("place <= 5")


def document_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(sentence_count("text")).alias("n_sentences"))


def document_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", key_points("text").alias("points"))


def title_pairs(spark: SparkSession, d: str) -> DataFrame:
    return stories.title_pairs(stories.section(articles(spark, d))).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    return stories.similar_titles(stories.section(articles(spark, d)))


def _sectioned(spark: SparkSession, d: str) -> DataFrame:
    return stage(records.first_wins(stories.section(articles(spark, d)).drop("raw_html", "extracted_text")), "sectioned")


def story_clusters(spark: SparkSession, d: str) -> DataFrame:
    return stories.clusters(_sectioned(spark, d)).select("row_id", "section", "cluster")


def story_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _sectioned(spark, d)
    named = stories.clusters(rows).select("row_id", "cluster", "anchor")
    return stories.candidates(rows.join(named, "row_id"))


def story_grades(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_stories")
    told = stories.tags(F.col("representative_titles"), F.col("candidate_text"))
    return rows.select(
        "cluster_id",
        stories.quality(F.size("article_ids"), F.col("source_count")).alias("quality"),
        stories.confidence(F.col("source_count")).alias("confidence"),
        F.array_join(told, ",").alias("tags"),
    )


def story_ranks(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("section").orderBy(*briefs.selection_order()))
    rows = table(spark, d, "candidate_stories").withColumn("place", place)
    return rows.select("cluster_id", "section", "place", briefs.is_core(RULES).alias("core"))


def brief_selection(spark: SparkSession, d: str) -> DataFrame:
    return briefs.selected(table(spark, d, "candidate_stories"), RULES)


def draft_stories(spark: SparkSession, d: str) -> DataFrame:
    return briefs.resolved_drafts(table(spark, d, "story_drafts").select("draft_id", "cluster_ids"), table(spark, d, "candidate_stories")).select("draft_id", "position", "cluster_id", "section")


def draft_items(spark: SparkSession, d: str) -> DataFrame:
    rows = briefs.resolved_drafts(table(spark, d, "story_drafts").select("draft_id", "cluster_ids"), table(spark, d, "candidate_stories"))
    items = briefs.joined_items(rows)
    return items.select("draft_id", "primary_publisher", "section", "cluster_quality", "source_count", "feed_count", "confidence", F.size("article_ids").alias("n_articles"), F.size("source_links").alias("n_links"))


def item_stories(spark: SparkSession, d: str) -> DataFrame:
    tales = table(spark, d, "candidate_stories").select("cluster_id", "article_ids")
    drafts = briefs.resolved_drafts(table(spark, d, "story_drafts").select("draft_id", "cluster_ids"), table(spark, d, "candidate_stories"))
    return briefs.stories_of_items(briefs.joined_items(drafts).select("draft_id", "article_ids"), tales, "draft_id")


def page_enrichment(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("row_id", "url", "content", "source_access_tier")
    pages = table(spark, d, "articles").where("raw_html IS NOT NULL AND url IS NOT NULL").select("url", F.col("raw_html").alias("page"), F.lit("ok").alias("status"))
    return records.enriched(rows, pages).select("row_id", "extraction_status", "extraction_method", F.length("extracted_text").alias("n_chars"))


def draft_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "story_drafts").select("draft_id", briefs.is_well_formed().alias("well_formed"), sentence_count("summary").alias("n_sentences"))


def draft_prose(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "story_drafts").select("draft_id", clean_summary("summary").alias("summary"), clean_reason("why_it_matters").alias("why"))


def draft_grounding(spark: SparkSession, d: str) -> DataFrame:
    drafts = table(spark, d, "story_drafts")
    return briefs.grounded(drafts, briefs.resolved_drafts(drafts.select("draft_id", "cluster_ids"), table(spark, d, "candidate_stories")))


def draft_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return briefs.accept_drafts(table(spark, d, "story_drafts"), table(spark, d, "candidate_stories"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_stories")
    head = F.coalesce(F.get("representative_titles", F.lit(0)), F.lit(""))
    return rows.select("cluster_id", "section", head.alias("headline"), F.coalesce("candidate_text", F.lit("")).alias("summary"), stories.confidence(F.col("source_count")).alias("confidence"), "source_count", "feed_count", "source_links", "cluster_quality")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return briefs.scored(_items(spark, d), table(spark, d, "reader_profiles"), F.concat_ws(" ", "headline", "summary"), F.length("summary"))


def profile_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("profile_id", "cluster_id", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


def profile_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("score", F.round("score", 6))
    return briefs.ordered_items(rows).where("place <= 20").select("profile_id", "place", "cluster_id")


def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.source_counts(table(spark, d, "articles"))


def ingest_totals(spark: SparkSession, d: str) -> DataFrame:
    return records.totals(ingest_counts(spark, d))


def ordered_scan(spark: SparkSession, d: str) -> DataFrame:
    order = Window.orderBy(F.desc_nulls_last("published"), "source", "title", "article_id", "row_id")
    top = articles(spark, d).select("row_id", "published", "source", "title", "article_id").orderBy(F.desc_nulls_last("published"), "source", "title", "article_id", "row_id").limit(100)
    return top.withColumn("place", F.row_number().over(order)).select("place", "row_id")


def brief_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_stories")
    text = F.concat_ws(" ", F.array_join("representative_titles", " "), "candidate_text", F.array_join("primary_entities", " "), F.array_join("story_tags", " "))
    return records.searched(rows, text, " Data centre ").groupBy("section").agg(F.count("*").alias("n_stories"))


def brief_payload(spark: SparkSession, d: str) -> DataFrame:
    chosen = briefs.selected(table(spark, d, "candidate_stories"), RULES)
    items = _items(spark, d).join(chosen, "cluster_id").withColumn("why_it_matters", F.lit("")).withColumnRenamed("position", "place")
    return briefs.payload(items)


def store_stream(spark: SparkSession, d: str) -> DataFrame:
    from presswerk.streaming.store import replay

    return replay(table(spark, d, "articles").select("row_id", "batch_no", "article_id", "url", "title")).select("article_id", "url", "row_id")


_NAMES = [
    p1_found, article_titles, article_sections, section_sources, first_wins, source_limit, source_addresses, reader_profile, fair_share, extraction_attempts, upsert, recent_rows, clean_rows, publisher_counts, url_flags,
    canonical_urls, page_paragraphs, page_extraction, content_quality, article_names, document_sentences, document_points, title_pairs, similar_titles, story_clusters, story_candidates,
    story_grades, story_ranks, brief_selection, draft_stories, draft_items, item_stories, page_enrichment, draft_forms, draft_prose, draft_grounding, draft_acceptance, profile_scores, profile_order, ingest_counts,
    ingest_totals, ordered_scan, brief_search, brief_payload, store_stream,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in _NAMES}

__all__ = ["QUERIES", "SQL"]
