"""Landed feed files and interface answers as article rows; live fetching is a pluggable function per address."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.operators.records import API_FIELDS, RSS_FIELDS, conformed, normalised
from presswerk.session import stage

ENTRY = "title string, link string, guid string, id string, pubDate string, published string, updated string, summary string, description string, content string, encoded string"
ITEM = "title string, headline string, url string, link string, id string, published_at string, published string, updated_at string, summary string, description string, content string, body string"


def read_rss(spark: SparkSession, path: str, atom: bool = False) -> DataFrame:
    """The items of RSS files, or the entries of Atom files, each in one row; missing elements are null."""
    return spark.read.schema(ENTRY).option("rowTag", "entry" if atom else "item").option("ignoreNamespace", "true").option("mode", "PERMISSIVE").xml(path)


def read_api(spark: SparkSession, path: str) -> DataFrame:
    """The items of JSON answers: a list at the root, or the first list under articles, items, results or data, or
    the answer itself as one item."""
    item = f"struct<{ITEM.replace(' string', ':string').replace(', ', ',')}>"
    raw = spark.read.option("wholetext", "true").text(path)
    keys = ("articles", "items", "results", "data")
    root = F.from_json("value", f"array<{item}>")
    inner = F.from_json("value", "struct<" + ",".join(f"{k}:array<{item}>" for k in keys) + ">")
    single = F.array(F.from_json("value", item))
    is_list = F.trim("value").startswith("[")
    found = F.when(is_list, root).otherwise(F.coalesce(*[inner[k] for k in keys], single))
    return raw.select(F.inline(F.coalesce(found, F.array().cast(f"array<{item}>"))))


def feed_articles(entries: DataFrame, source: str, category: str, fetched_at: str) -> DataFrame:
    return normalised(entries, source, category, "rss", fetched_at, RSS_FIELDS)


def api_articles(items: DataFrame, source: str, category: str, fetched_at: str) -> DataFrame:
    return normalised(items, source, category, "api", fetched_at, API_FIELDS)


def scan_sources(spark: SparkSession, sources: list[dict], read: dict[str, Callable[[dict], DataFrame]], fetched_at: str, limit: int = 25) -> tuple[DataFrame, list[dict]]:
    """All enabled sources as one table of article rows, and what became of each source.

    ``read`` gives a reader for each access type. A source that fails is reported and the others go on; disabled and
    scraped ones are skipped. Each source gives at most its first ``limit`` items, which are read once and kept.
    """
    out, status = None, []
    for s in sources:
        kind = s.get("access_type", "rss")
        if not s.get("enabled", True) or kind == "scrape" or kind not in read:
            status.append({"source": s["name"], "status": "skipped", "message": None})
            continue
        try:
            entries = read[kind](s).limit(limit)
            make = api_articles if kind == "api" else feed_articles
            rows = make(entries, s["name"], s.get("category", ""), fetched_at).withColumn("source_access_tier", F.lit(s.get("source_access_tier")))
            rows = stage(rows, "scan")  # what can't be read fails here and not in the union
            out = rows if out is None else out.unionByName(rows)
            status.append({"source": s["name"], "status": "ok", "message": None})
        except Exception as error:  # noqa: BLE001  one source must not stop a run
            status.append({"source": s["name"], "status": "failed", "message": str(error)[:500]})
    return (conformed(out) if out is not None else conformed(spark.createDataFrame([], "article_id string"))), status


def with_retries(fetch: Callable[[str], object], retries: int = 1) -> Callable[[str], object]:
    """``fetch`` tried up to ``retries + 1`` times; the last error stands."""

    def tried(address: str):
        for left in range(retries, -1, -1):
            try:
                return fetch(address)
            except Exception:  # noqa: BLE001
                if not left:
                    raise
        return None

    return tried


def fetch_pages(rows: DataFrame, fetch: Callable[[str], tuple[str | None, str]], url: str = "url") -> DataFrame:
    """``(url, page, status)`` of each distinct address, by a function that is called in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for u in b[url]:
                try:
                    got.append(fetch(u))
                except Exception:  # noqa: BLE001  one page must not stop a task
                    got.append((None, "failed"))
            yield pd.DataFrame({"url": b[url], "page": [g[0] for g in got], "status": [g[1] for g in got]})

    return rows.select(F.col(url)).where(F.col(url).isNotNull()).distinct().mapInPandas(run, "url string, page string, status string")
