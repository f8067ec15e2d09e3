"""``python -m presswerk``: run the steps of a brief over an article table, or one named query."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from presswerk.config import SelectionRules
from presswerk.functions.text import key_points
from presswerk.operators import briefs, records, stories
from presswerk.plans import core
from presswerk.session import build_session, ship_package, stage
from presswerk.sources.store import write_artifact


def brief(articles, rules: SelectionRules, now: str | None = None, days: int = 3):
    """Articles to the items of a brief: window, clean-up, first wins, stories, choice and prose."""
    rows = stories.section(records.first_wins(articles))
    if now:
        rows = records.recent(rows, now, days)
    named = stories.clusters(rows).select("row_id", "cluster", "anchor")
    told = stories.candidates(rows.join(named, "row_id"))
    chosen = briefs.selected(told, rules)
    return told.join(chosen, "cluster_id").select(
        F.col("position").alias("place"),
        "cluster_id",
        "section",
        F.get("representative_titles", F.lit(0)).alias("headline"),
        F.array_join(key_points("candidate_text"), " ").alias("summary"),
        F.concat(F.lit("Reported by "), F.col("source_count").cast("string"), F.lit(" publisher(s).")).alias("why_it_matters"),
        stories.confidence(F.col("source_count")).alias("confidence"),
        "source_count",
        "feed_count",
        "source_links",
        "cluster_quality",
    )


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="presswerk", description=__doc__)
    steps = parser.add_subparsers(dest="step", required=True)
    one = steps.add_parser("query", help="run one named query over a folder of tables")
    one.add_argument("name", choices=sorted(core.QUERIES))
    one.add_argument("tables")
    one.add_argument("--rows", type=int, default=20)
    run = steps.add_parser("brief", help="write brief.json and brief.md from a folder with articles.parquet")
    run.add_argument("tables")
    run.add_argument("output")
    run.add_argument("--now")
    run.add_argument("--days", type=int, default=3)
    run.add_argument("--items", type=int, default=20)
    args = parser.parse_args(argv)
    spark = build_session()
    ship_package(spark)
    if args.step == "query":
        core.QUERIES[args.name](spark, args.tables).show(args.rows, truncate=100)
        return 0
    rules = SelectionRules(least_items=min(12, args.items), most_items=args.items)
    items = stage(brief(core.articles(spark, args.tables), rules, args.now, args.days), "brief")
    write_artifact({"schema_version": "v2", "items": [r.asDict(recursive=True) for r in items.orderBy("place").collect()]}, f"{args.output}/brief.json")
    with open(f"{args.output}/brief.md", "w", encoding="utf-8") as out:
        out.write(briefs.brief_markdown(items))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
