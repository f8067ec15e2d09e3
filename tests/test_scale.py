"""What must hold at size: pruned scans, no quadratic plans, hot keys whole."""

from __future__ import annotations

import random
import re
from itertools import combinations
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from presswerk.operators import graph, records, stories
from presswerk.plans import core
from presswerk.session import scratch_root, spread, stage

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["first_wins", "source_limit", "upsert", "recent_rows", "clean_rows", "publisher_counts", "ingest_counts", "url_flags", "ordered_scan"])
def test_scans_read_only_what_they_need(spark, name):
    schemas = re.findall(r"ReadSchema: struct<([^>\n]*)", plan_of(core.QUERIES[name](spark, str(DATA))))
    assert schemas and not any("raw_html" in s or "extracted_text" in s for s in schemas)


@needs_data
@pytest.mark.parametrize("name", ["article_sections", "first_wins", "upsert", "profile_scores", "draft_items", "item_stories", "draft_grounding"])
def test_plans_have_no_cross_join(spark, name):
    plan = plan_of(core.QUERIES[name](spark, str(DATA)))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@needs_data
def test_upsert_filters_reach_the_scan(spark):
    rows = spark.read.parquet(f"{DATA}/articles.parquet").where("batch_no = 0").select("row_id")
    assert "PushedFilters: [IsNotNull(batch_no), EqualTo(batch_no,0)]" in plan_of(rows)


def test_scratch_folder_is_the_sessions(spark, tmp_path):
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: f"file://{tmp_path}/shared/"))
    assert scratch_root(named) == f"file://{tmp_path}/shared"
    assert scratch_root(spark) == scratch_root(spark)  # unset: one folder for the application
    staged = stage(spark.range(5), "t")
    assert staged.count() == 5 and all(scratch_root(spark).removeprefix("file://") in f for f in staged.inputFiles())


def test_spread_leaves_tables_of_many_parts_alone(spark):
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 10, 1, 40)
    assert spread(many) is many


def test_hot_keys_stay_whole(spark):
    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("url"), F.lit("x").alias("article_id"))
    kept = records.first_wins(rows)
    assert kept.count() == 2001 and kept.where("url = 'hot'").first()["row_id"] == 0
    posts = spark.range(600).select((F.col("id") % 3 == 0).cast("bigint").alias("key"), "id")
    pairs = graph.pairs_sharing_keys(posts, block=16)
    assert pairs.count() == 200 * 199 // 2 + 400 * 399 // 2
    star = spark.range(1, 2000).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    assert graph.components(star).where("root != 0").count() == 0


def test_title_pairs_match_brute_force(spark):
    rng = random.Random(11)
    words = ["the", "the", "rates", "rise", "fall", "bank", "vote", "storm", "deal", "north", "south", "port", "court"]
    rows = [(i, rng.choice("ab"), " ".join(rng.sample(words, rng.randint(1, 6))), 1_700_000_000 + rng.randint(0, 20) * 43_200) for i in range(160)]
    df = spark.createDataFrame(rows, "row_id bigint, section string, title string, t bigint").withColumn("published", F.timestamp_seconds("t"))
    sets = {i: set(t.split()) for i, _, t, _ in rows}
    at = {i: (s, t) for i, s, _, t in rows}
    for least, shared in ((0.34, 2), (0.5, 1), (0.2, 1)):
        want = set()
        for a, b in combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if at[a][0] == at[b][0] and abs(at[a][1] - at[b][1]) <= 72 * 3600 and both >= shared and both / len(sets[a] | sets[b]) >= least:
                want.add((a, b))
        got = {(r.a, r.b) for r in stories.title_pairs(df, least_jaccard=least, least_shared=shared).collect()}
        assert got == want and want
    assert stories.title_pairs(df.limit(0)).count() == 0
