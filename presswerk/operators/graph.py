"""Groups from links, and candidate pairs from shared keys, without a hot key landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswerk.session import stage

BLOCK = 512


def pairs_sharing_keys(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b, shared)``, ``a < b``: ids of ``postings(key, id)`` with at least one key in common, and how many.

    One exchange by key serves both the count and the join. A key of more than ``block`` ids is cut into blocks: one
    side is spread over them, the other is given to each, so a task pairs at most ``block`` ids with a list.
    No pair is left out.
    """
    parted = postings.repartition(F.col("key"))
    lists = parted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    kept = parted.join(lists, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    left = kept.select("key", F.col("id").alias("a"), F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).otherwise(0).alias("blk"))
    right = kept.select("key", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    met = left.join(right, ["key", "blk"]).where(F.col("a") < F.col("b"))
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"))


def components(links: DataFrame, most_rounds: int = 30) -> DataFrame:
    """``(id, root)`` for every id of ``links(a, b)``: the least id of its connected component.

    Each round every id takes the least root seen across its links, then jumps to its root's root; the table is
    written to the shared folder each round, so a lost executor costs one round. Roots halve the distance to the
    least id, so rounds grow with the logarithm of the longest chain. Links of an id with itself, repeated links and
    an empty table are fine.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    for _ in range(most_rounds):
        seen = both.join(roots.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        hop = roots.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = (
            roots.join(hop, "root", "left")
            .join(seen, "id", "left")
            .select("id", "root", F.least("root", F.coalesce("far", "root"), F.coalesce("near", "root")).alias("next"))
        )
        moved = stage(step, "roots")
        roots = moved.select("id", F.col("next").alias("root"))
        if moved.where(F.col("next") != F.col("root")).isEmpty():
            break
    else:
        raise RuntimeError(f"links hold a chain that {most_rounds} rounds do not cover")
    return roots
