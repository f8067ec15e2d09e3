"""Problem 1: mixed timestamp formats and zones to one form, through a dictionary of distinct values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.functions.instants import CANONICAL, parse_instant
from presswerk.session import scratch_path

DICTIONARY_SCHEMA = "raw string, zone string, date_order string, epoch bigint"


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        epochs = [parse_instant(*row) for row in zip(batch["raw"], batch["zone"], batch["date_order"], strict=True)]
        yield batch.assign(epoch=pd.array(epochs, dtype="Int64"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def extend_dictionary(values: DataFrame, path: str) -> DataFrame:
    """The dictionary at ``path`` after every (raw, zone, date_order) of ``values`` has been added to it.

    A value is parsed once in the life of the dictionary: only those not yet in it reach the parser, and
    they are appended as one committed job.
    """
    spark = values.sparkSession
    fresh = values.select("raw", "zone", "date_order").distinct()
    if _exists(spark, path):
        known = spark.read.schema(DICTIONARY_SCHEMA).parquet(path)
        fresh = fresh.join(known, ["raw", "zone", "date_order"], "left_anti")
    fresh.mapInPandas(_parse_batches, DICTIONARY_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(DICTIONARY_SCHEMA).parquet(path)


def normalise_instants(
    rows: DataFrame,
    zones: DataFrame,
    dictionary_path: str | None = None,
    key: str = "row_id",
    source: str = "source",
    local_fields: tuple[str, ...] = ("published_at",),
    utc_fields: tuple[str, ...] = ("fetched_at",),
    canonical_too: bool = False,
) -> DataFrame:
    """``(key, field, raw, utc)`` for each value of the given fields that denotes an instant.

    ``zones`` has ``name, tz_name, date_order``. ``local_fields`` without a zone are in the zone of the row's
    source, ``utc_fields`` in UTC. Values that are already ``YYYY-MM-DDTHH:MM:SSZ`` are given only with
    ``canonical_too`` (they need no dictionary). Null, blank and unreadable values give no row; a source that
    ``zones`` doesn't have counts as UTC, day first. Repeated rows are kept; other columns are ignored.
    """
    fields = [*local_fields, *utc_fields]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields])
    long = rows.select(F.col(key), F.col(source).alias("_source"), F.inline(pairs)).where(F.col("raw").isNotNull())
    odd = long.where(~F.col("raw").rlike(CANONICAL))
    # a duplicate name in ``zones`` would double rows; the first spelling in order wins
    zone_of = zones.groupBy(F.col("name").alias("_source")).agg(F.min("tz_name").alias("tz"), F.min("date_order").alias("ord"))
    local = F.col("field").isin(*local_fields)
    odd = odd.join(zone_of, "_source", "left").select(
        key,
        "field",
        "raw",
        F.when(local, F.coalesce("tz", F.lit("UTC"))).otherwise(F.lit("UTC")).alias("zone"),
        F.coalesce("ord", F.lit("dmy")).alias("date_order"),
    )
    path = dictionary_path or scratch_path(rows.sparkSession, "instants")
    known = extend_dictionary(odd, path).where(F.col("epoch").isNotNull())
    utc = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")
    found = odd.join(known, ["raw", "zone", "date_order"]).select(key, "field", "raw", utc)
    if canonical_too:
        found = found.unionByName(long.where(F.col("raw").rlike(CANONICAL)).select(key, "field", "raw", F.col("raw").alias("utc")))
    return found
