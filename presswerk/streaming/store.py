"""The store kept by a stream: each micro-batch is merged as a part of its own, named by its number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presswerk.session import scratch_path
from presswerk.sources.store import Deltas


def keep_store(rows: DataFrame, store: Deltas, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start merging a stream of article rows into the store.

    The number of a micro-batch names its part, so one that is repeated after a failure replaces itself; a stream that
    starts again with the same checkpoint and folder goes on with what the folder holds.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.merge(batch, f"batch-{number}")

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def without_repeats(rows: DataFrame, at: str = "published", key: str = "url", late: str = "5 days") -> DataFrame:
    """A stream without rows that repeat a key within the watermark; state older than it is dropped."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def replay(rows: DataFrame) -> DataFrame:
    """The store after the rows, by batch, have gone through a stream in several starts: what one merge of all gives."""
    spark = rows.sparkSession
    landed, kept, checkpoint = (scratch_path(spark, n) for n in ("landed", "store", "stream"))
    for low, high in ((0, 0), (1, 6), (7, 12), (13, 2**31 - 1)):
        rows.where(F.coalesce("batch_no", F.lit(0)).between(low, high)).write.mode("append").parquet(landed)
        # each start opens the folder anew, as a job that runs now and then does
        stream = spark.readStream.schema(rows.schema).parquet(landed)
        keep_store(stream, Deltas(spark, kept, rows.schema), checkpoint).awaitTermination()
    return Deltas(spark, kept, rows.schema).read()
