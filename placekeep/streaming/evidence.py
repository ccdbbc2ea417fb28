"""The evidence log as a stream: duplicates dropped, the latest check per place kept, results appended.

The batch operators define the results; these run them continuously.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from placekeep.operators.buckets import BucketStore
from placekeep.operators.upsert import latest_wins


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Files of a growing log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_each(log: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("verification_id",), delay: str = "1 day") -> DataFrame:
    """Each row once, if its repeats come within ``delay``; state is dropped after it."""
    return log.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def checks_by_day(log: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Checks by provider and day; late rows up to ``delay`` count."""
    return log.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("day"), "provider").agg(F.count("*").alias("checks"), F.avg("confidence").alias("confidence"))


def keep_latest(log: DataFrame, store: BucketStore, name: str, checkpoint: str, time: str = "ts") -> StreamingQuery:
    """Keeps the latest row of each place in a table of ``store``, batch by batch; files without the batch's places stay as they are.

    A batch that is run again after a failure gives the same table.
    """

    def latest(rows: DataFrame, batch: DataFrame) -> DataFrame:
        return latest_wins(rows.unionByName(batch), ["location_id"], F.col(time).desc_nulls_last(), F.col("verification_id").desc_nulls_last())

    def merge(batch: DataFrame, _: int) -> None:
        if name in store.state()["tables"]:
            store.commit(store.merge(name, batch, latest))
        else:
            store.commit(store.create(name, latest(batch, batch.where("false")), ["location_id"]))

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
