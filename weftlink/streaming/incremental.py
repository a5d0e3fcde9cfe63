"""Resolving new reference records as they arrive.

Each micro-batch is resolved against the static candidate tables and its rows
are appended by batch number, so that a batch that is run again after a failure
replaces its own rows.  The query's checkpoint holds what is finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftlink.plans.resolve import resolve
from weftlink.sources.readers import ENTITY


def resolve_stream(spark: SparkSession, arriving: str, pool: DataFrame, preset: str, out: str, checkpoint: str, schema: str = ENTITY, file_format: str = "parquet", model=None) -> StreamingQuery:
    """Starts the query over files that arrive in a folder; results are under out/batch=N.  availableNow: ends when all files are done."""

    def batch(records: DataFrame, number: int) -> None:
        matches = resolve(records, pool, preset, model)
        matches.withColumn("resolved_in", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).format(file_format).load(arriving)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
