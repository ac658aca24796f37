"""Evidence and lookups as streams: new claims, misses that are remembered, sheets kept current."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.sources import shared, versions

SCHEMA = "claim_id string, run_id string, paper_id bigint, field string, value string, confidence double, created_at timestamp"


def read(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def claims_per_window(claims: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Claims for each field in event-time windows; later ones than ``late`` are dropped."""
    return claims.withWatermark("created_at", late).groupBy(F.window("created_at", window), "field").agg(F.count("*").alias("claims"), F.avg("confidence").alias("confidence"))


def first_seen(claims: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """The first claim of each key; keys are forgotten ``late`` after they were last seen."""
    return claims.withWatermark("created_at", late).dropDuplicatesWithinWatermark(keys)


def merged(claims: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = versions.BUCKETS, **trigger) -> StreamingQuery:
    """Keeps a versioned table current with a stream: of each key the last claim by ``order``.

    A batch that was committed before a crash is passed over when the stream resumes, as the table
    knows the last batch of each stream.  A stream is known by the id in its checkpoint, so another
    stream, or the same one with a new checkpoint, counts its own batches.  ``trigger`` is handed on,
    all that is there at once by default.
    """
    spark = claims.sparkSession

    def change(rows: DataFrame, batch: int) -> None:
        stream = json.loads(shared.text(spark, f"{checkpoint}/metadata"))["id"]
        versions.upsert(rows, path, keys, order, batch, buckets, stream)

    return claims.writeStream.foreachBatch(change).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
