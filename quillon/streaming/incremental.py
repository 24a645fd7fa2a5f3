"""Row-local audits over a stream of files; all-pairs and pool-mean operators stay batch-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.text import EMAIL, TOKEN, not_blank


def audited(docs: DataFrame) -> DataFrame:
    """doc_id, is_blank, has_email and has_token of each row: the same expressions for batch and stream."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (~not_blank(text)).alias("is_blank"), text.rlike(EMAIL).alias("has_email"), text.rlike(TOKEN).alias("has_token"))


def audit_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Audits every new file below source once, and appends to target; restarts go on where they were."""
    stream = spark.readStream.schema(schema).parquet(source)
    return audited(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(docs: DataFrame, event_time: str, delay: str, content: str) -> DataFrame:
    """Rows whose content was not seen within the watermark; unlike the batch form, not the first of all."""
    return docs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([content])
