"""Flight records as messages: Kafka options, JSON values, route keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from latewing.functions.casts import nan_to_null
from latewing.schema import MESSAGE_SCHEMA


def kafka_read_options(servers: str, topic: str, starting: str = "earliest") -> dict[str, str]:
    if starting not in ("earliest", "latest"):
        raise ValueError("starting must be earliest or latest")
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting,
            "failOnDataLoss": "false"}


def kafka_write_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.compression.type": "gzip"}


def read_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """Stream of ``(key, value, …)``; needs the spark-sql-kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_read_options(servers, topic, starting)).load()


def clean_nans(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    floating = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in floating}) if floating else df


def row_json(*cols) -> Column:
    """Row as JSON text, NULL fields written out."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def to_messages(df: DataFrame, key_cols: Sequence[str] = ("ORIGIN", "DEST")) -> DataFrame:
    """``(key, value)``: route key and the whole record as JSON."""
    key = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    return clean_nans(df).select(key.alias("key"), row_json(*df.columns).alias("value"))


def write_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """Batch write, or a started streaming query when the frame is a stream."""
    options = kafka_write_options(servers, topic)
    if messages.isStreaming:
        return messages.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    return messages.write.format("kafka").options(**options).save()


def value_text(df: DataFrame) -> DataFrame:
    """Message bytes as text."""
    return df.select(F.col("value").cast("string").alias("json"))


def parse_messages(df: DataFrame, schema: T.StructType = MESSAGE_SCHEMA) -> DataFrame:
    """Messages (batch or stream) to columns; an unreadable message gives a row of NULLs.

    The record is the one element of a generated list: conditions on its fields stay above, so a message is parsed once and not for each of them.
    """
    return value_text(df).select(F.inline(F.array(F.from_json("json", schema))))
