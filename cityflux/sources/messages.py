"""Stream messages: JSON body keyed by location, and the envelope around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityflux.functions.times import parse_iso
from cityflux.schemas import MESSAGE, TOPIC

_CORRUPT = "_corrupt"


def encode(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """(key, value) rows: location, and the reading as JSON with an ISO timestamp."""
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    rest = [c for c in MESSAGE.names if c != "timestamp"]
    return df.select(F.col("location").alias("key"), F.to_json(F.struct(iso, *rest)).alias("value"))


def decode(df: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Message text to columns. Bad text gives a row with NULL body and the text kept.

    ``timestamp`` is parsed (zone-less text read in the session zone); a missing one becomes the
    processing time.
    """
    schema = T.StructType([*MESSAGE.fields, T.StructField(_CORRUPT, T.StringType())])
    body = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = df.select(*(keep or []), F.col(value).alias("_text"), body.alias("_m"))
    bad = F.col(f"_m.{_CORRUPT}").isNotNull() | F.col("_m").isNull() | F.col("_m.location").isNull()
    cols = [F.col(f"_m.{c}").alias(c) for c in MESSAGE.names if c != "timestamp"]
    when = F.when(~bad, parse_iso(F.col("_m.timestamp"))).alias("timestamp")
    return rows.select(*(keep or []), when, *cols, F.when(bad, F.col("_text")).alias("bad_text"))


def good(df: DataFrame) -> DataFrame:
    return df.filter(F.col("bad_text").isNull()).drop("bad_text")


def quarantine(df: DataFrame) -> DataFrame:
    return df.filter(F.col("bad_text").isNotNull()).select("bad_text")


def kafka_source(spark: SparkSession, servers: str, topic: str = TOPIC, per_trigger: int | None = None) -> DataFrame:
    """S3 on a broker: newest offsets first time, later from the checkpoint."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", "latest").option("failOnDataLoss", "false")
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return envelope(reader.load())


def envelope(kafka: DataFrame) -> DataFrame:
    """The broker columns as text."""
    return kafka.select(
        "topic", "partition", "offset",
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("sent_at"),
    )


def kafka_sink(messages: DataFrame, servers: str, topic: str = TOPIC):
    """S5 on a broker, batch: same key, same partition, so a location stays in order."""
    out = messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    out.option("kafka.acks", "all").option("kafka.compression.type", "gzip").save()


def kafka_stream_sink(messages: DataFrame, servers: str, checkpoint: str, topic: str = TOPIC):
    """S5 on a broker, from a stream."""
    out = messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return out.option("kafka.acks", "all").option("checkpointLocation", checkpoint).start()


def file_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """S3 and S4 over a folder of text files, one message a line: file as topic partition."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.load(path)
    return lines.select(
        F.lit(TOPIC).alias("topic"),
        F.col("_metadata.file_name").alias("partition"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.get_json_object("value", "$.location").alias("key"),
        "value",
        F.col("_metadata.file_modification_time").alias("sent_at"),
    )


def write_files(messages: DataFrame, path: str, files: int | None = None) -> None:
    """S5 to a folder of text files; with ``files`` the rows are dealt evenly over that many."""
    out = messages.select("value")
    (out.repartition(files) if files else out).write.mode("append").text(path)
