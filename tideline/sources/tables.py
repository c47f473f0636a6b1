"""Event sources and table sinks: NDJSON, syslog text, topics with coordinates, day-partitioned tables, dead letters."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPICS = ("raw-logs", "security-events", "process-events", "network-events")
_S = T.StringType()

#: The permissive read schema: every alias of every field that normalisation looks at. Names that differ in case alone are one.
EVENT = T.StructType(
    [T.StructField(n, _S) for n in """event_id timestamp time ts level severity priority message msg hostname host container_name _HOSTNAME source source_type appname
    _SYSTEMD_UNIT unit user_id user username ip_address src_ip source_ip dst_ip dest_ip src_port dst_port protocol proto bytes_sent bytes_received duration_ms direction
    dns_query pid _PID ppid uid gid exit_code binary_path exe arguments cwd syscall container_id pod_name namespace is_suspicious detection_rule category
    description mitre_tactic mitre_technique attack_cat attack_type label event_type log_type request_id geo_country metadata""".split()]
)


def read_events(spark: SparkSession, path: str, stream: bool = False, schema: T.StructType = EVENT) -> DataFrame:
    """NDJSON, one event a line; a malformed line is kept whole in _corrupt."""
    return parse_events((spark.readStream if stream else spark.read).text(path), schema)


def parse_events(lines: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """Events of lines(value); a malformed line is kept whole in _corrupt, an empty one is none."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt", _S)])
    return lines.filter(F.trim("value") != "").select(F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("e.*")


def read_syslog(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Text lines as message."""
    return (spark.readStream if stream else spark.read).text(path).withColumnRenamed("value", "message")


TOPIC = "topic string, partition int, offset long, value string"


def read_topic(spark: SparkSession, where: str, topics: list[str], stream: bool = False, kafka: bool = False, rows_a_batch: int | None = None, **options: str) -> DataFrame:
    """topic, partition, offset, value: from a broker, or from a folder of JSON lines with the same four columns.

    rows_a_batch bounds a stream's micro-batch: of a broker by offsets, of a folder by reading one file at a time, which
    holds if write_topic was given the same rows_a_file.
    """
    if stream and rows_a_batch:
        options = {"maxOffsetsPerTrigger": str(rows_a_batch)} | options if kafka else {"maxFilesPerTrigger": "1"} | options
    reader = spark.readStream if stream else spark.read
    if kafka:
        found = reader.format("kafka").option("kafka.bootstrap.servers", where).option("subscribe", ",".join(topics)).options(**options).load()
        return found.select("topic", "partition", "offset", F.col("value").cast("string"))
    return reader.schema(TOPIC).options(**options).json(where).filter(F.col("topic").isin(topics))


def write_topic(df: DataFrame, where: str, topic: Column, kafka: bool = False, rows_a_file: int | None = None) -> None:
    rows = df.select(topic.alias("topic"), F.to_json(F.struct("*")).alias("value"))
    if kafka:
        rows.write.format("kafka").option("kafka.bootstrap.servers", where).save()
    else:
        # Offsets go on from the greatest that is stored, so that coordinates never repeat.
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(where)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        last = spark.read.schema(TOPIC).json(where).agg(F.max("offset")).first()[0] if there else None
        offset = F.monotonically_increasing_id() + (0 if last is None else last + 1)
        rows.select("topic", F.spark_partition_id().alias("partition"), offset.alias("offset"), "value").write.mode("append").option("maxRecordsPerFile", rows_a_file or 0).json(where)


def unwrap_envelope(df: DataFrame, default_topic: str = "raw-logs") -> DataFrame:
    """Lifts an envelope's event fields; adds event_id, timestamp, integration, source_kind and the topic to route to."""
    wanted = F.col("event.topic") if "topic" in df.schema["event"].dataType.names else F.lit(None).cast("string")
    topic = F.when(wanted.isin(*TOPICS), wanted).otherwise(F.lit(default_topic))
    lifted = [F.col(f"event.{f}") for f in df.schema["event"].dataType.names if f not in ("event_id", "timestamp", "topic")]
    return df.select("event_id", F.col("observed_at").alias("timestamp"), F.col("source.name").alias("integration"), F.col("source.kind").alias("source_kind"), *lifted, topic.alias("topic"))


#: Sort keys of the stored tables, for row-group skipping.
SORT_KEYS = {"raw_logs": ["source", "timestamp"], "security_events": ["severity", "category", "timestamp"], "process_events": ["hostname", "timestamp"], "network_events": ["src_ip", "timestamp"]}


def write_table(df: DataFrame, path: str, name: str, ts: str = "timestamp", files_a_day: int = 1, mode: str = "append") -> None:
    """A table partitioned by event_date and sorted by its key; a day is written by files_a_day tasks."""
    dated = df.withColumn("event_date", F.to_date(ts))
    keys = [k for k in SORT_KEYS.get(name, [ts]) if k in df.columns]
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c in ("event_id", ts)]), F.lit(files_a_day))
    dated.repartition("event_date", spread).sortWithinPartitions("event_date", *keys).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str, begin: datetime | None = None, end: datetime | None = None, ts: str = "timestamp") -> DataFrame:
    """A stored table in a time range; the days prune partitions."""
    df = spark.read.parquet(f"{path}/{name}")
    if begin is not None:
        df = df.filter((F.col("event_date") >= begin.date()) & (F.col(ts) >= begin))
    if end is not None:
        df = df.filter((F.col("event_date") <= end.date()) & (F.col(ts) <= end))
    return df


RETENTION_DAYS = {"raw_logs": 90, "security_events": 180, "process_events": 90, "network_events": 90, "hunter_investigations": 365, "dead_letter_events": 30}


def apply_retention(df: DataFrame, days: int, as_of: datetime, ts: str = "timestamp") -> DataFrame:
    """Rows of the last days, by whole days, so that whole partitions go."""
    first = as_of.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=days)
    kept = df.filter(F.col(ts) >= first)
    return kept.filter(F.col("event_date") >= first.date()) if "event_date" in df.columns else kept


def split_dead_letters(df: DataFrame, stage: str, topic: str, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the malformed as dead letters: error up to 500 characters, payload up to 10,000."""
    bad = df.filter(F.col("_corrupt").isNotNull())
    dead = bad.select(
        F.sha2("_corrupt", 256).alias("dl_id"), (as_of if as_of is not None else F.current_timestamp()).alias("timestamp"), F.lit(stage).alias("failed_stage"), F.lit(topic).alias("source_topic"),
        F.substring(F.lit("unparseable event"), 1, 500).alias("error_message"), F.substring("_corrupt", 1, 10_000).alias("raw_payload"), F.lit(0).alias("retry_count"),
    )
    return df.filter(F.col("_corrupt").isNull()).drop("_corrupt"), dead
