"""Structured Streaming over a folder of line files: keys that were seen before are dropped.

The state grows with the number of keys, as there is no time after which a key may return; at scale
run it with the RocksDB state store. The row that arrives first survives; the output is not ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.record import record_key, to_csv_line
from ..operators.grammar import RECORD, parse_lines


def stream_records(spark: SparkSession, folder: str, key: str = "username", case_sensitive: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """Records of all files that arrive in folder, with key and line, the first of each key."""
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    records = parse_lines(lines.where(F.is_valid_utf8("value")).select("value"))
    keyed = records.withColumn("key", record_key(key, case_sensitive)).withColumn("line", to_csv_line(*map(F.col, RECORD)))
    return keyed.select("key", "line").dropDuplicates(["key"])


def stream_dedup(spark: SparkSession, folder: str, output: str, checkpoint: str, **options) -> StreamingQuery:
    """Take what has arrived in folder since the last run, append new keys' rows to output, and end."""
    writer = stream_records(spark, folder, **options).writeStream.format("parquet").outputMode("append")
    return writer.option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
