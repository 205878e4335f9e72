"""Readers.  Everything is a DataFrame; filters and columns reach the scan."""

from __future__ import annotations

import re
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import KAFKA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, its zoneless times as UTC instants whatever the session's zone.

    Days and epochs are UTC throughout, so sessions should run in UTC; reading
    changes nothing about a session.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    times = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        return df.withColumns({n: F.from_utc_timestamp(F.col(n).cast("timestamp"), F.current_timezone()) for n in times})
    return df.withColumns({n: F.col(n).cast("timestamp") for n in times})


# The options' names are those of Spark's Kafka reader.
COLUMNS = [c.split()[0] for c in KAFKA.split(", ")]


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], most_offsets: int = 20_000) -> DataFrame:
    """All topics from the earliest offset; lost data stops the query."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest").option("failOnDataLoss", "true").option("maxOffsetsPerTrigger", most_offsets).load()
        .select(*COLUMNS)
    )


def kafka_batch(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """What the topics hold now."""
    return (
        spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest").option("endingOffsets", "latest").load().select(*COLUMNS)
    )


def recorded_stream(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """Recorded messages (Parquet with the Kafka columns) as a stream."""
    return spark.readStream.schema(KAFKA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def jdbc_options(url: str, query: str, parameters: dict[str, object] | None = None, split_by: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1) -> dict[str, str]:
    """Options of a JDBC read of a query with ``:name`` parameters, in ``parts`` ranges of a whole-number column if one is named.

    Parameters become literals: numbers, times and texts with their quotes
    doubled; a name that isn't given is an error.
    """

    def literal(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float, Decimal)):
            return str(v)
        if isinstance(v, datetime):
            return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
        return "'" + str(v).replace("'", "''") + "'"

    text = re.sub(r"(?<![:\w]):([a-z_]\w*)", lambda m: literal((parameters or {})[m[1]]), query)
    if split_by is None:
        return {"url": url, "query": text}
    return {"url": url, "dbtable": f"({text}) AS q", "partitionColumn": split_by, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}


def jdbc(spark: SparkSession, url: str, query: str, parameters: dict[str, object] | None = None, split_by: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A query of the operational database; see ``jdbc_options``."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, parameters, split_by, bounds, parts), **options).load()


def replay_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``key|json``; ``null`` stands for a tombstone.  Positions (file, byte-ordered line) follow the files by name and the lines in each.

    Splits of a file are read in its order within a partition; ``pos`` is the
    file, the start of the split and the line in it, so it sorts as the file does.
    """
    parts = F.split("value", r"\|", 2)
    body = F.when(parts[1] != "null", parts[1])
    lines = spark.read.text(path, wholetext=False).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return lines.select(parts[0].alias("key"), body.alias("value"), F.struct("file_path", "file_block_start", "line").alias("pos"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
