"""Shared plumbing: table access, the shared work folder, folds, tokens."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and send them few texts at once.

    Batches of 10,000 texts, Spark's default, are large on both sides; another
    size that the session was given stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    return spark


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one is set here only where it is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file:///tmp/tidemark-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, label: str, rows: int | None = None, a_file: int = 50_000, **options: object) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: cuts lineage, survives lost executors.

    ``rows``, how many there are at most where that is known, keeps small
    tables from being written as a file a task; large ones are as many files as
    they have partitions.  ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // a_file)))
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._saved_at = path
    return read


def rows_in(written: DataFrame) -> int:
    """How many rows a frame of ``saved`` has; counted once."""
    if not hasattr(written, "_rows"):
        written._rows = written.count()
    return written._rows


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as each query ends; for tables that are written and read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def joined_by_sorting(spark: SparkSession) -> Iterator[None]:
    """Joins inside broadcast no side, however small: each broadcast costs the driver a thread with its stack for a minute; for long rows of small queries."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def rows_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs inside sends Python workers batches of at most ``most`` rows; for rows of several MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(*frames: DataFrame) -> None:
    """Delete what ``saved`` wrote for these frames; only for such that nothing later reads."""
    for df in frames:
        if path := getattr(df, "_saved_at", None):
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def trim() -> None:
    """Give back what the driver's Python has freed after fitting: glibc otherwise keeps up to 64 MB of large arrays for later ones."""
    if (give := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give(0)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids fall in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")), F.lit(0)) % parts


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, stratum: str, per_stratum: int, sizes: dict, key: str = "doc_id") -> DataFrame:
    """Some ``per_stratum`` rows of each value of ``stratum`` that ``sizes`` has the number of rows of, all where it has no more.

    A row is in if the hash of its key is under the share that is wanted of its
    stratum, so the sample is the same on any cluster, and nothing is joined,
    sorted or gathered.  With different keys a stratum gives more than
    ``per_stratum + 6 * sqrt(per_stratum)`` rows less than once in 10^8.
    """
    if not sizes:
        return df.limit(0)
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for v, n in sorted(sizes.items()) for x in (v, per_stratum / max(n, 1))]), F.col(stratum)), F.lit(0.0))
    at = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return df.where(at < share)


def few(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``most`` rows, so that few texts are held at once."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Python lists of the named columns, one tuple of lists for a few rows at a time."""
    for b in few(batches):
        yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)


_PUNCT = bytes(32 if (b < 128 and not (97 <= b <= 122)) else b for b in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes; ASCII digits, punctuation and white space separate them."""
    return text.lower().encode().translate(_PUNCT).split() if text else []
