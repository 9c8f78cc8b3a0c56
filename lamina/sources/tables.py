"""Reading tables and sorted runs, writing sorted runs, and the names of a store's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_sorted_run(log: DataFrame, path: str, files: int) -> None:
    """Write a changelog as ``files`` key-disjoint Parquet files, each ordered by key and newest version first.

    Range clustering makes the files' key statistics disjoint, so a scan with a key predicate skips files and row groups.
    """
    log.repartitionByRange(files, "k").sortWithinPartitions(F.col("k"), F.col("seq").desc()).write.mode("overwrite").parquet(path)


def read_sorted_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_filename(name: Column) -> Column:
    """Struct ``(number, kind)`` of a store file's name; null if it is none. Numbers that overflow are no names."""
    number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("decimal(20,0)")
    fixed = {"CURRENT": "current", "LOCK": "lock", "LOG": "info_log", "LOG.old": "info_log"}
    zero, out = F.lit(0).cast("decimal(20,0)"), None
    for text, kind in fixed.items():
        case = F.struct(zero.alias("number"), F.lit(kind).alias("kind"))
        out = F.when(name == text, case) if out is None else out.when(name == text, case)
    numbered = {r"^MANIFEST-(\d+)$": "manifest", r"^(\d+)\.log$": "log", r"^(\d+)\.(?:sst|ldb)$": "table", r"^(\d+)\.vtb$": "value", r"^(\d+)\.dbtmp$": "temp"}
    for pattern, kind in numbered.items():
        n = number(pattern)
        fits = name.rlike(pattern) & n.isNotNull() & (n <= F.lit("18446744073709551615").cast("decimal(20,0)"))
        out = out.when(fits, F.struct(n.alias("number"), F.lit(kind).alias("kind")))
    return out
