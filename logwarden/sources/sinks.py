"""Writers.  Tables are partitioned by day, verdict windows by six hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions.times import bucket


def with_day(df: DataFrame, ts_col: str) -> DataFrame:
    return df.withColumn("event_date", F.to_date(F.col(ts_col).cast("timestamp")))


def append_events(df: DataFrame, path: str, ts_col: str) -> None:
    """Append event rows by day.  An empty batch writes no rows."""
    with_day(df, ts_col).write.mode("append").partitionBy("event_date").parquet(path)


def append_pass_rows(df: DataFrame, path: str) -> None:
    """Append window-verdict rows by six-hour bucket."""
    df.withColumn("bucket_6h", bucket("window_ts", 6 * 3600)).write.mode("append").partitionBy("bucket_6h").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_new_incidents(found: DataFrame, path: str) -> None:
    """Append incidents whose key the table does not have yet."""
    from logwarden.operators.correlate import new_incidents

    spark = found.sparkSession
    try:
        stored = spark.read.schema(found.schema).parquet(path)
    except Exception as error:  # the first run has no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = found.limit(0)
    new_incidents(found, stored).write.mode("append").parquet(path)


def replace_windows(df: DataFrame, path: str) -> None:
    """Replace the partitions of the windows in ``df``, keep all others."""
    (
        df.withColumn("window_key", F.unix_seconds("window_start")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("window_key").parquet(path)
    )


def newest_rows(df: DataFrame, time_col: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(time_col)).limit(k)
