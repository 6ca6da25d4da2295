"""File sources and sinks: access logs, labelled scores, alerts, profiles, snapshots, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators.scale import prefix_sums
from tracewarden.sources.schemas import ACCESS_LOG, DEFAULT_THRESHOLDS, LABELLED_SCORES


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a line that is not JSON is kept in ``_corrupt_record``."""
    return spark.read.schema(ACCESS_LOG).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def stream_access_log(spark: SparkSession, path: str, files_per_trigger: int = 200) -> DataFrame:
    """The same log as a stream: the checkpoint is the cursor, the file cap the page size."""
    return (
        spark.readStream.schema(ACCESS_LOG)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def read_labelled_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELLED_SCORES).option("header", True).csv(path)


def write_daily(df: DataFrame, path: str, time_column: str = "ts", mode: str = "append") -> None:
    """Sink rolled by day.  The rebalance gives a small day one file and splits a large one over several
    tasks, instead of every task writing a file for every day."""
    dated = df.withColumn("event_date", F.to_date(time_column)).hint("rebalance", F.col("event_date"))
    dated.write.mode(mode).partitionBy("event_date").parquet(path)


def with_alert_key(df: DataFrame, *columns: str) -> DataFrame:
    """Stable alert id from the identifying columns, so a replay writes the same ids."""
    return df.withColumn("alert_id", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256))


def write_alert_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """``foreachBatch`` body: a replayed batch overwrites exactly its own partition."""
    df.dropDuplicates(["alert_id"]).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def scan_history(log: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Logs in time order, projected; ``limit`` is the size cap of the scan."""
    ordered = log.select(*columns).orderBy(columns[0], *columns[1:])
    return ordered if limit is None else ordered.limit(limit)


def page_history(log: DataFrame, columns: list[str], page_rows: int, path: str) -> None:
    """The scan as a table of pages: ``columns`` in the order of the first two, ``page_rows`` rows a page.

    The first two columns name a row (time, then id), so pages are the same on every run.  Rows are numbered by
    slices, never in one task; a page is a partition of the table and may be written by two tasks.
    """
    placed = prefix_sums(log.select(*columns), [], columns[:2], {"_at": F.lit(1)})
    paged = placed.withColumn("page", F.floor((F.col("_at") - 1) / page_rows).cast("long")).drop("_at")
    paged.write.mode("overwrite").partitionBy("page").parquet(path)


def history_page(spark: SparkSession, path: str, page: int, order: list[str]) -> DataFrame:
    """One page, in order; only its own files are read."""
    return spark.read.parquet(path).where(F.col("page") == page).drop("page").orderBy(*order)


def save_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").json(path)


def load_thresholds(spark: SparkSession, path: str | None, schema: str | None = None) -> DataFrame:
    """One row of detection thresholds; defaults fill whatever the profile does not have."""
    fallback = spark.range(1)
    if path is None:
        return fallback.select(*[F.lit(v).alias(k) for k, v in DEFAULT_THRESHOLDS.items()])
    stored = spark.read.schema(schema or ", ".join(f"{k} double" for k in DEFAULT_THRESHOLDS)).json(path)
    return stored.select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in DEFAULT_THRESHOLDS.items()])


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_graph(vertices: DataFrame, edges: DataFrame, path: str, version: str = "latest") -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices/version={version}")
    edges.write.mode("overwrite").parquet(f"{path}/edges/version={version}")


def load_graph(spark: SparkSession, path: str, version: str, vertex_ddl: str, edge_ddl: str) -> tuple[DataFrame, DataFrame]:
    """Snapshot ``version``; two empty tables when it was never written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/vertices/version={version}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], vertex_ddl), spark.createDataFrame([], edge_ddl)
    return (
        spark.read.schema(vertex_ddl).parquet(f"{path}/vertices/version={version}"),
        spark.read.schema(edge_ddl).parquet(f"{path}/edges/version={version}"),
    )


def retain_days(df: DataFrame, days: int, now, time_column: str = "ts") -> DataFrame:
    """Rows of the last ``days`` days before ``now`` (a column or scalar subquery)."""
    return df.filter(F.col(time_column) >= now - F.make_dt_interval(F.lit(days)))


def drop_old_days(spark: SparkSession, path: str, days: int, today: int, column: str = "day") -> list[int]:
    """Remove the partitions ``column=n`` (days since 1970) of a stored table that are more than ``days`` before
    ``today``; gives the numbers removed.  Partitions of other names are left alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    removed = []
    for entry in store.listStatus(folder):
        name, _, value = entry.getPath().getName().partition("=")
        if name == column and value.lstrip("-").isdigit() and int(value) < today - days:
            store.delete(entry.getPath(), True)
            removed.append(int(value))
    return sorted(removed)


def packet_lines(df: DataFrame) -> DataFrame:
    """One text line per packet: ``[time] proto source:port -> target LEN=n flags``."""
    return df.select(
        F.format_string(
            "[%s] %s %s:%d -> %s LEN=%d %s", "timestamp", "protocol", "src_ip", "port", "dst_ip", "length", "flags"
        ).alias("value")
    )
