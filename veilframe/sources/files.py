"""Sources and sinks: CSV in/out (S1, S2), report sink (S3), audit log
source and run-log sink (S4, S5), preview (S6) and dataset profile (S7)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

# Audit-log line layout: {"timestamp", "level", "message": {event_type, user, success, details}}.
AUDIT_LINE_SCHEMA = StructType([
    StructField("timestamp", StringType()),
    StructField("level", StringType()),
    StructField("message", StructType([
        StructField("event_type", StringType()),
        StructField("user", StringType()),
        StructField("success", BooleanType()),
        StructField("details", StringType()),  # nested object kept as JSON text
    ])),
])
AUDIT_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; an explicit schema avoids the extra inference pass."""
    reader = spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_csv_split(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 with bad lines split off: ``(good rows, bad lines)`` in one file layout and no extra pass each.

    A line is bad when it has too few or too many fields or a field that isn't of its
    column's type. Bad lines come as ``(line, n_read)``: the raw text and how many of its
    fields could be read. Quoted fields follow the CSV reader; an empty file gives two
    empty frames.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    bad_column = "_bad_line"
    raw = (spark.read.option("header", header).option("nullValue", "").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", bad_column)
           .schema(StructType([*fields.fields, StructField(bad_column, StringType())])).csv(path))
    names = [f.name for f in fields.fields]
    n_read = F.size(F.array_compact(F.array(*[F.col(f"`{c}`").cast("string") for c in names])))
    # always true, but it makes every scan parse all fields: a pruned one wouldn't be found bad
    parsed = n_read >= 0
    good = raw.where(F.col(bad_column).isNull() & parsed).select(*[F.col(f"`{c}`") for c in names])
    bad = raw.where(F.col(bad_column).isNotNull() & parsed).select(F.col(bad_column).alias("line"), n_read.alias("n_read"))
    return good, bad


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, one file per partition, column order kept."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """S3: the nested report dict as one JSON document (a one-row JSON dataset)."""
    text = json.dumps(report, default=str, sort_keys=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def report_path_for(output_path: str) -> str:
    """The reference's naming: ``out.csv`` -> ``out_report.json``."""
    return output_path[:-4] + "_report.json" if output_path.endswith(".csv") else output_path + "_report.json"


def report_rows_path_for(output_path: str) -> str:
    """Where the long form of the report goes, beside the JSON document."""
    return report_path_for(output_path)[:-len(".json")] + "_rows"


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines audit log; malformed lines are skipped, a bad timestamp reads as NULL.

    Returns the flat log shape used by the audit operators:
    ``(seq, ts, level, event_type, user, success, details)``.
    """
    raw = spark.read.schema(AUDIT_LINE_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return raw.select(
        F.monotonically_increasing_id().alias("seq"),
        F.try_to_timestamp(F.col("timestamp"), F.lit(AUDIT_TS_FORMAT)).alias("ts"),
        "level", "message.event_type", "message.user", "message.success", "message.details",
    )


def stream_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """S4 for tailing: the same parsing over a streaming JSON file source."""
    raw = spark.readStream.schema(AUDIT_LINE_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return raw.select(F.try_to_timestamp(F.col("timestamp"), F.lit(AUDIT_TS_FORMAT)).alias("ts"), "level",
                      "message.event_type", "message.user", "message.success", "message.details")


def write_audit_table(log: DataFrame, path: str, mode: str = "append") -> None:
    """An audit log as a table laid out by day (``day=...`` folders).

    Rows are rebalanced by day first, which splits a hot day and joins small ones, so
    a day has as many files as its size asks for. Entries without a time share a folder.
    """
    by_day = log.withColumn("day", F.to_date("ts")).hint("rebalance", "day")
    by_day.write.mode(mode).partitionBy("day").parquet(path)


def read_audit_table(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``write_audit_table``, with its ``day`` partition column."""
    return spark.read.parquet(path)


def append_run_log(spark: SparkSession, entries: list[dict], path: str) -> None:
    """Append one small batch of run events (JSON lines, same layout as S4).

    Entries are collected on the driver during a run (a handful per run, never
    per row) and appended once.
    """
    rows = []
    for e in entries:
        msg = {"event_type": e["event_type"], "user": e.get("user") or "unknown",
               "success": bool(e.get("success", True)), "details": e.get("details", {})}
        rows.append((json.dumps({"timestamp": e["timestamp"], "level": e.get("level", "INFO"), "message": msg},
                                default=str),))
    if rows:
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(path)


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows; with ``order_by`` a deterministic top-n."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def dataset_profile(df: DataFrame, approx_distinct: bool = False, rsd: float = 0.01) -> DataFrame:
    """Row count plus, per column, non-null and distinct counts, in one pass.

    Columns are stacked as ``(column, value digest)`` so one aggregation serves
    all columns and a cell costs 16 bytes in the shuffle. The distinct count is exact (two-level aggregation), or a
    HyperLogLog estimate with ``approx_distinct=True`` - a fixed-size sketch
    per column instead of a shuffle of every distinct value.
    """
    cols = df.columns
    from ..operators.metrics import value_digest
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), value_digest(F.col(c).cast("string")).alias("v"))
        for i, c in enumerate(cols)
    ])))
    per = stacked.groupBy("ordinal", "column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_non_null"),
        (F.approx_count_distinct("v", rsd) if approx_distinct else F.count_distinct("v")).alias("n_distinct"))
    types = df.sparkSession.createDataFrame(
        [(c, f.dataType.simpleString()) for c, f in zip(cols, df.schema.fields)], "column_name string, data_type string")
    return per.join(F.broadcast(types), "column_name").select(
        "ordinal", "column_name", "data_type", "n_rows", "n_non_null", "n_distinct")
