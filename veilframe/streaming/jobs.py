"""Structured Streaming forms of the operators that make sense on a stream.

* Narrow column transforms (mask, hash, HMAC, generalise, substitute, noise)
  run on a streaming DataFrame unchanged: ``anonymize_stream``.
* Audit roll-ups and rate-limit breaches are event-time windowed counts with
  a watermark that drops the state of closed windows: ``rollup_stream``,
  ``rate_breach_stream``. A run writes every update of a window and keeps the
  latest of each, open windows included (``run_windows``).
* The lockout rule is per-user state with timers: ``streaming.lockout``.

k-anonymity, l-diversity and the column shuffle need the complete dataset and
are refused on a raw stream; ``streaming.growing`` keeps k and l over an
accumulated table.

Sinks and checkpoints live under the session's shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local temp dir.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..plans.pipeline import column_expr
from ..plans.profile import Profile, ProfileError, normalize
from ..session import ensure_checkpoint_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the rows of ``{sf_dir}/{name}.parquet`` (new files are picked up as they land)."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(sf_dir)


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "streams", *parts, uuid.uuid4().hex)


def anonymize_stream(stream: DataFrame, profile: Profile | dict, seed: int) -> DataFrame:
    """Apply a profile's narrow column transforms to a streaming DataFrame."""
    prof = profile if isinstance(profile, Profile) else normalize(profile)
    if prof.k_enabled or prof.dp_columns:
        raise ProfileError("k-anonymity, l-diversity and dataset DP need the whole table; "
                           "use foreachBatch over an accumulated table")
    exprs = {}
    for i, spec in enumerate(prof.columns):
        if spec.column not in stream.columns:
            continue
        if spec.transform == "shuffle":
            raise ProfileError("shuffle permutes a whole column and cannot run on an unbounded stream")
        exprs[spec.column] = column_expr(spec, stream, prof, seed, i)
    return stream.withColumns(exprs) if exprs else stream


def _epoch_ntz():
    # built on call: executors import this module without a Spark context
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _is_ntz(stream: DataFrame, ts: str) -> bool:
    return stream.schema[ts].dataType.simpleString() == "timestamp_ntz"


def to_micros(c: Column, ntz: bool) -> Column:
    """Microseconds on the time axis: of the instant, or of the wall clock read as UTC."""
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), c) if ntz else F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column, ntz: bool) -> Column:
    """The inverse of ``to_micros``."""
    return F.timestamp_add("MICROSECOND", c, _epoch_ntz()) if ntz else F.timestamp_micros(c)


def event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp. Wall-clock (ntz) input becomes the
    instant with the same UTC reading, so windows follow the wall clock in
    every session time zone."""
    if _is_ntz(stream, ts):
        return stream.withColumn(ts, F.timestamp_micros(to_micros(F.col(ts), True)))
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def _bounds(stream: DataFrame, ts: str):
    """Window start/end in the input's timestamp type (the inverse of ``event_time``)."""
    ntz = _is_ntz(stream, ts)
    return tuple(from_micros(F.unix_micros(F.col(f"w.{side}")), ntz).alias(f"window_{side}") for side in ("start", "end"))


def rollup_stream(log: DataFrame, window: str = "1 hour", watermark: str = "1 hour",
                  by: tuple[str, ...] = ("event_type", "success"), ts: str = "ts") -> DataFrame:
    """G4 on a stream: event counts per tumbling window, final once the watermark passes."""
    s = event_time(log, ts).withWatermark(ts, watermark)
    agg = s.groupBy(F.window(F.col(ts), window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n_events"))
    return agg.select(*_bounds(log, ts), *by, "n_events")


def rate_breach_stream(log: DataFrame, key: str, window: str, limit: int, watermark: str | None = None,
                       ts: str = "ts") -> DataFrame:
    """G7 on a stream: windows in which one key exceeded ``limit`` events."""
    s = event_time(log, ts).withWatermark(ts, watermark or window)
    agg = s.groupBy(F.window(F.col(ts), window).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n_events"))
    return agg.where(F.col("n_events") > F.lit(limit)).select(
        F.col(key), *_bounds(log, ts), "n_events", F.lit(limit).alias("limit"))


def run_windows(stream: DataFrame, name: str, count: str = "n_events") -> DataFrame:
    """Run a windowed count over everything available now: every window once, with its latest count.

    Each micro-batch appends the windows it changed (update mode) with its batch
    id; a repeated batch replaces its own folder. ``final`` tells whether the
    window ended before the last window seen began, so no more is expected of it.
    """
    spark = stream.sparkSession
    base = shared_path(spark, name)
    data = os.path.join(base, "data")

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(data, f"batch={batch_id}"))

    q = (stream.writeStream.outputMode("update").foreachBatch(append)
         .option("checkpointLocation", os.path.join(base, "_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    keys = [c for c in stream.columns if c != count]
    if q.lastProgress is None:
        return spark.createDataFrame([], StructType([*stream.schema.fields, StructField("final", BooleanType())]))
    updates = spark.read.schema(schema).parquet(data)
    latest = updates.groupBy(*keys).agg(F.max_by(count, "batch").alias(count))
    newest = latest.agg(F.max("window_start").alias("newest"))  # one row
    return latest.crossJoin(F.broadcast(newest)).withColumn("final", F.col("window_end") <= F.col("newest")).select(
        *stream.columns, "final")


def run_available(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available now; return its sink as a table.

    The sink is Parquet in the shared checkpoint folder (exactly-once with the
    query checkpoint next to it).
    """
    spark = stream.sparkSession
    base = shared_path(spark, name)
    q = (stream.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .trigger(availableNow=True).start(os.path.join(base, "data")))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(os.path.join(base, "data"))
