"""The lockout rule (G6) on a stream: per-user state with event-time timers.

A user's state is a failure count, or a lock with its end and the attempts it
rejected so far; it lives in the RocksDB state store (``transformWithStateInPandas``)
and exists only while there is something to remember. A *count* waits without
limit, as the rule says, so it never expires. A *lock* past its end is the same
as no state at all: a timer at the end of the lock drops it once the watermark
has passed, and no earlier attempt can arrive any more.

Every micro-batch that opens, adds to or ends a lock gives its latest row
(update mode), so open locks and their rejected attempts are known at any time;
``run_locks`` keeps the latest row of each lock. Attempts are replayed in
event-time order within a micro-batch and in arrival order across micro-batches;
those older than the watermark when they arrive are left out by Spark. As in the
batch replay, attempts without a user or a time are left out and an attempt
whose outcome is NULL counts as failed.
"""

from __future__ import annotations

import contextlib
import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lockout import LOCKOUT_MINUTES, MAX_FAILED_ATTEMPTS
from .jobs import event_time, from_micros, shared_path, to_micros

LOCK_US = LOCKOUT_MINUTES * 60 * 1_000_000
WATERMARK = "15 minutes"
SPILL_ROWS = 200_000  # attempts of one user sorted in memory; more go to a temporary file in sorted runs
READ_ROWS = 1_000     # attempts read back from a run at a time, lock rows handed on at a time
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STATE = "count int, locked_at bigint, locked_until bigint, rejected bigint"
_OUT = "user string, locked_at_us bigint, locked_until_us bigint, rejected_while_locked bigint, closed boolean"
_OUT_COLUMNS = ["user", "locked_at_us", "locked_until_us", "rejected_while_locked", "closed"]
_ATTEMPT = np.dtype([("us", "<i8"), ("seq", "<i8"), ("ok", "?")])


def attempts_in_order(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, bool]]:
    """One user's attempts (microseconds, seq, outcome) by time and seq, sorted in runs that are spilled and merged."""
    run, n, ends = [], 0, [0]
    with contextlib.ExitStack() as stack:
        spill = None
        for pdf in pdfs:
            part = np.empty(len(pdf), _ATTEMPT)
            part["us"] = pdf["us"].astype("int64")
            seq = pdf["seq"]
            part["seq"] = seq.where(seq.notna(), 0).astype("int64")
            part["seq"][seq.isna().to_numpy()] = np.iinfo("int64").max
            part["ok"] = pdf["ok"].astype(bool)
            run.append(part)
            n += len(part)
            if n >= SPILL_ROWS:
                spill = spill or stack.enter_context(tempfile.TemporaryFile())
                spill.write(_sorted_run(run).tobytes())
                ends.append(ends[-1] + n)
                run, n = [], 0
        runs = [_read_run(spill, a, b) for a, b in zip(ends, ends[1:])]
        if run:
            runs.append(iter(_sorted_run(run).tolist()))
        # equal keys come in order of their runs
        yield from heapq.merge(*runs, key=lambda r: r[:2])


def _sorted_run(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    return rows[np.lexsort((rows["seq"], rows["us"]))]


def _read_run(spill, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    for a in range(start, end, READ_ROWS):
        spill.seek(a * _ATTEMPT.itemsize)
        yield from np.frombuffer(spill.read(min(READ_ROWS, end - a) * _ATTEMPT.itemsize), _ATTEMPT).tolist()


def timer_ms(until_us: int) -> int:
    """The first millisecond at which a lock has ended."""
    return -(-until_us // 1000)


class LockoutProcessor(StatefulProcessor):
    """One user's lock state, advanced attempt by attempt."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lock", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count, at, until, rejected = self.state.get() or (0, None, None, 0)
        before, touched, out = until, False, []
        for us, _, good in attempts_in_order(rows):
            if until is not None:
                if us < until:
                    rejected, touched = rejected + 1, True
                    continue
                out.append((key[0], at, until, rejected, True))
                count, at, until, rejected, touched = 0, None, None, 0, False
                if len(out) >= READ_ROWS:
                    yield pd.DataFrame(out, columns=_OUT_COLUMNS)
                    out = []
            if good:
                count = 0
            else:
                count += 1
                if count >= MAX_FAILED_ATTEMPTS:
                    at, until, rejected, touched = us, us + LOCK_US, 0, True
        if touched:
            out.append((key[0], at, until, rejected, False))
        if before is not None and before != until:
            self.handle.deleteTimer(timer_ms(before))
        if until is not None:
            if before != until:
                self.handle.registerTimer(timer_ms(until))
            self.state.update((0, at, until, rejected))
        elif count:
            self.state.update((count, None, None, 0))
        else:
            self.state.clear()  # nothing to remember for this user
        yield pd.DataFrame(out, columns=_OUT_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the end of the lock: the next attempt starts from nothing."""
        _, at, until, rejected = self.state.get() or (0, None, None, 0)
        out = []
        if until is not None and timer_ms(until) <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], at, until, rejected, True))
            self.state.clear()
        yield pd.DataFrame(out, columns=_OUT_COLUMNS)

    def close(self) -> None:
        pass


def lockout_stream(attempts: DataFrame, user: str = "user", ts: str = "ts", seq: str = "seq", ok: str = "ok",
                   watermark: str = WATERMARK) -> DataFrame:
    """G6 on a stream: the rows of locks that changed, to be started in update mode under RocksDB (see ``run_locks``).

    ``(user, locked_at, locked_until, rejected_while_locked, closed)``; times in the input's type.
    """
    ntz = attempts.schema[ts].dataType.simpleString() == "timestamp_ntz"
    a = attempts.select(F.col(user).cast("string").alias("user"), F.col(ts).alias("ts"), F.col(seq).cast("bigint").alias("seq"),
                        F.coalesce(F.col(ok).cast("boolean"), F.lit(False)).alias("ok"))
    a = a.where(F.col("user").isNotNull() & F.col("ts").isNotNull())
    a = event_time(a.withColumn("us", to_micros(F.col("ts"), ntz)), "ts").withWatermark("ts", watermark)
    out = a.groupBy("user").transformWithStateInPandas(LockoutProcessor(), _OUT, "Update", "EventTime")
    return out.select("user", from_micros(F.col("locked_at_us"), ntz).alias("locked_at"),
                      from_micros(F.col("locked_until_us"), ntz).alias("locked_until"), "rejected_while_locked", "closed")


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def run_locks(locks: DataFrame, name: str, progress: list | None = None) -> DataFrame:
    """Run ``lockout_stream`` over everything available now: every lock once, with its latest count.

    Each micro-batch writes the rows it changed to its own folder, so a repeated
    batch replaces them. ``progress`` receives the state rows after each batch.
    """
    spark = locks.sparkSession
    base = shared_path(spark, name)
    data = os.path.join(base, "data")

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(data, f"batch={batch_id}"))

    with rocksdb(spark):
        query = (locks.writeStream.outputMode("update").foreachBatch(append)
                 .option("checkpointLocation", os.path.join(base, "_checkpoint")).trigger(availableNow=True).start())
        query.awaitTermination()
    if progress is not None:
        progress += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    if query.lastProgress is None:
        return spark.createDataFrame([], locks.schema)
    rows = spark.read.schema(locks.schema).parquet(data)
    # a lock only ever gains rejected attempts, and then closes
    latest = F.max(F.struct("rejected_while_locked", "closed"))
    return rows.groupBy("user", "locked_at", "locked_until").agg(latest.alias("last")).select(
        "user", "locked_at", "locked_until", "last.rejected_while_locked", "last.closed")
