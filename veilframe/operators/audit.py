"""Audit-log analytics (G1-G4, G7) over a log table.

The log is a table of envelopes ``(ts, level, event_type, user, success,
details)`` where ``details`` is a JSON text whose fields depend on the event
type. ``events_as_audit`` maps the driver's ``events`` table onto that shape
(its ``props`` JSON plays the role of ``details``).
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The event types of the audit log and the detail fields each carries.
EVENT_DETAIL_FIELDS = {
    "DATA_ACCESS": "operation string, file_path string, records_count bigint",
    "TRANSFORMATION": "transformation_type string, column string, parameters string, records_affected bigint",
    "ANONYMIZATION": "method string, input_file string, output_file string, original_records bigint, "
                     "anonymized_records bigint, suppression_rate double, parameters string",
    "K_ANONYMITY": "k bigint, quasi_identifiers array<string>, satisfies boolean, min_group_size bigint, "
                   "input_file string",
    "L_DIVERSITY": "l bigint, sensitive_attribute string, satisfies boolean, min_diversity bigint, input_file string",
    "DIFFERENTIAL_PRIVACY": "epsilon double, delta double, columns array<string>, budget_used double, "
                            "input_file string",
    "ACCESS_CONTROL": "role string, resource string, action string, granted boolean, reason string",
    "SECURITY_EVENT": "event_type string, description string, severity string, additional_data string",
    "ERROR": "error_type string, error_message string, file_path string, stack_trace string",
    "PROFILE_LOAD": "profile_path string, columns_configured bigint",
    "DATA_EXPORT": "output_file string, records_count bigint, format string",
    "VALIDATION": "validation_type string, passed boolean, details string",
}

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}

# Fixed rate-limit rules of the service: (route, events counted, window, limit).
RATE_LIMIT_RULES = [
    ("default", None, "1 day", 200),
    ("default", None, "1 hour", 50),
    ("login", ["login"], "1 minute", 10),
    ("upload", ["upload"], "1 minute", 10),
    ("anonymize", ["anonymize"], "1 hour", 20),
    ("audit_logs", ["audit_logs"], "1 minute", 30),
]


def events_as_audit(events: DataFrame) -> DataFrame:
    """Map ``events(event_id, ts, user_id, event_type, value, props)`` onto audit envelopes.

    ``error`` events are failures (level ERROR); all others succeed (INFO).
    """
    fail = F.col("event_type") == F.lit("error")
    return events.select(
        F.col("event_id").alias("seq"), F.col("ts"),
        F.when(fail, F.lit("ERROR")).otherwise(F.lit("INFO")).alias("level"),
        F.col("event_type"), F.col("user_id").cast("string").alias("user"),
        (~fail).alias("success"), F.col("props").alias("details"),
    )


def search(log: DataFrame, event_type: str | None = None, user: str | None = None,
           start: _dt.datetime | str | None = None, end: _dt.datetime | str | None = None) -> DataFrame:
    """G1: filter by event type, user and an inclusive time range (pushed to the scan)."""
    cond = F.lit(True)
    if event_type is not None:
        cond = cond & (F.col("event_type") == F.lit(event_type))
    if user is not None:
        cond = cond & (F.col("user") == F.lit(user))
    if start is not None:
        cond = cond & (F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        cond = cond & (F.col("ts") <= F.lit(end).cast("timestamp"))
    return log.where(cond)


def search_days(table: DataFrame, event_type: str | None = None, user: str | None = None,
                start: _dt.datetime | str | None = None, end: _dt.datetime | str | None = None) -> DataFrame:
    """G1 on a log laid out by ``day``: the same rows, from the folders of the asked days only."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("day") >= F.to_date(F.lit(start).cast("timestamp")))
    if end is not None:
        cond = cond & (F.col("day") <= F.to_date(F.lit(end).cast("timestamp")))
    return search(table.where(cond), event_type, user, start, end).drop("day")


def tail_days(table: DataFrame, n: int = 100, order_cols: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """G2 on a log laid out by ``day``: reads the newest days only, twice as many until they hold n entries.

    The days are read from the folder names of the table's files. Entries without a
    time come last and are read only when all days hold fewer than n.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    folders = {m.group(1) for f in table.inputFiles() if (m := re.search(r"/day=(\d{4}-\d\d-\d\d)/", f))}
    days = sorted(folders, reverse=True)
    width = 1
    while width < len(days):
        newest = table.where(F.col("day") >= F.lit(days[width - 1]).cast("date"))
        if newest.count() >= n:
            return tail(newest, n, order_cols).drop("day")
        width *= 2
    return tail(table, n, order_cols).drop("day")


def tail(log: DataFrame, n: int = 100, order_cols: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The newest ``n`` entries (a top-k: per-partition heaps, then one merge of n rows each)."""
    if n < 0:
        raise ValueError("n must be >= 0")
    return log.orderBy(*[F.col(c).desc() for c in order_cols]).limit(n)


def typed_view(log: DataFrame, event_type: str, fields: str | None = None) -> DataFrame:
    """Entries of one event type with their ``details`` parsed into columns.

    A detail field named like a column of the log becomes ``detail_<name>``
    (a SECURITY_EVENT carries an ``event_type`` of its own).
    """
    schema = fields or EVENT_DETAIL_FIELDS[event_type]
    parsed = log.where(F.col("event_type") == F.lit(event_type)).withColumn(
        "_d", F.from_json(F.col("details"), schema))
    base = [c for c in log.columns if c != "details"]
    taken = {c.lower() for c in base}
    names = parsed.schema["_d"].dataType.names
    return parsed.select(*base, *[F.col("_d")[n].alias(f"detail_{n}" if n.lower() in taken else n) for n in names])


def rollup(log: DataFrame, granularity: str = "day", by: tuple[str, ...] = ("event_type", "success")) -> DataFrame:
    """Event counts per time bucket and key (partial aggregation per task).

    The bucket keeps the type of ``ts`` (``date_trunc`` yields a zoned
    timestamp; wall-clock input stays wall-clock).
    """
    bucket = F.date_trunc(granularity, F.col("ts")).cast(log.schema["ts"].dataType)
    return log.groupBy(bucket.alias("bucket"), *by).agg(F.count(F.lit(1)).alias("n_events"))


def rate_breaches(log: DataFrame, key: str, window: str, limit: int, event_types: list[str] | None = None,
                  rule: str | None = None) -> DataFrame:
    """Fixed (epoch-aligned) windows where one key made more than ``limit`` requests."""
    src = log if not event_types else log.where(F.col("event_type").isin(event_types))
    counts = src.groupBy(F.window(F.col("ts"), window).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n_events"))
    out = counts.where(F.col("n_events") > F.lit(limit)).select(
        F.col(key), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        F.col("n_events"), F.lit(limit).alias("limit"))
    return out.withColumn("rule", F.lit(rule or f"{limit} per {window}"))


def rate_breaches_all(log: DataFrame, key: str, rules=None) -> DataFrame:
    """G7 for a list of rules at once: one scan and one aggregation on (rule, window, key).

    Each event is counted under the rules it falls under (a handful per event,
    combined on the map side).
    """
    rules = RATE_LIMIT_RULES if rules is None else rules
    wall_clock = log.schema["ts"].dataType.simpleString() == "timestamp_ntz"
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("ts")) if wall_clock else F.unix_micros(F.col("ts"))

    def instant(c):
        return F.timestamp_add("MICROSECOND", c, epoch) if wall_clock else F.timestamp_micros(c)

    entries = []
    for name, types, window, limit in rules:
        n, unit = window.split()
        length = F.lit(int(n) * _UNIT_SECONDS[unit.rstrip("s")] * 1_000_000).cast("bigint")
        entry = F.struct(F.lit(f"{name}: {limit} per {window}").alias("rule"), F.lit(limit).alias("limit"),
                         (F.floor(micros / length) * length).cast("bigint").alias("at"), length.alias("length"))
        entries.append(entry if not types else F.when(F.col("event_type").isin(types), entry))
    each = log.where("ts is not null").select(key, F.explode(F.array_compact(F.array(*entries))).alias("r"))
    counts = each.groupBy(key, "r").agg(F.count(F.lit(1)).alias("n_events")).where(F.col("n_events") > F.col("r.limit"))
    return counts.select(F.col(key), instant(F.col("r.at")).alias("window_start"),
                         instant(F.col("r.at") + F.col("r.length")).alias("window_end"), "n_events",
                         F.col("r.limit").alias("limit"), F.col("r.rule").alias("rule"))
