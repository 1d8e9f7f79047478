"""Bounded diversity, value digests, class ids, broken CSV lines, the audit table by day, run outputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import audit, classes, metrics
from veilframe.plans.pipeline import run
from veilframe.sources import files


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- L2 by sketches -----------------------------------------------------------------

@pytest.mark.parametrize("l", [1, 2, 15, 16, 17, 40, 300])
def test_sketch_decides_at_least_l(spark, l):
    # classes with l - 1, l and l + 1 values, far more, none at all, each value many times
    sizes = {"below": l - 1, "just": l, "above": l + 1, "many": 20 * l + 5000, "null": 0}
    rows = [(c, i) for c, n in sizes.items() for i in [*range(n), *range(n // 2)]] + [("null", None), ("below", None)]
    random.Random(l).shuffle(rows)
    df = spark.createDataFrame(rows, "c string, v bigint").repartition(7)
    got = {r.c: r.enough for r in classes.diverse_classes(df, ["c"], "v", l).collect()}
    assert got == {c: n >= l for c, n in sizes.items()}


@pytest.mark.parametrize("type_", ["string", "double", "decimal(20,4)", "date", "boolean", "binary", "timestamp_ntz"])
def test_sketch_takes_every_type_as_count_distinct_does(spark, type_):
    base = spark.range(400).select((F.col("id") % 4).alias("c"), F.expr("id div 4 % (id % 4 * 3 + 1)").alias("i"))
    value = {"string": F.when(F.col("i") > 0, F.col("i").cast("string")).otherwise(""),
             "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("i").cast("int")),
             "timestamp_ntz": F.date_add(F.lit("2024-01-01").cast("date"), F.col("i").cast("int")).cast("timestamp_ntz"),
             "binary": F.col("i").cast("string").cast("binary"), "boolean": F.col("i") % 2 == 0,
             "double": F.when(F.col("i") == 0, F.when(F.rand(1) < 0.5, -0.0).otherwise(0.0)).otherwise(F.col("i").cast("double"))}
    df = base.select("c", value.get(type_, F.col("i").cast(type_)).alias("v"))
    for l in (1, 2, 4, 7, 10):
        exact = {r.c: r.diversity >= l for r in classes.class_table(df, ["c"], "v").collect()}
        assert {r.c: r.enough for r in classes.diverse_classes(df, ["c"], "v", l).collect()} == exact


def test_sensitive_values_are_not_shuffled(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("c"), F.col("id").cast("string").alias("v"))
    plan = _plan(classes.diverse_classes(df, ["c"], "v", 3))
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(c" in plan
    # the exchange carries the key and one sketch a class and task
    counted = _plan(df.groupBy("c").agg(F.count_distinct("v")))
    assert counted.count("Exchange hashpartitioning") == 2


def test_enforce_l_with_and_without_a_class_table(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abcdef"), rnd.choice([None, 1, 2, 3]), rnd.randrange(6)) for _ in range(60)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "q string, r int, s int")
    table = classes.class_table(df, ["q", "r"], "s")
    key = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    for l in (1, 2, 3, 4, 9):
        assert key(classes.enforce_l_diversity(df, ["q", "r"], "s", l)) == key(
            classes.enforce_l_diversity(df, ["q", "r"], "s", l, table))


# --- digests and class ids ------------------------------------------------------------

def test_entropy_shuffles_digests_not_texts(spark):
    df = spark.createDataFrame([("x" * 5000 + str(i % 8), i % 2) for i in range(64)] + [(None, None)], "a string, b int")
    got = {r.column: r.entropy for r in metrics.column_entropy(df, ["a", "b", "absent"]).collect()}
    assert got == {"a": pytest.approx(3.0), "b": pytest.approx(1.0), "absent": 0.0}
    sizes = metrics.stacked_values(df, ["a", "b"]).select(F.length("value").alias("n")).distinct().collect()
    assert [r.n for r in sizes] == [16]
    assert {r.column: r.entropy for r in metrics.column_entropy(df, ["absent"]).collect()} == {"absent": 0.0}
    assert {r.entropy for r in metrics.column_entropy(df.limit(0), ["a", "b"]).collect()} == {0.0}


def test_class_ids_agree_between_rows_and_classes(spark):
    df = spark.createDataFrame([("a", "bc", -0.0), ("ab", "c", 0.0), ("a", "bc", 0.0), (None, "c", 1.0)], "p string, q string, x double")
    qi = ["p", "q", "x"]
    ids = {(r.p, r.q): r.class_id for r in classes.class_summary(df, qi).collect()}
    rows = classes.with_class_id(df, qi).collect()
    assert len(set(ids.values())) == 2 and all(len(i) == 32 for i in ids.values())
    assert all(r.class_id == ids.get((r.p, r.q)) for r in rows)


# --- broken CSV lines -------------------------------------------------------------------

def test_bad_lines_are_split_off(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write('k,name,n\n1,"a,b",2\n2,short\n3,long,4,5\nx,bad,6\n4,,\n5,last,7\n')
    good, bad = files.read_csv_split(spark, path, "k int, name string, n int")
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "a,b", 2), (4, None, None), (5, "last", 7)]
    assert sorted((r.line, r.n_read) for r in bad.collect()) == [("2,short", 2), ("3,long,4,5", 3), ("x,bad,6", 2)]
    assert (good.count(), bad.count()) == (3, 3) and bad.select("line").count() == 3
    assert sorted(r.k for r in good.select("k").collect()) == [1, 4, 5]
    empty = str(tmp_path / "empty.csv")
    open(empty, "w").close()
    assert [x.count() for x in files.read_csv_split(spark, empty, "k int, name string")] == [0, 0]


# --- the audit table by day ----------------------------------------------------------------

def _log(spark, days=6, per_day=20):
    start = dt.datetime(2024, 3, 1)
    rows = [(d * 100 + i, start + dt.timedelta(days=d, minutes=(i // 2) * 7), "INFO", "login" if i % 3 else "error", f"u{i % 4}",
             True, "{}") for d in range(days) for i in range(per_day)]
    rows += [(-1, None, "INFO", "login", "u0", True, "{}"), (-2, None, "INFO", "error", None, None, None)]
    return spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, level string, event_type string, user string, success boolean, details string")


def test_day_layout_answers_as_the_flat_log(spark, tmp_path):
    log, path = _log(spark), str(tmp_path / "audit")
    files.write_audit_table(log, path)
    table = files.read_audit_table(spark, path)
    key = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    for args in ({}, {"event_type": "error"}, {"user": "u1", "start": "2024-03-02 00:30:00"},
                 {"start": "2024-03-02 00:00:00", "end": "2024-03-03 00:14:00"}, {"end": "2024-02-01 00:00:00"}):
        found = audit.search_days(table, **args)
        assert key(found) == key(audit.search(log, **args)) and found.columns == log.columns
    for n in (0, 1, 20, 21, 45, 120, 121, 122, 500):
        assert [r.seq for r in audit.tail_days(table, n).collect()] == [r.seq for r in audit.tail(log, n).collect()]
    with pytest.raises(ValueError):
        audit.tail_days(table, -1)


def test_search_reads_only_the_asked_days(spark, tmp_path):
    path = str(tmp_path / "audit")
    files.write_audit_table(_log(spark), path)
    found = audit.search_days(files.read_audit_table(spark, path), start="2024-03-02 00:00:00", end="2024-03-03 12:00:00")
    line = next(x for x in found._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in x)
    assert "day" in line.split("PartitionFilters")[1].split("]")[0]
    assert {f.split("/day=")[1][:10] for f in [r.f for r in found.select(F.input_file_name().alias("f")).distinct().collect()]} == {
        "2024-03-02", "2024-03-03"}


def test_audit_table_takes_appends_and_an_empty_log(spark, tmp_path):
    path = str(tmp_path / "audit")
    log = _log(spark, 2, 3)
    files.write_audit_table(log, path)
    files.write_audit_table(log, path)
    assert files.read_audit_table(spark, path).count() == 2 * log.count()
    assert audit.tail_days(files.read_audit_table(spark, path), 4).count() == 4


# --- what run leaves behind ----------------------------------------------------------------------

def test_run_writes_the_long_report_and_full_log_entries(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", 20 + i % 2, "xy"[i // 2 % 2]) for i in range(12)], "id int, name string, band int, s string")
    profile = {"columns": {"name": {"transform": "mask", "params": {}}, "gone": {"transform": "mask", "params": {}}},
               "quasi_identifiers": ["band"], "k_anonymity": {"k": 3}, "l_diversity": {"l": 2}, "sensitive_attribute": "s",
               "seed": 5}
    out = str(tmp_path / "out")
    res = run(df, profile, output_path=out, log_path=str(tmp_path / "log"), with_report=True, profile_path="p.json")
    rows = {(r.section, r.metric, r.column): r.value for r in spark.read.parquet(files.report_rows_path_for(out)).collect()}
    assert rows[("k_anonymity", "k_value", None)] == "6" and rows[("k_anonymity", "group_size", "6")] == "2"
    assert rows[("summary", "recommendation", None)] == res.report["summary"]["recommendation"]
    log = files.read_audit_log(spark, str(tmp_path / "log"))
    seen = {r.event_type: r for r in log.collect() if r.event_type in ("PROFILE_LOAD", "TRANSFORMATION")}
    assert '"profile_path":"p.json"' in seen["PROFILE_LOAD"].details.replace(": ", ":")
    view = audit.typed_view(log, "TRANSFORMATION").collect()
    assert [(r.column, r.records_affected) for r in view] == [("name", 12)]
