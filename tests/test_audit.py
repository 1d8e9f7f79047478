import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from replay import lockout_replay_reference, walk
from veilframe.operators import access, audit, lockout
from veilframe.sources.files import append_run_log, read_audit_log


def _log_lines():
    base = dt.datetime(2025, 12, 1, 12, 0, 0)
    lines = []
    for i in range(20):
        et = ["ACCESS_CONTROL", "DATA_ACCESS", "K_ANONYMITY", "ERROR"][i % 4]
        details = {"ACCESS_CONTROL": {"role": "admin", "resource": "login", "action": "login", "granted": i % 8 != 0,
                                      "reason": None},
                   "DATA_ACCESS": {"operation": "UPLOAD", "file_path": "x.csv", "records_count": i},
                   "K_ANONYMITY": {"k": 3, "quasi_identifiers": ["age"], "satisfies": True, "min_group_size": 3,
                                   "input_file": "x.csv"},
                   "ERROR": {"error_type": "E", "error_message": "boom", "file_path": None, "stack_trace": None}}[et]
        msg = {"event_type": et, "user": "admin" if i % 2 else "viewer", "success": et != "ERROR", "details": details}
        ts = (base + dt.timedelta(minutes=7 * i)).strftime("%Y-%m-%d %H:%M:%S")
        lines.append(json.dumps({"timestamp": ts, "level": "ERROR" if et == "ERROR" else "INFO", "message": msg}))
    lines.insert(5, "{not json")
    return lines


def test_read_search_tail_typed(spark, tmp_path):
    p = tmp_path / "audit.log"
    p.write_text("\n".join(_log_lines()) + "\n")
    log = read_audit_log(spark, str(p))
    assert log.count() == 20  # the malformed line is skipped
    hits = audit.search(log, event_type="ERROR", user="admin", start="2025-12-01 12:00:00", end="2025-12-01 13:00:00")
    assert all(r.event_type == "ERROR" and r.user == "admin" for r in hits.collect())
    assert audit.search(log, start="2025-12-01 12:07:00", end="2025-12-01 12:07:00").count() == 1  # inclusive
    tail = audit.tail(log, 3).collect()
    assert [r.ts for r in tail] == sorted([r.ts for r in log.collect()], reverse=True)[:3]
    typed = audit.typed_view(log, "DATA_ACCESS").collect()
    assert len(typed) == 5 and all(r.operation == "UPLOAD" for r in typed)
    k = audit.typed_view(log, "K_ANONYMITY").first()
    assert k.quasi_identifiers == ["age"] and k.satisfies


def test_run_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "runlog")
    append_run_log(spark, [{"timestamp": "2025-01-01 00:00:00", "event_type": "DATA_EXPORT",
                            "details": {"output_file": "o", "records_count": 3, "format": "CSV"}}], path)
    append_run_log(spark, [{"timestamp": "2025-01-01 00:00:01", "event_type": "ERROR", "success": False,
                            "level": "ERROR", "details": {"error_type": "x"}}], path)
    log = read_audit_log(spark, path)
    assert log.count() == 2
    assert audit.typed_view(log, "DATA_EXPORT").first().records_count == 3


def test_rollup_and_rate_breaches(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [(i, t0 + dt.timedelta(seconds=5 * i), "u1" if i < 15 else "u2", "login", True, "{}") for i in range(20)]
    log = spark.createDataFrame(rows, "seq long, ts timestamp, user string, event_type string, success boolean, details string")
    roll = audit.rollup(log, "minute", ("event_type",)).collect()
    assert sum(r.n_events for r in roll) == 20
    br = audit.rate_breaches(log, "user", "1 minute", 10).collect()
    assert [(r.user, r.n_events) for r in br] == [("u1", 12)]
    allr = audit.rate_breaches_all(log, "user").where(F.col("rule").startswith("login")).collect()
    assert len(allr) == 1


def test_access_review(spark):
    acc = spark.createDataFrame([("ann", "anonymize_data"), ("bob", "anonymize_data"), ("bob", "read_data"),
                                 ("eve", "read_data"), ("old", "read_data")], "user string, permission string")
    users = spark.createDataFrame([("ann", "data_owner", True), ("bob", "data_analyst", True), ("old", "admin", False)],
                                  "username string, role string, active boolean")
    got = {(r.user, r.permission): r.granted for r in access.access_review(acc, users).collect()}
    assert got == {("ann", "anonymize_data"): True, ("bob", "anonymize_data"): False, ("bob", "read_data"): True,
                   ("eve", "read_data"): False, ("old", "read_data"): False}
    assert access.access_violations(access.access_review(acc, users)).count() == 3
    assert len(access.ROLE_PERMISSIONS["admin"]) == 12


def test_lockout_matches_sequential_replay(spark):
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    seq = 0
    for u in range(12):
        t = t0
        for _ in range(rnd.randint(5, 80)):
            t += dt.timedelta(seconds=rnd.choice([5, 30, 60, 200, 600, 1000, 3600]))
            rows.append((f"u{u}", t, seq, rnd.random() < 0.25))
            seq += 1
    pdf = pd.DataFrame(rows, columns=["user", "ts", "seq", "ok"])
    df = spark.createDataFrame(pdf)
    got = sorted((r.user, r.locked_at, r.locked_until, r.rejected_while_locked)
                 for r in lockout.lockout_replay(df).collect())
    exp = lockout_replay_reference(pdf)
    exp = sorted((r.user, r.locked_at.to_pydatetime(), r.locked_until.to_pydatetime(), r.rejected_while_locked)
                 for r in exp.itertuples())
    assert got == exp and len(got) > 0


def _dense_attempts(seed, users=6, n=400):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows, seq = [], 0
    for u in range(users):
        t = t0
        for _ in range(rnd.randint(n // 4, n)):
            t += dt.timedelta(seconds=rnd.choice([1, 2, 5, 30, 120, 400, 950]), microseconds=rnd.randint(0, 999_999))
            rows.append((f"u{u}", t, seq, rnd.random() < 0.15))
            seq += 1
    return pd.DataFrame(rows, columns=["user", "ts", "seq", "ok"])


def _as_tuples(df):
    return sorted((r.user, r.locked_at, r.locked_until, r.rejected_while_locked) for r in df.collect())


def _reference(pdf):
    exp = lockout_replay_reference(pdf)
    return sorted((r.user, r.locked_at.to_pydatetime(), r.locked_until.to_pydatetime(), r.rejected_while_locked)
                  for r in exp.itertuples())


def test_lockout_join_path_matches_sequential_replay(spark):
    pdf = _dense_attempts(7)
    got = _as_tuples(lockout.lockout_replay(spark.createDataFrame(pdf), max_session_rows=0))
    assert got == _reference(pdf) and len(got) > 5


def test_lockout_mixed_routing(spark):
    pdf = _dense_attempts(11, users=8, n=300)
    got = _as_tuples(lockout.lockout_replay(spark.createDataFrame(pdf), max_session_rows=60))
    assert got == _reference(pdf)


@pytest.mark.parametrize("limit", [0, 2, 200_000])
def test_lockout_nulls_and_ties_do_not_depend_on_the_routing(spark, limit):
    t = dt.datetime(2024, 1, 1)
    rows = [("u", t + dt.timedelta(seconds=i), i, None if i == 3 else i == 9) for i in range(8)]
    rows += [("u", None, 100, False), (None, t, 101, False), ("v", t, 1, False)] + [("v", t, i, False) for i in range(2, 7)]
    df = spark.createDataFrame(rows, "user string, ts timestamp, seq long, ok boolean")
    got = _as_tuples(lockout.lockout_replay(df, max_session_rows=limit))
    lock = dt.timedelta(minutes=15)
    assert got == [("u", t + dt.timedelta(seconds=4), t + dt.timedelta(seconds=4) + lock, 3), ("v", t, t + lock, 1)]


def test_lockout_rule_details():
    t = pd.Timestamp("2024-01-01")
    m = pd.Timedelta(minutes=1)
    ts = [t + i * m for i in range(5)] + [t + 10 * m, t + 19 * m, t + 20 * m]
    ok = [False] * 5 + [True, False, False]
    locks = walk(ts, ok)
    # locked at minute 4 until 19: the success at minute 10 is rejected (not a reset)
    assert locks == [[t + 4 * m, t + 19 * m, 1]]
