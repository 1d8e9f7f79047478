import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.operators import classes, lockout
from veilframe.plans.profile import ProfileError
from veilframe.streaming import growing, jobs
from veilframe.streaming import lockout as stream_lockout


def _write_batches(spark, base, frames):
    for i, pdf in enumerate(frames):
        spark.createDataFrame(pdf).coalesce(1).write.mode("overwrite").parquet(f"{base}/part{i}")
        # move each batch's file into one flat directory, as a landing zone would
    flat = f"{base}/landing"
    for i, _ in enumerate(frames):
        spark.read.parquet(f"{base}/part{i}").coalesce(1).write.mode("append").parquet(flat)
    return flat


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_anonymize_stream_refuses_whole_table_ops(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "name string, age int")
    df.write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    with pytest.raises(ProfileError):
        jobs.anonymize_stream(s, {"columns": {"age": {"transform": "shuffle"}}}, seed=1)
    with pytest.raises(ProfileError):
        jobs.anonymize_stream(s, {"k_anonymity": {"k": 2}, "quasi_identifiers": ["age"]}, seed=1)
    out = jobs.run_available(jobs.anonymize_stream(s, {"columns": {"name": {"transform": "mask"}}}, seed=1), "t")
    assert [r.name for r in out.collect()] == ["*"]


def test_rollup_and_breaches_over_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    frames = []
    for b in range(3):
        rows = [(b * 1000 + i, t0 + dt.timedelta(hours=b * 5, minutes=3 * i), "u1" if i % 3 else "u2", "login")
                for i in range(60)]
        frames.append(pd.DataFrame(rows, columns=["seq", "ts", "user", "event_type"]))
    path = _write_batches(spark, str(tmp_path), frames)
    schema = spark.read.parquet(path).schema
    log = _stream(spark, path, schema).withColumn("success", F.lit(True))
    got = jobs.run_windows(jobs.rollup_stream(log, "1 hour", "1 hour", ("event_type",)), "r").collect()
    exp = pd.concat(frames).assign(h=lambda d: d["ts"].dt.floor("h")).groupby("h").size().to_dict()
    assert {pd.Timestamp(r.window_start): r.n_events for r in got} == exp
    newest = max(exp)
    assert {pd.Timestamp(r.window_start) for r in got if not r.final} == {newest}
    br = jobs.run_windows(jobs.rate_breach_stream(_stream(spark, path, schema), "user", "1 hour", 10, "1 hour"),
                            "b").collect()
    assert br and all(r.n_events > 10 for r in br)


def test_wall_clock_results_do_not_depend_on_session_zone(spark, tmp_path):
    from veilframe.operators import audit
    rows = [(i, dt.datetime(2024, 1, 1, 20, 0) + dt.timedelta(minutes=17 * i), f"u{i % 2}", "login", True, "{}")
            for i in range(40)]
    pdf = pd.DataFrame(rows, columns=["seq", "ts", "user", "event_type", "success", "details"])
    path = str(tmp_path / "log")
    spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(path)
    schema = spark.read.parquet(path).schema

    def results():
        log = spark.read.parquet(path)
        day = sorted(tuple(r) for r in audit.rate_breaches(log, "user", "1 day", 3).collect())
        roll = sorted(tuple(r) for r in audit.rollup(log, "day", ("user",)).collect())
        s = spark.readStream.schema(schema).parquet(path)
        st = sorted(tuple(r) for r in jobs.run_windows(jobs.rate_breach_stream(s, "user", "1 day", 3, "1 hour"),
                                                        "tz").collect())
        return day, roll, st

    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        base = results()
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        assert results() == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert base[1] and all(r[0].hour == 0 for r in base[1])  # day buckets start at wall-clock midnight


def test_tail_audit_log_as_stream(spark, tmp_path):
    import json
    from veilframe.sources.files import stream_audit_log
    logdir = tmp_path / "log"
    logdir.mkdir()
    t0 = dt.datetime(2025, 12, 1, 12, 0, 0)
    for f in range(2):  # two files landing one after the other
        lines = []
        for i in range(30):
            ts = (t0 + dt.timedelta(minutes=10 * (30 * f + i))).strftime("%Y-%m-%d %H:%M:%S")
            msg = {"event_type": "DATA_ACCESS" if i % 3 else "ERROR", "user": "u", "success": bool(i % 3),
                   "details": {"operation": "READ"}}
            lines.append(json.dumps({"timestamp": ts, "level": "INFO", "message": msg}))
        lines.append("{broken")
        (logdir / f"part{f}.json").write_text("\n".join(lines) + "\n")
    log = stream_audit_log(spark, str(logdir))
    out = jobs.run_windows(jobs.rollup_stream(log, "1 hour", "1 hour", ("event_type",)), "tail").collect()
    assert sum(r.n_events for r in out) == 60 and {r.event_type for r in out} == {"DATA_ACCESS", "ERROR"}


ATTEMPT = "user string, ts timestamp_ntz, seq long, ok boolean"


def _attempts(seed, n, users=4, steps=(10, 40, 90, 400)):
    rnd, t, rows = random.Random(seed), dt.datetime(2024, 1, 1), []
    for seq in range(n):
        t += dt.timedelta(seconds=rnd.choice(steps))
        rows.append((f"u{rnd.randint(0, users - 1)}", t, seq, rnd.random() < 0.2))
    return rows


def _landing(spark, base, batches):
    for rows in batches:
        spark.createDataFrame(rows, ATTEMPT).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    return spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")


def _locks(df):
    return sorted((r.user, r.locked_at, r.locked_until, r.rejected_while_locked) for r in df.collect())


def test_lockout_stream_matches_batch_replay(spark, tmp_path):
    """Four micro-batches in time order, with NULL users, times and outcomes, ties and NULL sequence numbers."""
    rows = _attempts(2, 600)
    rows = [(None if i % 41 == 0 else u, None if i % 53 == 0 else t, None if i % 31 == 0 else q, None if i % 11 == 0 else ok)
            for i, (u, t, q, ok) in enumerate(rows)]
    rows += [(u, t, 10_000 + q if q is not None else 10_000, ok) for u, t, q, ok in rows[::7]]
    rows = [r for _, r in sorted(enumerate(rows), key=lambda x: (x[1][1] or dt.datetime(2024, 1, 1), x[0]))]
    stream = _landing(spark, str(tmp_path), [rows[i:i + 180] for i in range(0, len(rows), 180)])
    got = _locks(stream_lockout.run_locks(stream_lockout.lockout_stream(stream), "l"))
    # NULL sequence numbers come last on the stream, first in the batch: number them alike for the comparison
    known = [(u, t, q if q is not None else 1_000_000, ok) for u, t, q, ok in rows]
    assert got == _locks(lockout.lockout_replay(spark.createDataFrame(known, ATTEMPT)))
    assert len(got) > 3 and any(r[3] for r in got) and not any(r[0] is None for r in got)


def test_lockout_state_of_ended_locks_is_dropped(spark, tmp_path):
    """Fifty users are locked in the first batch; once the watermark has passed, only the last user has state."""
    t = dt.datetime(2024, 1, 1)
    first = [(f"u{u}", t + dt.timedelta(seconds=i), 10 * u + i, False) for u in range(50) for i in range(7)]
    later = [[("z", t + dt.timedelta(hours=h), 10_000 + h, False)] for h in (3, 6, 9)]
    rows = []
    locks = stream_lockout.run_locks(stream_lockout.lockout_stream(_landing(spark, str(tmp_path), [first, *later])), "s", rows)
    assert max(rows) >= 50 and rows[-1] < 5, rows
    got = locks.collect()
    assert len(got) == 50 and all(r.rejected_while_locked == 2 and r.closed for r in got)


def test_open_locks_are_reported(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    batches = [[("a", t + dt.timedelta(seconds=i), i, False) for i in range(6)], [("a", t + dt.timedelta(minutes=5), 9, True)]]
    got = stream_lockout.run_locks(stream_lockout.lockout_stream(_landing(spark, str(tmp_path), batches)), "o").collect()
    assert [(r.rejected_while_locked, r.closed) for r in got] == [(2, False)]


def test_attempts_of_a_user_are_sorted_in_bounded_runs(monkeypatch):
    rows = _attempts(6, 3000, steps=(0, 10, 40))
    pdf = pd.DataFrame([(int((t - dt.datetime(2024, 1, 1)).total_seconds() * 1e6), q, ok) for _, t, q, ok in rows],
                       columns=["us", "seq", "ok"])
    mixed = pdf.sample(frac=1, random_state=1)
    monkeypatch.setattr(stream_lockout, "SPILL_ROWS", 200)
    monkeypatch.setattr(stream_lockout, "READ_ROWS", 16)
    monkeypatch.setattr(stream_lockout.pd, "concat", None)  # the frames of a user are never joined
    got = list(stream_lockout.attempts_in_order(mixed.iloc[i:i + 100] for i in range(0, 3000, 100)))
    monkeypatch.undo()
    assert got == [tuple(r) for r in pdf.sort_values(["us", "seq"]).itertuples(index=False)]


PEOPLE = "id int, age int, dept string, diagnosis string"


def _people(seed, n):
    rnd = random.Random(seed)
    return [(i, rnd.choice([None, 21, 24, 33, 38, 47, 52]), rnd.choice([None, "Engineering", "Sales", "Selling"]),
             rnd.choice([None, "a", "b", "c", "d"]) if rnd.random() < 0.7 else "a") for i in range(n)]


def _grown(spark, tmp_path, rows, size, **options):
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], PEOPLE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/people")
    stream = spark.readStream.schema(PEOPLE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/people")
    return growing.accumulate(stream, ["age", "dept"], "diagnosis", folder=f"{tmp_path}/table", **options)


@pytest.mark.parametrize("null_qi", ["suppress", "keep"])
def test_growing_table_equals_the_batch_operators(spark, tmp_path, null_qi):
    """After five batches: the same classes, the same k search and the same rows as over the whole table, NULLs included."""
    rows = _people(4, 150)
    table = _grown(spark, tmp_path, rows, 30)
    whole = spark.createDataFrame(rows, PEOPLE)
    assert table.version == 4 and table.rows().count() == 150
    for k, l in ((3, 2), (9, 3), (40, 4)):
        mine, found = table.k_anonymous(k, {"age": 1, "dept": 4}, null_qi)
        batch, expected = classes.apply_k_anonymity(whole, ["age", "dept"], k, {"age": 1, "dept": 4}, null_qi)
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, batch.collect())) and found == expected
        mine = table.k_and_l(k, l, {"age": 1, "dept": 4}, null_qi)[0]
        batch = classes.apply_k_and_l(whole, ["age", "dept"], "diagnosis", k, l, {"age": 1, "dept": 4}, null_qi)[0]
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, batch.collect()))
    mine, batch = table.l_diverse(3), classes.enforce_l_diversity(whole, ["age", "dept"], "diagnosis", 3)
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, batch.collect()))


def test_growing_table_goes_on_and_reads_no_earlier_rows(spark, tmp_path, monkeypatch):
    """A second run takes the new files only; its class tables come from the last version and the new rows."""
    rows = _people(5, 90)
    first = _grown(spark, tmp_path, rows[:60], 30)
    assert first.version == 1
    monkeypatch.setattr(growing.GrowingTable, "rows", None)  # earlier rows are not asked for
    second = _grown(spark, tmp_path, rows[60:], 30)
    monkeypatch.undo()
    assert second.version == 2 and second.rows().count() == 90
    sizes = {(r.age, r.dept): r.class_size for r in second.histogram().collect()}
    assert sum(sizes.values()) == 90 and sizes == {key: sum((r[1], r[2]) == key for r in rows) for key in sizes}
    # a batch that is run again replaces itself
    second.add(spark.createDataFrame(rows[60:], PEOPLE), 2)
    assert second.rows().count() == 90 and sum(r.class_size for r in second.histogram().collect()) == 90


def test_growing_table_keeps_few_values_of_a_class(spark, tmp_path):
    rows = [(i, 30, "Sales", f"value{i}") for i in range(60)]
    table = _grown(spark, tmp_path, rows, 20, keep=3)
    assert table.values().count() == 3 and table.l_diverse(3).count() == 60
    with pytest.raises(ValueError, match="keeps 3 values"):
        table.l_diverse(4)
    empty = growing.GrowingTable(spark, f"{tmp_path}/none", table.schema, ["age", "dept"], "diagnosis")
    assert empty.l_diverse(2).count() == 0 and empty.k_anonymous(2)[0].count() == 0
