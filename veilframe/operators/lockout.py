"""Lockout replay (G6): replay login attempts against the lockout rule.

Rule (fixed values below): five failed attempts lock a user for 15 minutes;
a success resets the count; an attempt while locked is rejected and not
counted; the first attempt at or after the lock expiry starts from zero.

The rule is sequential per user, but it only carries a failure count 0..4
across a quiet gap of at least 15 minutes (any lock has expired by then). So:

1. *Sessions*: attempts are cut where a user's consecutive attempts are at
   least 15 minutes apart. The cuts are found on per-(user, 15-minute bucket)
   summaries (min/max time), whose number is bounded by the time span, not
   by the number of attempts; a window over those summaries numbers sessions.
2. *Per session*: its attempts, sorted in one array, are folded by the rule once
   for each possible start count 0..4 (``aggregate`` with a state of count, lock
   end and rejected attempts). A session becomes a map from start count to end
   count and locks.
3. *Per user*: the maps are composed in order from count 0, which gathers the
   locks of the path taken.

All of it is Spark expressions; no Python runs on this path.

A user with a session above ``MAX_SESSION_ROWS`` attempts (never quiet for
15 minutes) is replayed by ``_lockout_by_jumping`` instead: joins and pointer
doubling over the attempts, with no group per user at all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import sized_join

# Fixed values of the lockout rule.
MAX_FAILED_ATTEMPTS = 5
LOCKOUT_MINUTES = 15

_GAP_US = LOCKOUT_MINUTES * 60 * 1_000_000
MAX_SESSION_ROWS = 200_000  # larger sessions go to the join-based replay
ROWS_PER_PARTITION = 2_000_000  # attempts per range-sorted partition in the join-based replay
_LAST_SEQ = 2 ** 63 - 1     # attempts of one time without a sequence number come last

_LOCKS = "array<struct<locked_until: bigint, rejected: bigint>>"
_STATE = f"struct<count: int, until: bigint, rejected: bigint, locks: {_LOCKS}>"


def _micros(c, ts_type: str):
    """Microseconds on the time axis: epoch micros, or wall-clock micros for ntz."""
    col = F.col(c) if isinstance(c, str) else c
    if ts_type == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
    return F.unix_micros(col)


def _from_micros(c: Column, ts_type: str) -> Column:
    """The inverse of ``_micros``."""
    if ts_type == "timestamp_ntz":
        return F.timestamp_add("MICROSECOND", c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.timestamp_micros(c)


def _ended_lock(state: Column) -> Column:
    """The locks so far and the one that is held, which has ended."""
    return F.concat(state["locks"], F.array(F.struct(state["until"].alias("locked_until"), state["rejected"].alias("rejected"))))


def _state(count: Column, until: Column, rejected: Column, locks: Column) -> Column:
    return F.struct(count.cast("int").alias("count"), until.cast("bigint").alias("until"),
                    rejected.cast("bigint").alias("rejected"), locks.cast(_LOCKS).alias("locks"))


def _attempt(state: Column, x: Column) -> Column:
    """The state after one attempt (``us``, ``seq``, ``ok``); while a lock is held its count is 0."""
    locked = state["until"].isNotNull()
    rejected = locked & (x["us"] < state["until"])
    failures = F.when(x["ok"], F.lit(0)).otherwise(state["count"] + 1)
    lock = failures >= MAX_FAILED_ATTEMPTS
    counted = _state(F.when(lock, F.lit(0)).otherwise(failures), F.when(lock, x["us"] + F.lit(_GAP_US)), F.lit(0),
                     F.when(locked, _ended_lock(state)).otherwise(state["locks"]))
    return F.when(rejected, _state(state["count"], state["until"], state["rejected"] + 1, state["locks"])).otherwise(counted)


def replayed(attempts: Column) -> Column:
    """A session's map: for each start count, ``end`` and ``locks`` (lock ends in microseconds, rejected attempts).

    ``attempts`` is the sorted array of the session; a lock still held at its end has run out before the next session.
    """
    def fold(start: Column) -> Column:
        begin = _state(start, F.lit(None), F.lit(0), F.array())
        return F.aggregate(attempts, begin, _attempt, lambda s: F.struct(
            s["count"].alias("end"), F.when(s["until"].isNotNull(), _ended_lock(s)).otherwise(s["locks"]).alias("locks")))

    return F.transform(F.sequence(F.lit(0), F.lit(MAX_FAILED_ATTEMPTS - 1)), fold)


def composed(sessions: Column) -> Column:
    """The locks of a user whose sessions' maps (``replays``) are run through in order from count 0."""
    begin = F.struct(F.lit(0).alias("count"), F.array().cast(_LOCKS).alias("locks"))

    def step(state: Column, session: Column) -> Column:
        taken = F.get(session["replays"], state["count"])
        locks = F.when(F.size(taken["locks"]) == 0, state["locks"]).otherwise(F.concat(state["locks"], taken["locks"]))
        return F.struct(taken["end"].alias("count"), locks.alias("locks"))

    return F.aggregate(sessions, begin, step, lambda s: s["locks"])


def lockout_replay(attempts: DataFrame, user: str = "user", ts: str = "ts", seq: str = "seq",
                   ok: str = "ok", max_session_rows: int = MAX_SESSION_ROWS) -> DataFrame:
    """Lock events ``(user, locked_at, locked_until, rejected_while_locked)``.

    Users whose sessions all have at most ``max_session_rows`` attempts are
    replayed session by session; users with a larger session go through
    ``_lockout_by_jumping``, which never puts one user's attempts in one task.
    Both give the same events: before any routing, attempts without a user or a
    time are left out, an attempt whose outcome is NULL counts as failed, and of
    one user's attempts of one time those without a sequence number come last.
    """
    ensure_checkpoint_dir(attempts.sparkSession)
    ts_type = attempts.schema[ts].dataType.simpleString()  # wall-clock (ntz) input stays wall-clock
    if ts_type not in ("timestamp", "timestamp_ntz"):
        ts_type = "timestamp"
    a = attempts.select(F.col(user).cast("string").alias("user"), F.col(ts).cast(ts_type).alias("ts"),
                        F.coalesce(F.col(seq).cast("bigint"), F.lit(_LAST_SEQ)).alias("seq"),
                        F.coalesce(F.col(ok).cast("boolean"), F.lit(False)).alias("ok"))
    a = a.where(F.col("user").isNotNull() & F.col("ts").isNotNull())
    a = a.withColumn("bucket", F.floor(_micros("ts", ts_type) / F.lit(_GAP_US)).cast("bigint"))
    buckets = a.groupBy("user", "bucket").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                                              F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user").orderBy("bucket")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev_last = F.lag("last_ts").over(w)
    gap = _micros("first_ts", ts_type) - _micros(prev_last, ts_type)
    new_session = F.when(prev_last.isNull() | (gap >= F.lit(_GAP_US)), F.lit(1)).otherwise(F.lit(0))
    sessions = buckets.withColumn("_new", new_session).select(
        "user", "bucket", "n", F.sum("_new").over(upto).cast("bigint").alias("session")).checkpoint()
    big = sessions.groupBy("user", "session").agg(F.sum("n").alias("rows")).where(
        F.col("rows") > F.lit(max_session_rows)).select("user").distinct().checkpoint()
    hot = None
    if not big.isEmpty():
        # routed rows, summed from the bucket summaries (no extra scan), size the range sort
        n_rows = sized_join(sessions, big, ["user"], "left_semi", written=True).agg(F.sum("n")).first()[0] or 0
        hot = _lockout_by_jumping(sized_join(a.drop("bucket"), big, ["user"], "left_semi", written=True), int(n_rows))
        a = sized_join(a, big, ["user"], "left_anti", written=True)  # hot users never reach the joins below
    tagged = sized_join(a, sessions, ["user", "bucket"], "inner", written=True)
    attempt = F.struct(_micros("ts", ts_type).alias("us"), "seq", "ok")
    # an array holds one session, of at most max_session_rows attempts
    replays = tagged.groupBy("user", "session").agg(F.sort_array(F.collect_list(attempt)).alias("attempts")).select(
        "user", F.struct("session", replayed(F.col("attempts")).alias("replays")).alias("session"))
    # an array holds the maps of one user's sessions, as many as quiet quarters of an hour lie between them
    locks = replays.groupBy("user").agg(composed(F.sort_array(F.collect_list("session"))).alias("locks"))
    out = locks.select("user", F.explode("locks").alias("lock")).select(
        "user", _from_micros(F.col("lock.locked_until") - F.lit(_GAP_US), ts_type).alias("locked_at"),
        _from_micros(F.col("lock.locked_until"), ts_type).alias("locked_until"),
        F.col("lock.rejected").alias("rejected_while_locked"))
    return out if hot is None else out.unionByName(hot)


def _lockout_by_jumping(a: DataFrame, n_rows: int = 0) -> DataFrame:
    """Exact lockout replay with no per-user group (for users with huge sessions).

    Attempts get a global rank ``g`` in (user, ts, seq) order (range-sorted,
    dense index). From "count 0 at attempt g" the next such point ``next(g)``
    depends only on attempts g..g+4: a success at g+k gives g+k+1; five
    failures lock the user at g+4 and ``next`` is the first attempt at or
    after the expiry (a rank in a globally sorted union of attempts and
    expiry times). The real trajectory is the path from each user's first
    attempt in this functional graph, found by pointer doubling: round k adds
    the nodes 2^k..2^(k+1)-1 steps ahead, so there are log2(path length)
    rounds of joins; each round is checkpointed to cut the lineage.
    """
    from .shuffle import dense_index, offsets_table

    spark = a.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_PER_PARTITION))
    srt = (a.select("user", "ts", "seq", "ok").repartitionByRange(parts, "user", "ts", "seq")
           .sortWithinPartitions("user", "ts", "seq").checkpoint())
    nodes, n = dense_index(srt, "g")
    nodes = nodes.checkpoint()
    bounds = nodes.groupBy("user").agg(F.min("g").alias("g0"), F.max("g").alias("g1"))

    # look-ahead: ok/ts of the next four attempts of the same user (index equi-join)
    ahead = nodes.select(F.col("user").alias("u2"), "g", "ok", "ts").withColumn(
        "d", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])))
    ahead = ahead.select((F.col("g") - F.col("d")).alias("g"), "d", "u2", F.col("ok").alias("okd"),
                         F.col("ts").alias("tsd"))
    la = nodes.select("g", "user").join(ahead, "g").where(F.col("user") == F.col("u2")).groupBy("g").agg(
        *[F.max(F.when(F.col("d") == i, F.col("okd").cast("int"))).alias(f"ok{i}") for i in range(1, 5)],
        F.max(F.when(F.col("d") == 4, F.col("tsd"))).alias("ts4"))
    # one row per routed user: broadcast when it fits, so no join is keyed by a hot user
    bounds = bounds.checkpoint()
    full = sized_join(nodes.join(la, "g", "left"), bounds, ["user"], "inner")
    okk = [F.col("ok").cast("int")] + [F.col(f"ok{i}") for i in range(1, 5)]
    nxt = F.lit(-1).cast("bigint")
    cond = F.lit(True)
    expr = None
    for k in range(5):
        step = cond & (okk[k] == 1)
        expr = F.when(step, F.col("g") + F.lit(k + 1)) if expr is None else expr.when(step, F.col("g") + F.lit(k + 1))
        cond = cond & (okk[k] == 0)
    is_lock = F.coalesce(cond, F.lit(False))
    lock_span = F.expr(f"INTERVAL {LOCKOUT_MINUTES} MINUTES")
    graph = full.select("user", "g", "g1", is_lock.alias("is_lock"), expr.otherwise(nxt).alias("nxt"),
                        F.col("ts4").alias("locked_at"), (F.col("ts4") + lock_span).alias("locked_until"))

    # expiry lookup: rank of the first attempt at or after locked_until
    targets = graph.where("is_lock").select("user", F.col("locked_until").alias("ts"), F.lit(0).alias("kind"),
                                             F.col("g").alias("ref"))
    union = targets.unionByName(nodes.select("user", "ts", F.lit(1).alias("kind"), F.col("seq").alias("ref")))
    union = (union.repartitionByRange(parts, "user", "ts", "kind", "ref")
             .sortWithinPartitions("user", "ts", "kind", "ref")
             .withColumn("pid", F.spark_partition_id()).checkpoint())
    offsets, _ = offsets_table(union.where("kind = 1"), "pid")

    def _running(batches):
        seen = 0
        for pdf in batches:
            att = pdf["kind"].to_numpy()
            before = att.cumsum() - att + seen
            seen += int(att.sum())
            yield pd.DataFrame({"pid": pdf["pid"], "kind": pdf["kind"], "ref": pdf["ref"], "before": before})

    ranked = union.select("pid", "kind", "ref").mapInPandas(_running, "pid int, kind int, ref long, before long")
    # attempts before a partition: those of the last counted partition at or before it (one small row each)
    every = union.select("pid").distinct().join(F.broadcast(offsets), "pid", "left")
    counted = union.where("kind = 1").count()
    after = sorted((r.pid, r._offset) for r in every.collect())
    known, filled = counted, []
    for pid, offset in reversed(after):  # a partition of expiry times only: what comes after it counts from its end
        known = offset if offset is not None else known
        filled.append((pid, known))
    starts = spark.createDataFrame(filled, "pid int, _offset bigint")
    expiry = ranked.where(F.col("kind") == 0).join(F.broadcast(starts), "pid").select(
        F.col("ref").alias("g"), (F.col("_offset") + F.col("before")).alias("first_after"))
    graph = graph.join(expiry, "g", "left").withColumn(
        "nxt", F.when(F.col("is_lock"), F.when(F.col("first_after") <= F.col("g1"), F.col("first_after"))
                      .otherwise(F.lit(-1))).otherwise(F.col("nxt")))
    graph = graph.withColumn("rejected", F.when(F.col("is_lock"), F.when(F.col("nxt") >= 0, F.col("nxt"))
                                                .otherwise(F.col("g1") + 1) - F.col("g") - F.lit(5)))
    graph = graph.checkpoint()

    # pointer doubling from each user's first attempt
    jump = graph.select("g", F.col("nxt").alias("j")).checkpoint()
    reached = bounds.select(F.col("g0").alias("g")).checkpoint()
    while True:
        hop = reached.join(jump, "g").where(F.col("j") >= 0).select(F.col("j").alias("g"))
        new = hop.join(reached, "g", "left_anti").checkpoint()
        if new.isEmpty():
            break
        reached = reached.unionByName(new).distinct().checkpoint()
        # finished nodes (j = -1) would all meet on one join key: they leave the joins for good
        open_ = jump.where(F.col("j") >= 0)
        jj = open_.select(F.col("g").alias("mid"), F.col("j").alias("j2"))
        jump = open_.join(jj, open_["j"] == jj["mid"]).select("g", F.col("j2").alias("j")).checkpoint()
    locks = graph.where("is_lock").join(reached, "g", "left_semi")
    return locks.select("user", "locked_at", "locked_until", F.col("rejected").alias("rejected_while_locked"))
