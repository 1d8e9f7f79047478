"""Straight sequential lockout replay (pandas), which the operators are compared with."""

import pandas as pd

LOCK, FAILURES = pd.Timedelta(minutes=15), 5  # the rule, stated apart from the operator


def walk(times, outcomes):
    """[locked_at, locked_until, rejected] of one user's attempts in order."""
    count, until, locks = 0, None, []
    for t, good in zip(times, outcomes):
        if until is not None:
            if t < until:
                locks[-1][2] += 1
                continue
            count, until = 0, None
        count = 0 if good else count + 1
        if count >= FAILURES:
            until = t + LOCK
            locks.append([t, until, 0])
    return locks


def lockout_replay_reference(attempts: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for u, g in attempts.sort_values(["user", "ts", "seq"], kind="mergesort").groupby("user", sort=True):
        locks = walk(list(g["ts"]), [bool(x) if x is not None else False for x in g["ok"]])
        rows += [(str(u), at, until, rej) for at, until, rej in locks]
    return pd.DataFrame(rows, columns=["user", "locked_at", "locked_until", "rejected_while_locked"])
