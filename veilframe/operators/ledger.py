"""The privacy ledger that all runs share (DP8): charges as rows, admitted by reservation.

A run that wants to release writes its charges as a *claim* into a folder of its
own below the ledger's path, then reads all claims. If all live claims of the
dataset, its own included, fit the budget, it may release. If not, the newest
claim gives way: it is withdrawn (a row of its own again) and the release is
refused; an older one waits for the newer to withdraw and reads again. As every
claim is written before anything is read, of two runs at least one sees the
other, so no interleaving admits claims beyond the budget. A claim whose run
died stays charged, which errs on the side of privacy.

Claims are a few rows a run. Deciding aggregates them to one row per claim of
one dataset.
"""

from __future__ import annotations

import datetime as _dt
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = "dataset string, column string, mechanism string, epsilon double, delta double, charged_at timestamp"
_EVENT_SCHEMA = f"claim string, kind string, {LEDGER_SCHEMA}"


class BudgetExhausted(ValueError):
    """A release that the privacy budget doesn't allow."""


@dataclass
class SharedLedger:
    """The ledger table at ``path``, with one budget for a dataset."""

    spark: SparkSession
    path: str
    budget: float
    #: Seconds an older claim waits for newer ones to withdraw, and between looks.
    patience: float = 30.0
    pause: float = 0.5

    def admit(self, rows: list[tuple]) -> str:
        """Claim charges (rows of ``LEDGER_SCHEMA``, one dataset); the claim's id, or BudgetExhausted."""
        dataset, claim = rows[0][0], uuid.uuid4().hex
        record(self.spark, self.path, rows, claim)
        until = time.monotonic() + self.patience
        while True:
            live = self.live_claims(dataset)
            total = sum(r.epsilon for r in live)
            if total <= self.budget * (1 + 1e-9):
                return claim
            newest = max(live, key=lambda r: (r.claimed_at, r.claim))
            if newest.claim == claim or time.monotonic() >= until:
                record(self.spark, self.path, [(dataset, None, None, 0.0, 0.0, _now())], claim, "withdrawn")
                raise BudgetExhausted(f"the privacy budget of {dataset} is exhausted: {total - sum(r[3] for r in rows)} of {self.budget} used by all runs")
            time.sleep(self.pause)

    def live_claims(self, dataset: str) -> list:
        """(claim, epsilon, claimed_at) of the claims of a dataset that are not withdrawn."""
        events = read_events(self.spark, self.path).where(F.col("dataset") == dataset)
        claims = events.groupBy("claim").agg(F.sum("epsilon").alias("epsilon"), F.min("charged_at").alias("claimed_at"),
                                             F.bool_or(F.col("kind") == "withdrawn").alias("withdrawn"))
        return claims.where(~F.col("withdrawn")).collect()


def record(spark: SparkSession, path: str, rows: list[tuple], claim: str | None = None, kind: str = "claim") -> None:
    """Write one event. Each has a folder of its own: appends of several runs to one folder would share its temporary files."""
    claim = claim or uuid.uuid4().hex
    events = spark.createDataFrame([(claim, kind, *r) for r in rows], _EVENT_SCHEMA)
    events.coalesce(1).write.parquet(os.path.join(path, f"event={claim}-{kind}"))


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All claims and withdrawals."""
    return spark.read.schema(f"{_EVENT_SCHEMA}, event string").parquet(path).drop("event")


def read_charges(spark: SparkSession, path: str) -> DataFrame:
    """The charges of all runs that were not withdrawn."""
    events = read_events(spark, path)
    withdrawn = events.where("kind = 'withdrawn'").select("claim")
    return events.where("kind = 'claim'").join(withdrawn, "claim", "left_anti").drop("claim", "kind")
