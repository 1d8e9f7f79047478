"""Differential-privacy operators (DP1-DP10).

Noise is added by built-in expressions on executors; the driver only keeps the
privacy accountant. Aggregate releases (count, sum, mean) add noise to the
*aggregated* row, so noise cost does not grow with the data. Charges are kept
as rows (dataset, column, mechanism, epsilon, delta) in a ledger table that all
runs share (DP8, ``operators.ledger``): an accountant that is given the ledger
refuses a release that would exceed the dataset's budget, whichever run spent it.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from ..functions.draws import LANES, named, row_key, with_uniforms
from ..functions.noise import (
    add_gaussian, add_laplace, fresh_seed, laplace_of, laplace_sample, randomized_response, truth_probability,
)
from ..session import ensure_checkpoint_dir
from .ledger import LEDGER_SCHEMA, BudgetExhausted, SharedLedger, read_charges, record  # noqa: F401


def validate_params(epsilon: float, delta: float) -> None:
    if epsilon <= 0:
        raise ValueError(f"epsilon has to be above 0, not {epsilon}")
    if delta < 0 or delta >= 1:
        raise ValueError(f"delta has to be at least 0 and below 1, not {delta}")


@dataclass
class PrivacyAccountant:
    """Tracks epsilon spent by releases; refuses a release once the budget is used.

    With ``shared``, every release is also admitted by the table that all runs share.
    """

    epsilon: float = 1.0
    delta: float = 1e-5
    dataset: str = "dataset"
    used: float = 0.0
    charges: list[tuple] = field(default_factory=list)
    shared: SharedLedger | None = None

    def __post_init__(self):
        validate_params(self.epsilon, self.delta)

    def exhausted(self) -> bool:
        # shares such as epsilon / 3 may add up to a little under epsilon
        return self.used >= self.epsilon * (1 - 1e-9)

    def charge(self, amount: float, mechanism: str, column: str | None = None) -> None:
        self.charge_all([(amount, mechanism, column)])

    def charge_all(self, parts: list[tuple[float, str, str | None]]) -> None:
        """One release of several charges: all of them, or none and an error."""
        if not parts:
            return
        if self.exhausted():
            raise BudgetExhausted(f"the privacy budget of {self.dataset} is exhausted: {self.used} of {self.epsilon} used")
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        rows = [(self.dataset, column, mechanism, float(amount), float(self.delta), now) for amount, mechanism, column in parts]
        if self.shared is not None:
            self.shared.admit(rows)
        self.used += sum(amount for amount, _, _ in parts)
        self.charges += rows

    def report(self) -> dict:
        return {"epsilon": self.epsilon, "delta": self.delta, "privacy_budget_used": self.used,
                "privacy_budget_remaining": max(0.0, self.epsilon - self.used),
                "budget_exhausted": self.exhausted()}

    def reset(self) -> None:
        self.used = 0.0

    def ledger(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.charges, LEDGER_SCHEMA)


def laplace_column(df: DataFrame, column: str, acct: PrivacyAccountant, sensitivity: float = 1.0,
                   seed: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """DP1: Laplace mechanism on a column; one charge of epsilon for the release.

    ``keys`` names columns that tell the rows apart: with them (here and below)
    a row's noise does not depend on the plan or partitioning.
    """
    acct.charge(acct.epsilon, "laplace", column)
    return df.withColumn(column, add_laplace(column, acct.epsilon, sensitivity, seed, _key(keys), column))


def gaussian_column(df: DataFrame, column: str, acct: PrivacyAccountant, sensitivity: float = 1.0,
                    seed: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """DP2: Gaussian mechanism on a column (needs delta > 0)."""
    acct.charge(acct.epsilon, "gaussian", column)
    return df.withColumn(column, add_gaussian(column, acct.epsilon, acct.delta, sensitivity, seed, _key(keys), column))


def _key(keys: list[str] | None) -> Column | None:
    return row_key(keys) if keys else None


def _group_key(group_cols: list[str]) -> Column:
    """Groups are told apart by their columns; a single group has an empty key."""
    return row_key(group_cols) if group_cols else F.lit("")


def noisy_count(df: DataFrame, group_cols: list[str], acct: PrivacyAccountant, sensitivity: float = 1.0,
                seed: int | None = None, name: str = "noisy_count") -> DataFrame:
    """DP3: per-group counts with Laplace noise, ``max(0, round(count + noise))``."""
    acct.charge(acct.epsilon, "noisy_count", ",".join(group_cols) or None)
    seed = fresh_seed() if seed is None else seed
    counts = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    noisy = F.col("_n").cast(DoubleType()) + laplace_sample(
        sensitivity / acct.epsilon, seed, _group_key(group_cols), name)
    return counts.select(*group_cols, F.greatest(F.lit(0), F.rint(noisy).cast("bigint")).alias(name))


def noisy_sum(df: DataFrame, column: str, acct: PrivacyAccountant, group_cols: list[str] | None = None,
              sensitivity: float | None = None, seed: int | None = None) -> DataFrame:
    """DP4: noisy sum; default sensitivity is the max absolute value (1.0 when empty)."""
    acct.charge(acct.epsilon, "noisy_sum", column)
    seed = fresh_seed() if seed is None else seed
    g = group_cols or []
    x = F.col(column).cast(DoubleType())
    st = df.groupBy(*g).agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("_s"), F.max(F.abs(x)).alias("_m"))
    sens = F.lit(float(sensitivity)) if sensitivity is not None else F.coalesce(F.col("_m"), F.lit(1.0))
    noise = sens / F.lit(acct.epsilon) * laplace_sample(1.0, seed, _group_key(g), named(["noisy_sum", column]))
    return st.select(*g, (F.col("_s") + noise).alias("noisy_sum"),
                     F.lit(sensitivity is None).alias("data_dependent_sensitivity"))


def noisy_mean(df: DataFrame, column: str, acct: PrivacyAccountant, group_cols: list[str] | None = None,
               sensitivity: float | None = None, seed: int | None = None) -> DataFrame:
    """DP5: noisy mean; default sensitivity (max-min)/n; an empty input gives 0.0 and is not charged."""
    seed = fresh_seed() if seed is None else seed
    g = group_cols or []
    x = F.col(column).cast(DoubleType())
    st = df.groupBy(*g).agg(F.avg(x).alias("_a"), F.min(x).alias("_lo"), F.max(x).alias("_hi"),
                            F.count(x).alias("_n"))
    if not df.select(x.alias("x")).where("x is not null").isEmpty():
        acct.charge(acct.epsilon, "noisy_mean", column)
    sens = F.lit(float(sensitivity)) if sensitivity is not None else (F.col("_hi") - F.col("_lo")) / F.col("_n")
    noise = sens / F.lit(acct.epsilon) * laplace_sample(1.0, seed, _group_key(g), named(["noisy_mean", column]))
    return st.select(*g, F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.col("_a") + noise).alias("noisy_mean"),
                     F.lit(sensitivity is None).alias("data_dependent_sensitivity"))


def randomized_response_column(df: DataFrame, column: str, epsilon: float = 1.0, p: float | None = None,
                               seed: int | None = None, name: str | None = None,
                               keys: list[str] | None = None) -> DataFrame:
    """DP6: randomized response on a boolean column (no budget charge)."""
    return df.withColumn(name or column, randomized_response(column, epsilon, p, seed, _key(keys), column))


def randomized_response_estimate(df: DataFrame, column: str, epsilon: float = 1.0, p: float | None = None,
                                 group_cols: list[str] | None = None) -> DataFrame:
    """Debiased estimate of the true-rate of a randomized boolean column."""
    p = truth_probability(epsilon) if p is None else p
    g = group_cols or []
    obs = F.avg(F.col(column).cast("double"))
    return df.groupBy(*g).agg(obs.alias("observed_rate"), F.count(column).alias("n")).withColumn(
        "estimated_rate", (F.col("observed_rate") + F.lit(p - 1.0)) / F.lit(2 * p - 1.0))


def _numeric_or_fail(df: DataFrame, column: str) -> None:
    dt = df.schema[column].dataType
    if not isinstance(dt, NumericType):
        raise TypeError(f"differential privacy needs a numeric column; '{column}' is {dt.simpleString()}")


def _with_column_noise(df: DataFrame, columns: list[str], acct: PrivacyAccountant,
                       sensitivity: dict[str, float] | None, seed: int | None, split_budget: bool,
                       keys: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with noise on the listed columns it has, charged as one release, and those columns."""
    sensitivity = sensitivity or {}
    present = [c for c in dict.fromkeys(columns) if c in df.columns]
    for c in present:
        _numeric_or_fail(df, c)
    seed = fresh_seed() if seed is None else seed
    eps_col = acct.epsilon / len(columns) if split_budget and columns else acct.epsilon
    acct.charge_all([(acct.epsilon / len(columns), "laplace_column", c) for c in present])
    if not keys:
        return df.withColumns({c: add_laplace(c, eps_col, sensitivity.get(c, 1.0), seed, name=named(["columns", c]))
                               for c in present}), present
    out, key = df, "__key"
    if present:  # a key column may be noisy itself
        out = out.withColumn(key, row_key(keys))
    for i in range(0, len(present), LANES):
        # six columns share a digest that is named by all of them, so that no other list of columns has it
        part = present[i : i + LANES]
        out, draws = with_uniforms(out, F.col(key), seed, named(["columns", *part]), len(part))
        out = out.withColumns({c: F.col(c).cast(DoubleType()) + laplace_of(F.col(u), sensitivity.get(c, 1.0) / eps_col)
                               for c, u in zip(part, draws)}).drop(*draws)
    return out.drop(key), present


def dp_columns(df: DataFrame, columns: list[str], acct: PrivacyAccountant,
               sensitivity: dict[str, float] | None = None, seed: int | None = None,
               split_budget: bool = False, keys: list[str] | None = None) -> DataFrame:
    """DP7: Laplace noise on every non-null cell of the listed columns.

    Missing columns are skipped. Each column is charged ``epsilon/n`` once
    (not once per cell); the noise scale is ``sens/epsilon``, or
    ``sens/(epsilon/n)`` with ``split_budget=True``.
    """
    return _with_column_noise(df, columns, acct, sensitivity, seed, split_budget, keys)[0]


def append_charges(acct: PrivacyAccountant, spark: SparkSession, path: str) -> int:
    """Record charges of an accountant without a shared ledger in the ledger table at ``path``."""
    if acct.charges:
        record(spark, path, acct.charges)
    return len(acct.charges)


def budget_ledger(charges: DataFrame, budgets: DataFrame) -> DataFrame:
    """DP8: per dataset, epsilon spent across all recorded charges vs its budget."""
    spent = charges.groupBy("dataset").agg(F.sum("epsilon").alias("privacy_budget_used"),
                                           F.count(F.lit(1)).alias("charges"))
    j = budgets.join(spent, "dataset", "left")
    used = F.coalesce(F.col("privacy_budget_used"), F.lit(0.0))
    return j.select(
        "dataset", F.col("epsilon"), used.alias("privacy_budget_used"),
        F.greatest(F.lit(0.0), F.col("epsilon") - used).alias("privacy_budget_remaining"),
        (used >= F.col("epsilon")).alias("budget_exhausted"),
        F.coalesce(F.col("charges"), F.lit(0)).cast("bigint").alias("charges"),
    )


def adaptive_noise(df: DataFrame, column: str, epsilon: float = 1.0, delta: float = 1e-5,
                   min_value: float | None = None, max_value: float | None = None,
                   seed: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """DP9: sensitivity (max-min)/n from the data (or given bounds), result clamped.

    One aggregate job computes the bounds; all-null columns are returned unchanged.
    """
    validate_params(epsilon, delta)
    _numeric_or_fail(df, column)
    x = F.col(column).cast(DoubleType())
    st = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    if not st["n"]:
        return df
    lo = float(st["lo"]) if min_value is None else float(min_value)
    hi = float(st["hi"]) if max_value is None else float(max_value)
    sens = (hi - lo) / int(st["n"])
    noisy = add_laplace(column, epsilon, sens, seed, _key(keys), column)
    return df.withColumn(column, F.when(x.isNull(), x).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), noisy))))


COMPARISON = "column string, original_mean double, noisy_mean double, absolute_error double"


def compare_means(original: DataFrame, published: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, the means of the original and of the published table (one aggregation of each)."""
    cols = [c for c in columns if c in original.columns and c in published.columns]
    if not cols:
        return original.sparkSession.createDataFrame([], COMPARISON)

    def means(df: DataFrame, prefix: str) -> DataFrame:
        return df.agg(*[F.avg(F.col(c).cast(DoubleType())).alias(f"{prefix}{i}") for i, c in enumerate(cols)])

    both = means(original, "o").crossJoin(means(published, "n"))  # one row each
    return both.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("original_mean"), F.col(f"n{i}").alias("noisy_mean"),
                 F.abs(F.col(f"o{i}") - F.col(f"n{i}")).alias("absolute_error")) for i, c in enumerate(cols)])))


def dp_dataset(df: DataFrame, columns: list[str], epsilon: float = 1.0, delta: float = 1e-5,
               sensitivities: dict[str, float] | None = None, seed: int | None = None,
               dataset: str = "dataset", keys: list[str] | None = None) -> tuple[DataFrame, dict, DataFrame]:
    """DP10: DP7 plus a per-column comparison of original and noisy means.

    Returns (noisy frame, budget report, comparison frame). With ``keys`` the
    noise belongs to the row, so the comparison holds for every computation of
    the noisy frame. Without them the noisy frame is checkpointed, and the
    comparison and all later reads use those rows.
    """
    acct = PrivacyAccountant(epsilon, delta, dataset)
    noisy, present = _with_column_noise(df, columns, acct, sensitivities, seed, False, keys)
    if present and not keys:
        ensure_checkpoint_dir(df.sparkSession)
        noisy = noisy.checkpoint()
    report = acct.report() | {"epsilon_composed": acct.epsilon * len(present)}
    return noisy, report, compare_means(df, noisy, present)
