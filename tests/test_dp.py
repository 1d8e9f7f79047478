import datetime as dt
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.functions.draws import LANES, keyed_uniform
from veilframe.operators import dp
from veilframe.operators.ledger import BudgetExhausted, SharedLedger, read_charges, record


def test_parameter_rules():
    with pytest.raises(ValueError):
        dp.PrivacyAccountant(0.0)
    with pytest.raises(ValueError):
        dp.PrivacyAccountant(1.0, 1.0)
    dp.PrivacyAccountant(1.0, 0.0)


def test_budget_is_charged_once_per_release_and_refused_when_used(spark):
    acct = dp.PrivacyAccountant(1.0, 1e-5)
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    dp.laplace_column(df, "v", acct, seed=1).count()
    assert acct.report()["budget_exhausted"] and acct.used == 1.0
    with pytest.raises(ValueError, match="exhausted"):
        dp.laplace_column(df, "v", acct, seed=2)
    acct.reset()
    assert acct.report()["privacy_budget_remaining"] == 1.0


def test_dp_columns_any_row_count(spark):
    acct = dp.PrivacyAccountant(1.0, 1e-5)
    df = spark.createDataFrame([(25.0, 1.0), (30.0, 2.0), (35.0, None), (40.0, 4.0), (45.0, 5.0)], "age double, x double")
    out = dp.dp_columns(df, ["age", "x", "missing"], acct, {"age": 1.0}, seed=3).collect()
    assert len(out) == 5 and out[2].x is None
    assert abs(acct.used - 2 / 3) < 1e-12 and len(acct.charges) == 2  # epsilon / n per present column, as recorded by the reference
    assert all(r.age != v for r, v in zip(out, [25.0, 30.0, 35.0, 40.0, 45.0]))


def test_dp_on_text_column_is_an_analysis_error(spark):
    df = spark.createDataFrame([("18-29",)], "age string")
    with pytest.raises(TypeError):
        dp.dp_columns(df, ["age"], dp.PrivacyAccountant(), seed=1)


def test_noisy_count_sum_mean(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 100).cast("double").alias("v"))
    acct = dp.PrivacyAccountant(10.0)
    cnt = {r.g: r.noisy_count for r in dp.noisy_count(df, ["g"], acct, seed=4).collect()}
    assert all(c >= 0 and abs(c - 3333) < 20 for c in cnt.values())
    s = dp.noisy_sum(df, "v", dp.PrivacyAccountant(1.0), seed=5).first()
    assert abs(s.noisy_sum - 495000) < 2000 and s.data_dependent_sensitivity
    m = dp.noisy_mean(df, "v", dp.PrivacyAccountant(1.0), seed=6).first()
    assert abs(m.noisy_mean - 49.5) < 1.0
    empty = dp.noisy_mean(df.limit(0), "v", dp.PrivacyAccountant(1.0), seed=6).collect()
    assert empty == [] or empty[0].noisy_mean == 0.0


def test_randomized_response_rate_and_debias(spark):
    df = spark.range(200_000).select((F.col("id") % 10 < 3).alias("t"))
    rr = dp.randomized_response_column(df, "t", epsilon=1.0, seed=8)
    est = dp.randomized_response_estimate(rr, "t", epsilon=1.0).first()
    p = math.exp(1) / (1 + math.exp(1))
    assert abs(est.observed_rate - (0.3 * p + 0.7 * (1 - p))) < 0.01
    assert abs(est.estimated_rate - 0.3) < 0.02


def test_adaptive_noise_is_clamped(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)] + [(None,)], "v double")
    out = dp.adaptive_noise(df, "v", epsilon=0.01, seed=9).collect()
    vals = [r.v for r in out if r.v is not None]
    assert min(vals) >= 0.0 and max(vals) <= 49.0 and out[-1].v is None
    allnull = spark.createDataFrame([(None,)], "v double")
    assert dp.adaptive_noise(allnull, "v", seed=1).first().v is None


def test_ledger(spark):
    charges = spark.createDataFrame([("a", "x", "m", 0.4, 1e-5), ("a", "y", "m", 0.7, 1e-5), ("b", "x", "m", 0.2, 1e-5)],
                                    "dataset string, column string, mechanism string, epsilon double, delta double")
    budgets = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "dataset string, epsilon double")
    rows = {r.dataset: r for r in dp.budget_ledger(charges, budgets).collect()}
    assert rows["a"].budget_exhausted and rows["a"].privacy_budget_remaining == 0.0
    assert not rows["b"].budget_exhausted and abs(rows["b"].privacy_budget_remaining - 0.8) < 1e-12
    assert rows["c"].charges == 0
    acct = dp.PrivacyAccountant(1.0)
    dp.noisy_count(charges, ["dataset"], acct, seed=1)
    assert acct.ledger(spark).count() == 1


def test_ledger_accumulates_across_runs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    for _ in range(3):  # three separate runs, each with its own accountant
        acct = dp.PrivacyAccountant(0.5, 1e-5, "sales")
        dp.laplace_column(df, "v", acct, seed=1)
        assert dp.append_charges(acct, spark, path) == 1
    budgets = spark.createDataFrame([("sales", 1.0)], "dataset string, epsilon double")
    row = dp.budget_ledger(dp.read_charges(spark, path), budgets).first()
    assert row.charges == 3 and abs(row.privacy_budget_used - 1.5) < 1e-12 and row.budget_exhausted


def test_dataset_report(spark):
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(1000)], "a double, b double")
    noisy, rep, comp = dp.dp_dataset(df, ["a", "b"], 1.0, seed=10)
    c = {r.column: r for r in comp.collect()}
    assert abs(c["a"].original_mean - 499.5) < 1e-9 and c["a"].absolute_error < 1.0
    assert rep["epsilon"] == 1.0
    assert noisy.count() == 1000


def test_column_noise_is_refused_when_the_budget_is_used(spark):
    acct = dp.PrivacyAccountant(1.0)
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    dp.dp_columns(df, ["a", "b", "c"], acct, seed=1)  # three thirds add up to a little under one
    with pytest.raises(BudgetExhausted):
        dp.dp_columns(df, ["a"], acct, seed=2)
    assert len(acct.charges) == 3 and acct.report()["budget_exhausted"]


def test_one_seed_gives_columns_and_mechanisms_their_own_noise(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0)], "id int, a double, b double")
    sums = [dp.noisy_sum(df, c, dp.PrivacyAccountant(), sensitivity=1.0, seed=7).first().noisy_sum for c in ("a", "b")]
    means = [dp.noisy_mean(df, c, dp.PrivacyAccountant(), sensitivity=1.0, seed=7).first().noisy_mean for c in ("a", "b")]
    both = dp.dp_columns(df, ["a", "b"], dp.PrivacyAccountant(), seed=7, keys=["id"]).first()
    alone = dp.dp_columns(df, ["a"], dp.PrivacyAccountant(), seed=7, keys=["id"]).first()
    other = dp.dp_columns(df, ["b"], dp.PrivacyAccountant(), seed=7, keys=["id"]).first()
    draws = [*sums, *means, both.a, both.b, alone.a, other.b]
    assert len({round(x, 9) for x in draws}) == len(draws)


def test_different_keys_never_share_a_draw(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, ""), ("", None), ("", ""), (None, None), ("1:a", "b"), ("1", ":ab"), ("-", "-")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("v", F.lit(0.0))
    out = dp.dp_columns(df, ["v"], dp.PrivacyAccountant(), seed=3, keys=["a", "b"]).collect()
    assert len({r.v for r in out}) == len(rows)


def test_draws_of_one_digest_are_uniform_and_independent(spark):
    df = spark.range(40_000).select(*[keyed_uniform(F.col("id").cast("string"), 5, "n", lane).alias(f"u{lane}") for lane in range(LANES)])
    u = df.toPandas().to_numpy()
    assert abs(u.mean(0) - 0.5).max() < 0.01 and abs(u.var(0) - 1 / 12).max() < 0.002
    corr = np.corrcoef(u.T) - np.eye(LANES)
    assert abs(corr).max() < 0.02 and (u > 0).all() and (u < 1).all()
    tenths = np.stack([np.bincount((u[:, i] * 10).astype(int), minlength=10) for i in range(LANES)])
    assert tenths.min() > 3700 and tenths.max() < 4300


def _charge(dataset, epsilon):
    return [(dataset, "c", "m", epsilon, 1e-5, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))]


def test_runs_that_share_a_ledger_stay_within_its_budget(spark, tmp_path):
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([(1, 1.0)], "id int, v double")

    def accountant(dataset="people"):
        return dp.PrivacyAccountant(0.6, dataset=dataset, shared=SharedLedger(spark, path, 1.0))

    dp.noisy_count(df, [], accountant(), seed=1)
    with pytest.raises(BudgetExhausted, match="all runs"):
        dp.dp_columns(df, ["v"], accountant(), seed=1, keys=["id"])
    refused = accountant()
    with pytest.raises(BudgetExhausted):
        dp.noisy_sum(df, "v", refused, seed=1)
    assert refused.used == 0 and not refused.charges  # a refused release is charged nowhere
    dp.noisy_count(df, [], accountant("other"), seed=1)  # another dataset has its own budget
    spent = {r.dataset: r.epsilon for r in read_charges(spark, path).groupBy("dataset").agg(F.sum("epsilon").alias("epsilon")).collect()}
    assert spent == {"people": 0.6, "other": 0.6}


def test_claims_written_at_the_same_time(spark, tmp_path):
    """A claim that another run wrote before we read counts, whichever is older; the newer of the two gives way."""
    path = str(tmp_path / "ledger")
    ledger = SharedLedger(spark, path, 1.0, patience=0.0)
    old, new = _charge("d", 0.7), _charge("d", 0.7)
    record(spark, path, [(*new[0][:5], dt.datetime(2999, 1, 1))], "newer")
    with pytest.raises(BudgetExhausted):
        ledger.admit(old)  # older, but the newer one has not withdrawn in time
    record(spark, path, [("d", None, None, 0.0, 0.0, dt.datetime(2999, 1, 1))], "newer", "withdrawn")
    assert ledger.admit(old)
    with pytest.raises(BudgetExhausted):
        ledger.admit(_charge("d", 0.7))
    assert [r.epsilon for r in ledger.live_claims("d")] == [0.7]


def test_many_threads_never_exceed_the_budget(spark, tmp_path):
    path = str(tmp_path / "ledger")
    admitted = []

    def one(_):
        try:
            admitted.append(SharedLedger(spark, path, 1.0, patience=20.0, pause=0.1).admit(_charge("d", 0.4)))
        except BudgetExhausted:
            pass

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(one, range(4)))
    live = SharedLedger(spark, path, 1.0).live_claims("d")
    assert 1 <= len(admitted) <= 2 and {r.claim for r in live} == set(admitted)
