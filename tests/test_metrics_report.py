import math
from collections import Counter

from pyspark.sql import functions as F

from veilframe.operators import metrics, report


def test_k_metrics_and_histogram(spark, staff):
    m = metrics.k_metrics(staff, ["department"], 3).first()
    assert m.k_value == 3 and m.satisfies_k_anonymity and m.num_groups == 4 and m.max_group_size == 5
    h = {r.group_size: r.num_groups for r in metrics.group_size_histogram(staff, ["department"]).collect()}
    assert h == {5: 1, 4: 1, 3: 2}
    # requested k is honoured (the reference always compared with 2)
    assert not metrics.k_metrics(staff, ["department"], 4).first().satisfies_k_anonymity
    empty = metrics.k_metrics(staff.limit(0), ["department"], 2).first()
    assert empty.k_value == 0 and not empty.satisfies_k_anonymity and empty.num_groups == 0
    noqi = metrics.k_metrics(staff, [], 2).first()
    assert noqi.num_groups == 1 and noqi.k_value == 15


def test_l_metrics(spark, staff):
    m = metrics.l_metrics(staff, ["department"], "diagnosis", 2).first()
    assert m.min_diversity == 1 and not m.satisfies_l_diversity
    assert m.groups_satisfying_l == 3 and m.groups_not_satisfying_l == 1
    e = metrics.l_metrics(staff.limit(0), ["department"], "diagnosis", 2).first()
    assert e.l_value == 0 and not e.satisfies_l_diversity


def test_entropy_matches_definition(spark, staff):
    rows = {r.column: r.entropy for r in metrics.column_entropy(staff, ["department", "diagnosis", "nope"]).collect()}
    for col in ("department", "diagnosis"):
        vals = [r[col] for r in staff.collect()]
        n = len(vals)
        exp = -sum(c / n * math.log2(c / n) for c in Counter(vals).values())
        assert abs(rows[col] - exp) < 1e-12
    assert rows["nope"] == 0.0


def test_distinctness_and_risk(spark, staff):
    d = metrics.distinctness(staff, ["department"]).first()[0]
    assert abs(d - 4 / 15) < 1e-12
    r = metrics.reidentification_risk(staff, ["department"]).first()
    assert r.records_at_high_risk + r.records_at_medium_risk + r.records_at_low_risk == 15
    assert r.records_at_high_risk == 6 and r.records_at_medium_risk == 9  # sizes 3,3 high; 4,5 medium
    assert abs(r.avg_risk - (1 / 5 + 1 / 4 + 1 / 3 + 1 / 3) / 4) < 1e-12
    rr = metrics.record_risk(staff, ["department"]).where(F.col("department") == "Sales").first()
    assert abs(rr.reid_risk - 1 / 3) < 1e-12


def test_risk_buckets_exclude_null_qi(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "a int")
    r = metrics.reidentification_risk(df, ["a"]).first()
    assert r.records_at_high_risk == 2 and abs(r.high_risk_percentage - 200 / 3) < 1e-9


def test_retention_and_numeric_error(spark):
    o = spark.createDataFrame([(25, 50000, "A"), (30, 60000, "B"), (35, 70000, "A"), (40, 80000, "C")],
                              "age int, salary int, diagnosis string")
    a = spark.createDataFrame([(25, 50500, "A"), (30, 60500, "B"), (35, 70500, "A"), (40, 80500, "C")], o.schema)
    ret = report.data_retention(o, a).first()
    assert ret.retention_rate_pct == 100.0 and ret.suppressed_records == 0
    ne = {r.column: r for r in report.numeric_error(o, a, ["salary", "missing"]).collect()}
    assert set(ne) == {"salary"} and abs(ne["salary"].absolute_error - 500) < 1e-9
    assert abs(ne["salary"].relative_error_pct - 500 / 65000 * 100) < 1e-9
    il = {r.column: r for r in report.information_loss(o, a).collect()}
    assert abs(il["diagnosis"].information_loss_pct) < 1e-12


def test_full_report_and_recommendation(spark, staff):
    from veilframe.operators.classes import apply_k_and_l
    anon, _ = apply_k_and_l(staff, ["age", "department"], "diagnosis", 3, 2)
    rep, row = report.full_report(staff, anon, ["age", "department"], "diagnosis", ["salary"], 3, 2)
    assert set(rep) == {"timestamp", "privacy_metrics", "utility_metrics", "summary"}
    assert rep["privacy_metrics"]["k_anonymity"]["satisfies_k_anonymity"]
    assert rep["utility_metrics"]["data_retention"]["anonymized_records"] == 8
    long = {(x.section, x.metric, x.column): x.value for x in report.report_long(rep, anon, ["age", "department"]).collect()}
    assert long["k_anonymity", "required_k", None] == "3" and long["l_diversity", "required_l", None] == "2"
    assert ("numeric_error", "absolute_error", "salary") in long and ("information_loss", "information_loss_pct", "age") in long
    assert sum(int(s) * int(n) for (_, m, s), n in long.items() if m == "group_size") == 8
    r = row.first()
    assert r.anonymized_records == 8 and r.dashboard_risk_score == 20
    assert r.recommendation.startswith("All privacy requirements met")  # retention 53.3% >= 50


def test_recommendation_texts(spark):
    df = spark.createDataFrame([(False, False, 12.25, 40.0), (True, True, 0.0, 100.0)], "k boolean, l boolean, h double, r double")
    out = [x.t for x in df.select(report.recommendation(F.col("k"), F.col("l"), F.col("h"), F.col("r")).alias("t")).collect()]
    assert out[0] == ("CRITICAL: k-anonymity not satisfied. Increase generalization or suppression. "
                      "WARNING: l-diversity not satisfied. Consider data augmentation or suppression. "
                      "ALERT: 12.2% of records at high re-identification risk. "
                      "WARNING: Low data retention (40.0%). Consider less aggressive anonymization.")
    assert out[1].startswith("All privacy requirements met")
