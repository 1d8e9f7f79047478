"""Utility metrics (U1-U3), the full privacy/utility report (U4), the
recommendation text (U5) and the dashboard risk score (U6).

The report reads the anonymised frame's class table once (one group-by that
yields k, l, distinctness and risk figures together) and stacks all columns
of both frames for the entropy comparison (one shuffle for every column).
Only scalar figures reach the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DoubleType, LongType, NumericType, StringType, StructField, StructType,
)

from ..functions.generalize import python_round
from .classes import DIVERSITY, SIZE, qi_present
from .metrics import (
    HIGH_RISK_THRESHOLD, MEDIUM_RISK_THRESHOLD, entropy_from_counts, group_size_histogram, stacked_values,
)

# Fixed recommendation texts and thresholds of the report.
REC_K_FAIL = "CRITICAL: k-anonymity not satisfied. Increase generalization or suppression."
REC_L_FAIL = "WARNING: l-diversity not satisfied. Consider data augmentation or suppression."
REC_HIGH_RISK = "ALERT: {pct}% of records at high re-identification risk."
REC_LOW_RETENTION = "WARNING: Low data retention ({pct}%). Consider less aggressive anonymization."
REC_READY = "All privacy requirements met with acceptable utility. Dataset is ready for sharing."
HIGH_RISK_PCT_LIMIT = 10.0
RETENTION_PCT_LIMIT = 50.0
DASHBOARD_RISK_OK = 20
DASHBOARD_RISK_FAIL = 80


def common_columns(original: DataFrame, anonymized: DataFrame) -> list[str]:
    """Columns present in both frames, in the original frame's order."""
    other = set(anonymized.columns)
    return [c for c in original.columns if c in other]


def information_loss(original: DataFrame, anonymized: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column entropy before/after and loss % (0 when the original entropy is 0)."""
    cols = common_columns(original, anonymized) if columns is None else [
        c for c in columns if c in original.columns and c in anonymized.columns]
    both = stacked_values(original, cols, "o").unionByName(stacked_values(anonymized, cols, "a"))
    counts = both.groupBy("frame", "pos", "value").agg(F.count(F.lit(1)).alias("n"))
    ent = entropy_from_counts(counts, ["frame", "pos"])
    per = ent.groupBy("pos").agg(
        F.max(F.when(F.col("frame") == "o", F.col("entropy"))).alias("original_entropy"),
        F.max(F.when(F.col("frame") == "a", F.col("entropy"))).alias("anonymized_entropy"),
    )
    names = original.sparkSession.createDataFrame([(c, i) for i, c in enumerate(cols)], "column string, pos int")
    o = F.coalesce(F.col("original_entropy"), F.lit(0.0))
    a = F.coalesce(F.col("anonymized_entropy"), F.lit(0.0))
    return names.join(per, "pos", "left").select(
        "column", "pos", o.alias("original_entropy"), a.alias("anonymized_entropy"),
        F.when(o > 0, (o - a) / o * 100.0).otherwise(F.lit(0.0)).alias("information_loss_pct"),
    )


def _column_stats(df: DataFrame, cols: list[str], tag: str) -> DataFrame:
    aggs = []
    for c in cols:
        x = F.col(c).cast(DoubleType())
        x = F.when(~F.isnan(x), x)
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_samp(x).alias(f"s_{c}"), F.count(x).alias(f"n_{c}")]
    row = df.agg(*aggs)
    stack = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"),
                 F.col(f"s_{c}").alias("std"), F.col(f"n_{c}").alias("n"))
        for c in cols
    ])
    return row.select(F.inline(stack)).withColumn("frame", F.lit(tag))


def numeric_error(original: DataFrame, anonymized: DataFrame, numeric_columns: list[str]) -> DataFrame:
    """Means, absolute and relative error, sample std of both frames, per column.

    Columns missing from either frame or empty in either are skipped.
    """
    cols = [c for c in numeric_columns if c in original.columns and c in anonymized.columns]
    for c in cols:
        for frame in (original, anonymized):
            if not isinstance(frame.schema[c].dataType, NumericType):
                raise TypeError(f"column '{c}' is not numeric ({frame.schema[c].dataType.simpleString()})")
    schema = "column string, original_mean double, anonymized_mean double, absolute_error double, " \
             "relative_error_pct double, original_std double, anonymized_std double"
    if not cols:
        return original.sparkSession.createDataFrame([], schema)
    st = _column_stats(original, cols, "o").unionByName(_column_stats(anonymized, cols, "a"))
    per = st.groupBy("column").agg(
        F.max(F.when(F.col("frame") == "o", F.col("mean"))).alias("original_mean"),
        F.max(F.when(F.col("frame") == "a", F.col("mean"))).alias("anonymized_mean"),
        F.max(F.when(F.col("frame") == "o", F.col("std"))).alias("original_std"),
        F.max(F.when(F.col("frame") == "a", F.col("std"))).alias("anonymized_std"),
        F.max(F.when(F.col("frame") == "o", F.col("n"))).alias("n_o"),
        F.max(F.when(F.col("frame") == "a", F.col("n"))).alias("n_a"),
    ).where((F.col("n_o") > 0) & (F.col("n_a") > 0))
    abs_err = F.abs(F.col("original_mean") - F.col("anonymized_mean"))
    return per.select(
        "column", "original_mean", "anonymized_mean", abs_err.alias("absolute_error"),
        F.when(F.col("original_mean") != 0, abs_err / F.col("original_mean") * 100.0)
        .otherwise(F.lit(0.0)).alias("relative_error_pct"),
        "original_std", "anonymized_std",
    )


def data_retention(original: DataFrame, anonymized: DataFrame) -> DataFrame:
    """Record counts, suppressed records, retention and suppression %."""
    counts = original.select(F.lit("o").alias("f")).unionByName(anonymized.select(F.lit("a").alias("f")))
    c = counts.agg(F.count_if(F.col("f") == "o").alias("o"), F.count_if(F.col("f") == "a").alias("a"))
    return c.select(
        F.col("o").alias("original_records"), F.col("a").alias("anonymized_records"),
        (F.col("o") - F.col("a")).alias("suppressed_records"),
        F.when(F.col("o") > 0, F.col("a") / F.col("o") * 100.0).otherwise(F.lit(0.0)).alias("retention_rate_pct"),
        F.when(F.col("o") > 0, (F.col("o") - F.col("a")) / F.col("o") * 100.0).otherwise(F.lit(0.0))
        .alias("suppression_rate_pct"),
    )


def class_metrics(df: DataFrame, qi: list[str], sensitive: str | None, k: int, l: int) -> DataFrame:
    """M1 + M3 + M5 + M6 in one group-by over the QI columns (one row out)."""
    aggs = [F.count(F.lit(1)).alias(SIZE)]
    if sensitive:
        aggs.append(F.count_distinct(sensitive).alias(DIVERSITY))
    groups = df.groupBy(*qi).agg(*aggs).withColumn("in_class", qi_present(qi))
    size = F.when(F.col("in_class"), F.col(SIZE))
    risk = F.lit(1.0) / size
    out = [
        F.sum(SIZE).alias("total"),
        F.count(size).alias("num_groups"),
        F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.avg(size).alias("avg_size"),
        F.avg(risk).alias("avg_risk"), F.max(risk).alias("max_risk"), F.min(risk).alias("min_risk"),
        F.sum(F.when(risk > HIGH_RISK_THRESHOLD, size)).alias("high"),
        F.sum(F.when((risk > MEDIUM_RISK_THRESHOLD) & (risk <= HIGH_RISK_THRESHOLD), size)).alias("medium"),
        F.sum(F.when(risk <= MEDIUM_RISK_THRESHOLD, size)).alias("low"),
    ]
    if sensitive:
        d = F.when(F.col("in_class"), F.col(DIVERSITY))
        out += [F.min(d).alias("min_div"), F.max(d).alias("max_div"), F.avg(d).alias("avg_div"),
                F.count_if(d >= l).alias("div_ok"), F.count_if(d < l).alias("div_bad")]
    return groups.agg(*out)


def recommendation(k_ok: Column, l_ok: Column | None, high_pct: Column, retention_pct: Column) -> Column:
    """The recommendation text as a Column expression over report figures."""
    parts = [F.when(~k_ok, F.lit(REC_K_FAIL))]
    if l_ok is not None:
        parts.append(F.when(~l_ok, F.lit(REC_L_FAIL)))
    fmt = lambda x: F.format_string("%.1f", python_round(x, 1))
    head, tail = REC_HIGH_RISK.split("{pct}")
    parts.append(F.when(high_pct > HIGH_RISK_PCT_LIMIT, F.concat(F.lit(head), fmt(high_pct), F.lit(tail))))
    head, tail = REC_LOW_RETENTION.split("{pct}")
    parts.append(F.when(retention_pct < RETENTION_PCT_LIMIT, F.concat(F.lit(head), fmt(retention_pct), F.lit(tail))))
    joined = F.concat_ws(" ", *parts)
    return F.when(joined == "", F.lit(REC_READY)).otherwise(joined)


REPORT_SCHEMA = StructType([
    StructField("k_value", LongType()), StructField("satisfies_k_anonymity", BooleanType()),
    StructField("min_group_size", LongType()), StructField("max_group_size", LongType()),
    StructField("avg_group_size", DoubleType()), StructField("num_groups", LongType()),
    StructField("l_value", LongType()), StructField("satisfies_l_diversity", BooleanType()),
    StructField("min_diversity", LongType()), StructField("max_diversity", LongType()),
    StructField("avg_diversity", DoubleType()), StructField("groups_satisfying_l", LongType()),
    StructField("groups_not_satisfying_l", LongType()),
    StructField("avg_risk", DoubleType()), StructField("max_risk", DoubleType()), StructField("min_risk", DoubleType()),
    StructField("records_at_high_risk", LongType()), StructField("records_at_medium_risk", LongType()),
    StructField("records_at_low_risk", LongType()), StructField("high_risk_percentage", DoubleType()),
    StructField("medium_risk_percentage", DoubleType()), StructField("low_risk_percentage", DoubleType()),
    StructField("original_records", LongType()), StructField("anonymized_records", LongType()),
    StructField("suppressed_records", LongType()), StructField("retention_rate_pct", DoubleType()),
    StructField("suppression_rate_pct", DoubleType()),
    StructField("avg_information_loss_pct", DoubleType()), StructField("columns_analyzed", LongType()),
    StructField("privacy_requirements_met", BooleanType()), StructField("recommendation", StringType()),
    StructField("dashboard_risk_score", LongType()),
])


def full_report(original: DataFrame, anonymized: DataFrame, qi: list[str], sensitive: str | None = None,
                numeric_columns: list[str] | None = None, k: int = 3, l: int = 2) -> tuple[dict, DataFrame]:
    """U4: the full report as a nested dict and as a one-row DataFrame.

    ``satisfies_k_anonymity`` compares with the requested ``k``.
    """
    spark: SparkSession = original.sparkSession
    if sensitive and sensitive not in anonymized.columns:
        raise ValueError(f"Sensitive attribute '{sensitive}' not found")
    return _full_report(spark, original, anonymized, qi, sensitive, numeric_columns, k, l)


def _full_report(spark, original, anonymized, qi, sensitive, numeric_columns, k, l):
    if qi:
        cm = class_metrics(anonymized, qi, sensitive, k, l).first().asDict()
    else:
        n = anonymized.count()
        cm = {"total": n, "num_groups": 1 if n else 0, "min_size": n, "max_size": n, "avg_size": float(n),
              "avg_risk": 0.0, "max_risk": 0.0, "min_risk": 0.0, "high": 0, "medium": 0, "low": n}
        if sensitive:
            d = anonymized.agg(F.count_distinct(sensitive)).first()[0] if n else None
            cm.update({"min_div": d, "max_div": d, "avg_div": d, "div_ok": int(d is not None and d >= l),
                       "div_bad": int(d is not None and d < l)})
    total = int(cm["total"] or 0)
    n_groups = int(cm["num_groups"] or 0)
    k_value = int(cm["min_size"]) if n_groups else 0
    k_ok = n_groups > 0 and k_value >= k
    kmet = {"k_value": k_value, "satisfies_k_anonymity": k_ok, "min_group_size": k_value,
            "max_group_size": int(cm["max_size"]) if n_groups else 0,
            "avg_group_size": float(cm["avg_size"]) if n_groups else 0.0, "num_groups": n_groups, "required_k": k}
    lmet = None
    if sensitive:
        has = cm.get("min_div") is not None
        lmet = {"l_value": int(cm["min_div"]) if has else 0,
                "satisfies_l_diversity": bool(has and cm["min_div"] >= l), "required_l": l,
                "min_diversity": int(cm["min_div"]) if has else 0,
                "max_diversity": int(cm["max_div"]) if has else 0,
                "avg_diversity": float(cm["avg_div"]) if has else 0.0,
                "groups_satisfying_l": int(cm["div_ok"] or 0), "groups_not_satisfying_l": int(cm["div_bad"] or 0)}
    pct = (lambda v: (float(v or 0) / total * 100.0) if total else 0.0)
    risk = {"avg_risk": float(cm["avg_risk"] or 0.0), "max_risk": float(cm["max_risk"] or 0.0),
            "min_risk": float(cm["min_risk"] or 0.0),
            "records_at_high_risk": int(cm["high"] or 0), "records_at_medium_risk": int(cm["medium"] or 0),
            "records_at_low_risk": int(cm["low"] or 0),
            "high_risk_percentage": pct(cm["high"]), "medium_risk_percentage": pct(cm["medium"]),
            "low_risk_percentage": pct(cm["low"])}
    ret = data_retention(original, anonymized).first().asDict()
    loss_rows = information_loss(original, anonymized).orderBy("pos").collect()
    per_col = {r["column"]: {"original_entropy": r["original_entropy"], "anonymized_entropy": r["anonymized_entropy"],
                             "information_loss_pct": r["information_loss_pct"]} for r in loss_rows}
    avg_loss = (sum(v["information_loss_pct"] for v in per_col.values()) / len(per_col)) if per_col else 0.0
    utility = {"data_retention": ret, "information_loss": {"per_column": per_col,
                                                          "avg_information_loss_pct": avg_loss,
                                                          "columns_analyzed": len(per_col)}}
    if numeric_columns:
        utility["numeric_error"] = {r["column"]: {k2: r[k2] for k2 in r.asDict() if k2 != "column"}
                                    for r in numeric_error(original, anonymized, numeric_columns).collect()}
    l_ok = lmet["satisfies_l_diversity"] if lmet else True
    rec_row = spark.range(1).select(recommendation(
        F.lit(k_ok), F.lit(l_ok) if lmet else None,
        F.lit(risk["high_risk_percentage"]), F.lit(float(ret["retention_rate_pct"])))).first()[0]
    summary = {"privacy_requirements_met": bool(k_ok and l_ok), "k_anonymity_satisfied": k_ok,
               "l_diversity_satisfied": l_ok, "data_retention_pct": ret["retention_rate_pct"],
               "avg_reidentification_risk": risk["avg_risk"], "recommendation": rec_row,
               "dashboard_risk_score": DASHBOARD_RISK_OK if k_ok else DASHBOARD_RISK_FAIL}
    privacy = {"k_anonymity": kmet, "reidentification_risk": risk}
    if lmet:
        privacy["l_diversity"] = lmet
    report = {"timestamp": _dt.datetime.now().isoformat(), "privacy_metrics": privacy,
              "utility_metrics": utility, "summary": summary}
    flat = {**kmet, **(lmet or {}), **risk, **ret, "avg_information_loss_pct": avg_loss,
            "columns_analyzed": len(per_col), "privacy_requirements_met": summary["privacy_requirements_met"],
            "recommendation": rec_row, "dashboard_risk_score": summary["dashboard_risk_score"]}
    row = tuple(flat.get(f.name) for f in REPORT_SCHEMA.fields)
    return report, spark.createDataFrame([row], REPORT_SCHEMA)


LONG_SCHEMA = "section string, metric string, column string, value string"


def report_long(report: dict, anonymized: DataFrame, qi: list[str]) -> DataFrame:
    """U4 as rows ``(section, metric, column, value)``: every figure of the report, and the group sizes.

    ``column`` names the data column of per-column figures (information loss,
    numeric error) and is NULL otherwise. The group-size histogram (metric
    ``group_size``, the size in ``column``) stays distributed.
    """
    spark = anonymized.sparkSession
    rows = []

    def add(section: str, metric: str, value, column: str | None = None) -> None:
        rows.append((section, metric, column, None if value is None else str(value)))

    for name, figures in report["privacy_metrics"].items():
        for metric, value in figures.items():
            add(name, metric, value)
    utility = report["utility_metrics"]
    for metric, value in utility["data_retention"].items():
        add("data_retention", metric, value)
    for metric, value in utility["information_loss"].items():
        if metric != "per_column":
            add("information_loss", metric, value)
    for section, columns in (("information_loss", utility["information_loss"]["per_column"]),
                             ("numeric_error", utility.get("numeric_error", {}))):
        for column, figures in columns.items():
            for metric, value in figures.items():
                add(section, metric, value, column)
    for metric, value in report["summary"].items():
        add("summary", metric, value)
    out = spark.createDataFrame(rows, LONG_SCHEMA)
    if not qi:
        return out
    sizes = group_size_histogram(anonymized, qi).select(
        F.lit("k_anonymity").alias("section"), F.lit("group_size").alias("metric"),
        F.col("group_size").cast("string").alias("column"), F.col("num_groups").cast("string").alias("value"))
    return out.unionByName(sizes)
