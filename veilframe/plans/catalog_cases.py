"""Registered queries over NULLs, broken lines, tables laid out by day, the run log,
the long report and a profile of all transforms, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import audit, classes, metrics, report
from ..sources import files
from ..streaming.jobs import shared_path
from . import oracle_sql as O
from .catalog import (
    _CUST_KL, _cust_kl, _entropy_sql, _full_report_sql, _key_sql, _lane_sql, _laplace_sql, _log, _log_sql, _r4, _r9,
    _shuffle_sql, _t, AUDIT_FROM, AUDIT_TO, CUST_COLS, CUST_QI, HMAC_KEY, JOB_PROFILE, K, L, SALT, SEED,
)
from .pipeline import apply_profile, run

# --- NULL quasi-identifiers and NULL sensitive values --------------------------

NULLS_K = 7
NULLS_QI = ["c_nationkey", "c_mktsegment"]


def _cust_nulls(spark, sf) -> DataFrame:
    """customer with NULLs by key: nations (every 7th), segments (every 3rd), balances (every 11th)."""
    c = _t(spark, sf, "customer")
    unless = lambda n, col: F.when(F.col("c_custkey") % n != 0, F.col(col)).alias(col)
    return c.select("c_custkey", "c_name", unless(7, "c_nationkey"), unless(11, "c_acctbal"), unless(3, "c_mktsegment"))


_NULLS_SQL = """SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS c_nationkey,
  CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer"""
_NULLS_IN_CLASS = "c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL"


def q_k_check_nulls(spark, sf):
    """A1: rows with a NULL QI are in no class."""
    return classes.k_check_frame(_cust_nulls(spark, sf), NULLS_QI, NULLS_K)


def q_k_suppress_nulls(spark, sf):
    """A4 with ``null_qi='keep'``: small classes go, rows with a NULL QI stay."""
    return classes.suppress_small_classes(_cust_nulls(spark, sf), NULLS_QI, NULLS_K, "keep")


def q_l_suppress_nulls(spark, sf):
    """L2: a NULL sensitive value is no value, rows with a NULL QI are dropped."""
    rows = classes.generalize_columns(_cust_nulls(spark, sf), {"c_acctbal": 3})
    return classes.enforce_l_diversity(rows, CUST_QI, "c_mktsegment", 3)


def q_reid_risk_nulls(spark, sf):
    """M6: rows with a NULL QI are in no bucket but in the total."""
    risk = metrics.reidentification_risk(_cust_nulls(spark, sf), NULLS_QI)
    return risk.withColumns({f.name: _r9(f.name) for f in risk.schema.fields if isinstance(f.dataType, DoubleType)})


LINE_QI = ["l_quantity", "l_discount"]
LINE_L = 68


def q_l_suppress_many_values(spark, sf):
    """L2 where classes hold many sensitive values: sketches of bounded size decide."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", *LINE_QI, "l_suppkey")
    return classes.enforce_l_diversity(li, LINE_QI, "l_suppkey", LINE_L)


# --- broken CSV lines ------------------------------------------------------------

CSV_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"


def q_csv_bad_lines(spark, sf):
    """Customer as CSV lines, some too short, too long or with a bad number; good rows and bad lines."""
    key = F.col("c_custkey")
    nation = F.when(key % 13 == 0, F.lit("x")).otherwise(F.col("c_nationkey").cast("string"))
    line = (F.when(key % 7 == 0, F.concat_ws(",", key, "c_name", "c_nationkey"))
            .when(key % 11 == 0, F.concat_ws(",", key, "c_name", "c_nationkey", "c_mktsegment", F.lit("more")))
            .otherwise(F.concat_ws(",", key, "c_name", nation, "c_mktsegment")))
    path = shared_path(spark, "csv_bad_lines")
    _t(spark, sf, "customer").select(line.alias("value")).write.text(path)
    good, bad = files.read_csv_split(spark, path, CSV_SCHEMA, header=False)
    return good.unionByName(bad, allowMissingColumns=True)


_CSV_SQL = """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CAST(NULL AS VARCHAR) AS line, CAST(NULL AS INTEGER) AS n_read
FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL,
  CASE WHEN c_custkey % 7 = 0 THEN concat_ws(',', c_custkey, c_name, c_nationkey)
       WHEN c_custkey % 11 = 0 THEN concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment, 'more')
       ELSE concat_ws(',', c_custkey, c_name, 'x', c_mktsegment) END,
  CASE WHEN c_custkey % 7 = 0 THEN 3 WHEN c_custkey % 11 = 0 THEN 4 ELSE 3 END
FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0"""


# --- audit table laid out by day ---------------------------------------------------

def _audit_table(spark, sf) -> DataFrame:
    path = shared_path(spark, "audit_table")
    files.write_audit_table(_log(spark, sf), path)
    return files.read_audit_table(spark, path)


def q_audit_table_search(spark, sf):
    """The log written by day and searched in the asked days' folders."""
    return audit.search_days(_audit_table(spark, sf), event_type="error", start=AUDIT_FROM, end=AUDIT_TO)


def q_audit_table_tail(spark, sf):
    """The newest entries from the newest days' folders."""
    return audit.tail_days(_audit_table(spark, sf), 100)


# --- run log and report ------------------------------------------------------------

def q_run_log(spark, sf):
    """What the composite job appended to the run log, read back."""
    base = shared_path(spark, "run_log")
    run(_t(spark, sf, "customer"), JOB_PROFILE, output_path=f"{base}/data", log_path=f"{base}/log", user="auditor",
        profile_path="customer_job.json")
    detail = lambda name: F.get_json_object("details", f"$.{name}")
    counted = F.coalesce(detail("records_affected"), detail("records_count"), detail("anonymized_records"))
    return files.read_audit_log(spark, f"{base}/log").select(
        "event_type", "user", "success", detail("column").alias("column"), detail("profile_path").alias("profile_path"),
        counted.cast("bigint").alias("n_records"))


_RUN_LOG_SQL = f"""WITH kl AS ({_CUST_KL}), n AS (SELECT (SELECT count(*) FROM customer) AS o, (SELECT count(*) FROM kl) AS a)
SELECT event_type, 'auditor' AS "user", true AS success, col AS "column", profile AS profile_path,
  CASE which WHEN 'o' THEN o WHEN 'a' THEN a END AS n_records
FROM n, (VALUES ('PROFILE_LOAD', NULL, 'customer_job.json', NULL), ('TRANSFORMATION', 'c_name', NULL, 'o'),
  ('TRANSFORMATION', 'c_custkey', NULL, 'o'), ('K_ANONYMITY', NULL, NULL, NULL), ('L_DIVERSITY', NULL, NULL, NULL),
  ('DATA_EXPORT', NULL, NULL, 'a'), ('ANONYMIZATION', NULL, NULL, 'a')) v(event_type, col, profile, which)"""


def q_full_report_long(spark, sf):
    """U4 in long form: every figure of the report, the numeric error and the group sizes as rows."""
    anon = _cust_kl(spark, sf)
    nested, _ = report.full_report(_t(spark, sf, "customer"), anon, CUST_QI, "c_mktsegment", ["c_acctbal"], K, L)
    rows = report.report_long(nested, anon, CUST_QI)
    figure = F.expr("try_cast(value AS double)")
    return rows.select("section", "metric", "column", F.round(figure, 6).alias("figure"),
                       F.when(figure.isNull(), F.lower("value")).alias("text"))


def _report_long_sql() -> str:
    # section -> figures of the one-row report, by (metric, SQL over that row)
    same = {
        "k_anonymity": ["k_value", "satisfies_k_anonymity", "min_group_size", "max_group_size", "avg_group_size", "num_groups"],
        "l_diversity": ["l_value", "satisfies_l_diversity", "min_diversity", "max_diversity", "avg_diversity",
                        "groups_satisfying_l", "groups_not_satisfying_l"],
        "reidentification_risk": ["avg_risk", "max_risk", "min_risk", "records_at_high_risk", "records_at_medium_risk",
                                  "records_at_low_risk", "high_risk_percentage", "medium_risk_percentage",
                                  "low_risk_percentage"],
        "data_retention": ["original_records", "anonymized_records", "suppressed_records", "retention_rate_pct",
                           "suppression_rate_pct"],
        "information_loss": ["avg_information_loss_pct", "columns_analyzed"],
        "summary": ["privacy_requirements_met", "recommendation", "dashboard_risk_score"],
    }
    figures = [(s, m, m) for s, ms in same.items() for m in ms]
    figures += [("k_anonymity", "required_k", str(K)), ("l_diversity", "required_l", str(L)),
                ("summary", "k_anonymity_satisfied", "satisfies_k_anonymity"),
                ("summary", "l_diversity_satisfied", "satisfies_l_diversity"),
                ("summary", "data_retention_pct", "retention_rate_pct"),
                ("summary", "avg_reidentification_risk", "avg_risk")]
    parts = [f"SELECT '{s}' AS section, '{m}' AS metric, NULL AS col, CAST({x} AS VARCHAR) AS v FROM rep" for s, m, x in figures]
    parts += [f"SELECT 'information_loss', '{m}', col, CAST({x} AS VARCHAR) FROM loss" for m, x in
              (("original_entropy", "o"), ("anonymized_entropy", "a"),
               ("information_loss_pct", "CASE WHEN o > 0 THEN (o - a) / o * 100 ELSE 0.0 END"))]
    parts += [f"SELECT 'numeric_error', '{m}', 'c_acctbal', CAST({x} AS VARCHAR) FROM num" for m, x in
              (("original_mean", "mo"), ("anonymized_mean", "ma"), ("absolute_error", "abs(mo - ma)"),
               ("relative_error_pct", "CASE WHEN mo <> 0 THEN abs(mo - ma) / mo * 100 ELSE 0.0 END"),
               ("original_std", "so"), ("anonymized_std", "sa"))]
    parts.append("SELECT 'k_anonymity', 'group_size', CAST(n AS VARCHAR), CAST(count(*) AS VARCHAR) FROM "
                 "(SELECT count(*) AS n FROM kl GROUP BY c_acctbal, c_nationkey) GROUP BY n")
    return f"""WITH rep AS ({_full_report_sql()}), kl AS ({_CUST_KL}),
{_entropy_sql("SELECT * FROM customer", CUST_COLS, "o")}, {_entropy_sql("SELECT * FROM kl", CUST_COLS, "a")},
loss AS (SELECT c.col, coalesce(x.h, 0.0) AS o, coalesce(y.h, 0.0) AS a
         FROM (SELECT unnest({CUST_COLS!r}) AS col) c LEFT JOIN ent_o x USING (col) LEFT JOIN ent_a y USING (col)),
num AS (SELECT p.m AS mo, p.s AS so, q.m AS ma, q.s AS sa
        FROM (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) p,
             (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM kl) q)
SELECT section, metric, col AS "column", round(TRY_CAST(v AS DOUBLE), 6) AS figure,
  CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN lower(v) END AS text FROM ({" UNION ALL ".join(parts)})"""


# --- one profile with every transform ------------------------------------------------

ALL_PROFILE = {
    "columns": {
        "fake_city": {"transform": "substitute", "params": {"data_type": "city", "mode": "random"}},
        "masked": {"transform": "mask", "params": {"keep_last": 3}},
        "nothing": {"transform": "null", "params": {}},
        "hashed": {"transform": "hash", "params": {}},
        "pseudonym": {"transform": "hmac", "params": {"out_len": 12}},
        "nation_band": {"transform": "generalize_age", "params": {"bins": [0, 5, 10, 20]}},
        "balance": {"transform": "generalize_numeric", "params": {"precision": 0}},
        "noisy": {"transform": "differential_privacy", "params": {"epsilon": 1.0, "sensitivity": 1.0}},
        "moved": {"transform": "shuffle", "params": {}},
    },
    "salt": SALT, "hmac_key": HMAC_KEY.decode(), "row_key": ["c_custkey"],
}


def q_profile_all_transforms(spark, sf):
    """The nine transforms of a profile at once, on copies of customer's columns."""
    name, balance = F.col("c_name"), F.col("c_acctbal")
    c = _t(spark, sf, "customer").select(
        "c_custkey", *[name.alias(x) for x in ("fake_city", "masked", "nothing", "hashed", "pseudonym")],
        F.col("c_nationkey").alias("nation_band"), *[balance.alias(x) for x in ("balance", "noisy", "moved")])
    return apply_profile(c, ALL_PROFILE, SEED).withColumn("noisy", _r4("noisy"))


def _all_transforms_sql() -> str:
    from ..functions.substitute import CITIES
    key = _key_sql("c_custkey")
    place = list(ALL_PROFILE["columns"]).index("noisy")
    cities = "[" + ", ".join(O.q(w) for w in CITIES) + "]"
    noise = _laplace_sql(key, "noisy", "1.0", seed=SEED + 131 * place)
    return f"""WITH moves AS ({_shuffle_sql({"moved": "c_acctbal"}, SEED + 7)})
SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN {cities}[{_lane_sql(key, "fake_city|0", 0)} % {len(CITIES)} + 1] END AS fake_city,
  {O.mask_sql("c_name", 3)} AS masked, CAST(NULL AS VARCHAR) AS nothing, sha256({O.q(SALT)} || c_name) AS hashed,
  {O.hmac_sql("c_name", HMAC_KEY, 12)} AS pseudonym, {O.age_sql("c_nationkey", [0, 5, 10, 20])} AS nation_band,
  {O.gen_numeric_sql("c_acctbal", 0)} AS balance, round(c_acctbal + {noise}, 4) AS noisy, moved
FROM customer JOIN moves USING (c_custkey)"""


QUERIES = {
    "k_check_nulls": q_k_check_nulls,
    "k_suppress_nulls": q_k_suppress_nulls,
    "l_suppress_nulls": q_l_suppress_nulls,
    "l_suppress_many_values": q_l_suppress_many_values,
    "reid_risk_nulls": q_reid_risk_nulls,
    "csv_bad_lines": q_csv_bad_lines,
    "audit_table_search": q_audit_table_search,
    "audit_table_tail": q_audit_table_tail,
    "run_log": q_run_log,
    "full_report_long": q_full_report_long,
    "profile_all_transforms": q_profile_all_transforms,
}

_NULLS_RISK = "CASE WHEN tot > 0 THEN {} / tot * 100.0 ELSE 0.0 END"

ORACLE_SQL = {
    "k_check_nulls": f"""SELECT CASE WHEN count(*) = 0 THEN true ELSE min(n) >= {NULLS_K} END AS satisfies,
  CAST(coalesce(min(n), 0) AS BIGINT) AS min_group_size
  FROM (SELECT count(*) AS n FROM ({_NULLS_SQL}) WHERE {_NULLS_IN_CLASS} GROUP BY c_nationkey, c_mktsegment)""",
    "k_suppress_nulls": f"""SELECT * FROM ({_NULLS_SQL})
  QUALIFY NOT ({_NULLS_IN_CLASS}) OR count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) >= {NULLS_K}""",
    "l_suppress_nulls": f"""WITH g AS (SELECT c_custkey, c_name, c_nationkey, {O.gen_qi_num_sql('c_acctbal', 3)} AS c_acctbal,
  c_mktsegment FROM ({_NULLS_SQL})),
good AS (SELECT c_acctbal, c_nationkey FROM g GROUP BY 1, 2 HAVING count(DISTINCT c_mktsegment) >= 3)
SELECT g.* FROM g SEMI JOIN good USING (c_acctbal, c_nationkey)""",
    "l_suppress_many_values": f"""WITH good AS (SELECT l_quantity, l_discount FROM lineitem GROUP BY 1, 2
  HAVING count(DISTINCT l_suppkey) >= {LINE_L})
SELECT l_orderkey, l_quantity, l_discount, l_suppkey FROM lineitem SEMI JOIN good USING (l_quantity, l_discount)""",
    "reid_risk_nulls": f"""WITH g AS ({_NULLS_SQL}),
cls AS (SELECT count(*) AS n FROM g WHERE {_NULLS_IN_CLASS} GROUP BY c_nationkey, c_mktsegment),
a AS (SELECT avg(1.0 / n) AS ar, max(1.0 / n) AS xr, min(1.0 / n) AS nr,
             coalesce(sum(n) FILTER (WHERE 1.0 / n > 0.33), 0) AS hi,
             coalesce(sum(n) FILTER (WHERE 1.0 / n > 0.10 AND 1.0 / n <= 0.33), 0) AS me,
             coalesce(sum(n) FILTER (WHERE 1.0 / n <= 0.10), 0) AS lo FROM cls),
t AS (SELECT count(*) AS tot FROM g)
SELECT round(coalesce(ar, 0.0), 9) AS avg_risk, round(coalesce(xr, 0.0), 9) AS max_risk,
       round(coalesce(nr, 0.0), 9) AS min_risk, CAST(hi AS BIGINT) AS records_at_high_risk,
       CAST(me AS BIGINT) AS records_at_medium_risk, CAST(lo AS BIGINT) AS records_at_low_risk,
       round({_NULLS_RISK.format('hi')}, 9) AS high_risk_percentage,
       round({_NULLS_RISK.format('me')}, 9) AS medium_risk_percentage,
       round({_NULLS_RISK.format('lo')}, 9) AS low_risk_percentage FROM a, t""",
    "csv_bad_lines": _CSV_SQL,
    "audit_table_search": f"SELECT * FROM ({_log_sql()}) WHERE event_type = 'error' "
                          f"AND ts >= TIMESTAMP '{AUDIT_FROM}' AND ts <= TIMESTAMP '{AUDIT_TO}'",
    "audit_table_tail": f"SELECT * FROM ({_log_sql()}) ORDER BY ts DESC, seq DESC LIMIT 100",
    "run_log": _RUN_LOG_SQL,
    "full_report_long": _report_long_sql(),
    "profile_all_transforms": _all_transforms_sql(),
}
