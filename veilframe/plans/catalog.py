"""Registered queries: one Spark job per operator over the given tables, each
with an independent DuckDB SQL oracle where the output is deterministic.

Random outputs are drawn from SHA-256 of row or group keys, so they have oracles too; outputs without one
are checked by row count here and by moment/shape tests in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DoubleType, LongType, StructField, StructType,
)

from ..functions import checks
from ..functions.generalize import generalize_age, generalize_numeric, generalize_qi_numeric, generalize_qi_string
from ..functions.masking import hmac_pseudonym, mask, null_out, salted_hash
from ..functions.draws import row_key
from ..functions.noise import add_laplace, randomized_response
from ..functions.patterns import SQL_INJECTION_PATTERNS
from ..functions.substitute import substitute
from ..operators import access, audit, classes, dp, lockout, metrics, report, scan
from ..operators.shuffle import shuffle_columns
from ..sources.files import dataset_profile, preview
from ..sources.tables import table
from . import oracle_sql as O
from .pipeline import apply_profile, run

# Fixed demo parameters of the registered queries.
SALT = "veil-salt-2025"
HMAC_KEY = b"veilframe-demo-key"
SEED = 42
K = 5
L = 2
AUDIT_FROM = "2024-01-05 00:00:00"
AUDIT_TO = "2024-01-10 23:59:59"
RATE_LIMIT_PER_DAY = 5
EVENT_PERMISSION = {
    "view": "read_data", "click": "read_data", "purchase": "export_data",
    "signup": "manage_users", "error": "write_data",
}

PIPELINE_PROFILE = {
    "columns": {
        "l_orderkey": {"transform": "hmac", "params": {"out_len": 12}},
        "l_partkey": {"transform": "hash", "params": {}},
        "l_quantity": {"transform": "generalize_age", "params": {}},
        "l_extendedprice": {"transform": "generalize_numeric", "params": {"precision": 0}},
        "l_discount": {"transform": "generalize_numeric", "params": {"precision": 1}},
        "l_tax": {"transform": "null", "params": {}},
        "l_returnflag": {"transform": "mask", "params": {"keep_last": 4}},
        "l_linestatus": {"transform": "mask", "params": {"keep_last": 0, "mask_char": "#"}},
    },
    "salt": SALT,
    "hmac_key": HMAC_KEY.decode(),
}

CUST_QI = ["c_acctbal", "c_nationkey"]   # c_acctbal generalised to thousands first
PART_QI = ["p_size", "p_brand"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


def _cust_gen(spark, sf) -> DataFrame:
    """customer with c_acctbal generalised to the nearest 1000 (A2, level 3)."""
    return classes.generalize_columns(_t(spark, sf, "customer"), {"c_acctbal": 3})


def _r9(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def _r4(c):
    """Logarithms and cosines differ in the last bit between engines: four decimals agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, 4) + F.lit(0.0)  # no negative zero


LINE_KEY = ["l_orderkey", "l_linenumber"]


def _log(spark, sf) -> DataFrame:
    return audit.events_as_audit(_t(spark, sf, "events"))


# --- sources ----------------------------------------------------------------

def q_dataset_profile(spark, sf):
    return dataset_profile(_t(spark, sf, "customer"))


def q_preview_head(spark, sf):
    c = _t(spark, sf, "customer")
    masked = c.withColumn("c_name", mask("c_name"))
    return preview(masked, 10, ["c_custkey"])


# --- transforms -------------------------------------------------------------

def q_profile_pipeline(spark, sf):
    return apply_profile(_t(spark, sf, "lineitem"), PIPELINE_PROFILE, seed=SEED)


def q_mask_value(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", mask("c_name").alias("c_name"), mask("c_mktsegment", 2, "#").alias("c_mktsegment"),
                    mask("c_custkey", 0).alias("key_masked"))


def q_null_value(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", null_out("c_name").alias("c_name"),
                    null_out("c_acctbal", DoubleType()).alias("c_acctbal"))


def q_salted_hash(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", salted_hash("c_name", SALT).alias("c_name_hash"),
                    salted_hash("c_custkey", "").alias("key_hash"))


def q_hmac_pseudonym(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", hmac_pseudonym("c_name", HMAC_KEY).alias("c_name_pseudo"),
                    hmac_pseudonym("c_custkey", HMAC_KEY, 16).alias("key_pseudo"))


def q_generalize_age(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", generalize_age("p_size", dtype=p.schema["p_size"].dataType).alias("size_band"),
                    generalize_age("p_size", [0, 10, 20, 30, 40, 50]).alias("size_band_custom"),
                    generalize_age("p_size", bin_size=10).alias("size_band_width"))


def q_generalize_numeric(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     generalize_numeric("l_extendedprice", 0).alias("price_p0"),
                     generalize_numeric("l_extendedprice", 1).alias("price_p1"),
                     generalize_numeric("l_discount", 1).alias("discount_p1"),
                     generalize_numeric("l_extendedprice", -2).alias("price_m2"))


def q_substitute_values(spark, sf):
    c = _t(spark, sf, "customer")
    cols = {t: substitute("c_name", t, "random", SEED, row_key(["c_custkey"]), t) for t in
            ("name", "email", "phone", "address", "company", "ssn", "credit_card", "date", "city",
             "country", "zipcode", "url", "ip", "text", "other")}
    return c.select("c_custkey", *[v.alias(f"fake_{k}") for k, v in cols.items()])


def q_substitute_consistent(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey", substitute("o_custkey", "name", "consistent", SEED).alias("customer_alias"))


def q_shuffle_column(spark, sf):
    customer = _t(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return shuffle_columns(customer, ["c_acctbal", "c_mktsegment"], SEED, ["c_custkey"])


def q_laplace_transform(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", _r4(add_laplace("l_extendedprice", 1.0, 1.0, SEED, row_key(LINE_KEY))).alias("price_noisy"))


# --- k-anonymity --------------------------------------------------------------

def q_k_check(spark, sf):
    return classes.k_check_frame(_t(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], K)


def q_k_generalize_numeric(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", generalize_qi_numeric("c_acctbal", 2, DoubleType()).alias("c_acctbal"),
                    generalize_qi_numeric("c_nationkey", 1, c.schema["c_nationkey"].dataType).alias("c_nationkey"))


def q_k_generalize_string(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", generalize_qi_string("p_brand", 1).alias("p_brand"),
                    generalize_qi_string("p_type", 3).alias("p_type"),
                    generalize_qi_string("p_name", 5).alias("p_name"))


def q_k_suppress(spark, sf):
    return classes.suppress_small_classes(_cust_gen(spark, sf), CUST_QI, K)


def q_k_anonymize(spark, sf):
    out, _ = classes.apply_k_anonymity(_t(spark, sf, "part"), PART_QI, K, {"p_size": 1, "p_brand": 1})
    return out


def q_k_anonymize_suppress(spark, sf):
    out, _ = classes.apply_k_anonymity(_t(spark, sf, "part"), PART_QI, K, {"p_size": 1, "p_brand": 0})
    return out


def q_equivalence_classes(spark, sf):
    return classes.class_summary(_t(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


# --- l-diversity --------------------------------------------------------------

def q_l_check(spark, sf):
    return classes.l_check_frame(_cust_gen(spark, sf), CUST_QI, "c_mktsegment", L)


def q_l_suppress(spark, sf):
    return classes.enforce_l_diversity(_cust_gen(spark, sf), CUST_QI, "c_mktsegment", L)


def q_l_report(spark, sf):
    r = classes.l_report_frame(_cust_gen(spark, sf), CUST_QI, "c_mktsegment", L)
    return r.withColumn("avg_diversity", _r9("avg_diversity")).withColumn(
        "records_per_class_avg", _r9("records_per_class_avg"))


def _kl_part(spark, sf):
    return classes.apply_k_and_l(_t(spark, sf, "part"), PART_QI, "p_type", K, L, {"p_size": 1, "p_brand": 0})


def q_kl_anonymize(spark, sf):
    return _kl_part(spark, sf)[0]


KL_REPORT_SCHEMA = StructType([
    StructField("original_records", LongType()), StructField("anonymized_records", LongType()),
    StructField("records_suppressed", LongType()), StructField("suppression_rate", DoubleType()),
    StructField("k", LongType()), StructField("k_satisfies", BooleanType()), StructField("min_group_size", LongType()),
    StructField("l", LongType()), StructField("l_satisfies", BooleanType()), StructField("min_diversity", LongType()),
])


def q_kl_report(spark, sf):
    _, rep = _kl_part(spark, sf)
    row = rep.as_row()
    df = spark.createDataFrame([tuple(row[f.name] for f in KL_REPORT_SCHEMA.fields)], KL_REPORT_SCHEMA)
    return df.withColumn("suppression_rate", _r9("suppression_rate"))


# --- differential privacy (noise keyed by row or group) ------------------------

def q_dp_laplace(spark, sf):
    acct = dp.PrivacyAccountant(1.0, 1e-5, "lineitem")
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = dp.laplace_column(li, "l_extendedprice", acct, sensitivity=1.0, seed=SEED, keys=LINE_KEY)
    return out.withColumn("l_extendedprice", _r4("l_extendedprice"))


def q_dp_gaussian(spark, sf):
    acct = dp.PrivacyAccountant(1.0, 1e-5, "lineitem")
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = dp.gaussian_column(li, "l_extendedprice", acct, sensitivity=1.0, seed=SEED, keys=LINE_KEY)
    return out.withColumn("l_extendedprice", _r4("l_extendedprice"))


def q_dp_noisy_count(spark, sf):
    acct = dp.PrivacyAccountant(1.0, 1e-5, "orders")
    return dp.noisy_count(_t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], acct, seed=SEED)


def q_dp_noisy_sum(spark, sf):
    acct = dp.PrivacyAccountant(1.0, 1e-5, "lineitem")
    out = dp.noisy_sum(_t(spark, sf, "lineitem"), "l_extendedprice", acct, ["l_returnflag"], seed=SEED)
    return out.withColumn("noisy_sum", F.round("noisy_sum", 2))


def q_dp_noisy_mean(spark, sf):
    acct = dp.PrivacyAccountant(1.0, 1e-5, "lineitem")
    out = dp.noisy_mean(_t(spark, sf, "lineitem"), "l_quantity", acct, ["l_returnflag"], seed=SEED)
    return out.withColumn("noisy_mean", _r4("noisy_mean"))


def q_randomized_response(spark, sf):
    lab = _t(spark, sf, "labels")
    return lab.select("doc_id", randomized_response(F.col("toxic") == 1, 1.0, seed=SEED, key=row_key(["doc_id"]))
                      .alias("toxic_reported"))


def q_dp_columns(spark, sf):
    acct = dp.PrivacyAccountant(1.0, 1e-5, "lineitem")
    out = dp.dp_columns(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "missing"],
                        acct, {"l_extendedprice": 100.0}, seed=SEED, keys=LINE_KEY)
    return out.withColumns({c: _r4(c) for c in ("l_quantity", "l_extendedprice", "l_discount")})


def _ledger_of_releases(spark, sf):
    """A ledger that three runs on orders and one on lineitem share; the third on orders is refused."""
    from ..operators.ledger import BudgetExhausted, SharedLedger
    from ..streaming.jobs import shared_path
    path = shared_path(spark, "privacy_ledger")
    orders, refused = _t(spark, sf, "orders"), 0
    for column in ("o_orderpriority", "o_orderstatus", "o_custkey"):
        acct = dp.PrivacyAccountant(1.0, 1e-5, "orders", shared=SharedLedger(spark, path, 2.0))
        try:
            dp.noisy_count(orders, [column], acct, seed=SEED)
        except BudgetExhausted:
            refused += 1
    acct = dp.PrivacyAccountant(1.0, 1e-5, "lineitem", shared=SharedLedger(spark, path, 2.0))
    dp.dp_columns(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "missing"], acct,
                  seed=SEED, keys=LINE_KEY)
    return path, refused


def q_budget_ledger(spark, sf):
    """DP8 over the charges that releases of several runs made, and how many were refused."""
    from ..operators.ledger import read_charges
    path, refused = _ledger_of_releases(spark, sf)
    budgets = spark.createDataFrame([("orders", 2.0), ("lineitem", 2.0), ("part", 1.0)], "dataset string, epsilon double")
    out = dp.budget_ledger(read_charges(spark, path), budgets)
    return out.withColumn("privacy_budget_used", _r9("privacy_budget_used")).withColumn(
        "privacy_budget_remaining", _r9("privacy_budget_remaining")).withColumn(
        "refused", F.when(F.col("dataset") == "orders", F.lit(refused)).otherwise(0).cast("bigint"))


def q_dp_ambiguous_keys(spark, sf):
    """Rows whose key columns read alike when joined by a separator, and NULL beside the empty text, each with its own noise."""
    rows = spark.createDataFrame(_AMBIGUOUS, "a string, b string")
    both = rows.crossJoin(F.broadcast(_t(spark, sf, "region").select("r_regionkey")))  # ten inline rows, five regions
    return both.select("a", "b", "r_regionkey",
                       _r4(add_laplace(F.lit(0.0), 1.0, 1.0, SEED, row_key(["a", "b", "r_regionkey"]), "x")).alias("noise"))


_AMBIGUOUS = [("a|b", "c"), ("a", "b|c"), (None, ""), ("", None), ("", ""), (None, None), ("1:a", "b"), ("1", ":ab"), ("-", "-"), ("2:-", "")]


def q_dp_adaptive(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    out = dp.adaptive_noise(li, "l_discount", 1.0, 1e-5, 0.0, 0.1, seed=SEED, keys=LINE_KEY)
    return out.withColumn("l_discount", F.round("l_discount", 12))


def q_dp_dataset_report(spark, sf):
    _, _, comp = dp.dp_dataset(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 1.0, 1e-5,
                               seed=SEED, dataset="lineitem", keys=LINE_KEY)
    return comp.select("column", *[F.round(c, 6).alias(c) for c in ("original_mean", "noisy_mean", "absolute_error")])


# --- privacy metrics ------------------------------------------------------------

def q_metric_k_anonymity(spark, sf):
    m = metrics.k_metrics(_t(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], K)
    return m.withColumn("avg_group_size", _r9("avg_group_size"))


def q_group_size_histogram(spark, sf):
    return metrics.group_size_histogram(_t(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


def q_metric_l_diversity(spark, sf):
    m = metrics.l_metrics(_cust_gen(spark, sf), CUST_QI, "c_mktsegment", L)
    return m.withColumn("avg_diversity", _r9("avg_diversity"))


def q_column_entropy(spark, sf):
    return metrics.column_entropy(_t(spark, sf, "customer")).withColumn("entropy", _r9("entropy"))


def q_distinctness(spark, sf):
    return metrics.distinctness(_t(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"]).withColumn(
        "distinctness", _r9("distinctness"))


def q_reid_risk(spark, sf):
    r = metrics.reidentification_risk(_cust_gen(spark, sf), CUST_QI)
    for c in ("avg_risk", "max_risk", "min_risk", "high_risk_percentage", "medium_risk_percentage",
              "low_risk_percentage"):
        r = r.withColumn(c, _r9(c))
    return r


def q_record_risk(spark, sf):
    return metrics.record_risk(_cust_gen(spark, sf), CUST_QI).select("c_custkey", _r9("reid_risk").alias("reid_risk"))


# --- utility and report -------------------------------------------------------

def q_information_loss(spark, sf):
    orig = _t(spark, sf, "customer")
    anon = q_k_suppress(spark, sf)
    il = report.information_loss(orig, anon)
    return il.select("column", _r9("original_entropy").alias("original_entropy"),
                     _r9("anonymized_entropy").alias("anonymized_entropy"),
                     _r9("information_loss_pct").alias("information_loss_pct"))


NUM_COLS = ["l_extendedprice", "l_quantity", "l_discount"]


def q_numeric_error(spark, sf):
    li = _t(spark, sf, "lineitem")
    anon = li.withColumns({c: generalize_numeric(c, 0) for c in NUM_COLS})
    ne = report.numeric_error(li, anon, NUM_COLS)
    return ne.select("column", *[_r9(c).alias(c) for c in ne.columns if c != "column"])


def q_data_retention(spark, sf):
    r = report.data_retention(_t(spark, sf, "customer"), q_k_suppress(spark, sf))
    return r.withColumn("retention_rate_pct", _r9("retention_rate_pct")).withColumn(
        "suppression_rate_pct", _r9("suppression_rate_pct"))


def _cust_kl(spark, sf):
    return classes.apply_k_and_l(_cust_gen(spark, sf), CUST_QI, "c_mktsegment", K, L,
                                 {"c_acctbal": 0, "c_nationkey": 0})[0]


def q_full_report(spark, sf):
    _, df = report.full_report(_t(spark, sf, "customer"), _cust_kl(spark, sf), CUST_QI, "c_mktsegment",
                               ["c_acctbal"], K, L)
    for f in df.schema.fields:
        if isinstance(f.dataType, DoubleType):
            df = df.withColumn(f.name, _r9(f.name))
    return df


def q_recommendation(spark, sf):
    part = _t(spark, sf, "part")
    anon, _ = classes.apply_k_anonymity(part, PART_QI, K, {"p_size": 1, "p_brand": 0})
    km = metrics.k_metrics(anon, PART_QI, K).select("satisfies_k_anonymity")
    rr = metrics.reidentification_risk(anon, PART_QI).select("high_risk_percentage")
    rt = report.data_retention(part, anon).select("retention_rate_pct")
    # three one-row aggregates collapsed into one row by a union + max (no join)
    u = km.select(F.col("satisfies_k_anonymity").cast("int").alias("k_ok"), F.lit(None).cast("double").alias("hr"),
                  F.lit(None).cast("double").alias("rt"))
    u = u.unionByName(rr.select(F.lit(None).cast("int").alias("k_ok"), F.col("high_risk_percentage").alias("hr"),
                                F.lit(None).cast("double").alias("rt")))
    u = u.unionByName(rt.select(F.lit(None).cast("int").alias("k_ok"), F.lit(None).cast("double").alias("hr"),
                                F.col("retention_rate_pct").alias("rt")))
    one = u.agg(F.max("k_ok").alias("k_ok"), F.max("hr").alias("hr"), F.max("rt").alias("rt"))
    return one.select(report.recommendation(F.col("k_ok") == 1, None, F.col("hr"), F.col("rt")).alias("recommendation"))


# --- scans and checks -----------------------------------------------------------

def q_scan_sql_injection(spark, sf):
    return scan.scan(_t(spark, sf, "documents"), "text", "sql_injection", keep=["doc_id"])


def q_scan_xss(spark, sf):
    return scan.scan(_t(spark, sf, "pages"), "html", "xss", keep=["page_id"])


def q_scan_dangerous(spark, sf):
    return scan.scan(_t(spark, sf, "documents"), "text", "dangerous", keep=["doc_id"])


def q_sql_injection_pattern_counts(spark, sf):
    return scan.pattern_counts(_t(spark, sf, "documents"), "text", "sql_injection")


def q_sanitize_sql(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", checks.sanitize_sql("text").alias("text"))


def q_sanitize_xss(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", checks.sanitize_xss("text").alias("text"))


def q_check_string(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", checks.check_string("text", 1000).alias("violation"))


def q_check_username(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", checks.check_username("c_name").alias("violation"))


def q_check_identifier(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", checks.check_identifier("p_type").alias("type_violation"),
                    checks.check_identifier("p_brand").alias("brand_violation"))


def q_check_int_range(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", checks.check_int_range("p_size", 1, 45, p.schema["p_size"].dataType).alias("violation"))


def q_check_float_range(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", checks.check_float_range("c_acctbal", 0.0, 9000.0).alias("violation"))


def q_check_string_constraint(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", checks.check_string_constraint("p_name", 5, 40, r"[a-z ]+").alias("violation"))


def q_check_list(spark, sf):
    e = _t(spark, sf, "embeddings")
    return e.select("vec_id", checks.check_list("embedding", e.schema["embedding"].dataType, float, 1, 64)
                    .alias("violation"))


def _nested(depth: int) -> str:
    return '{"a":' * depth + "1" + "}" * depth


# Inline documents that fail each rule (and one that just passes), with the reason expected.
JSON_CASES = [
    (-1, '{"a": 1,', "invalid_json"), (-2, _nested(11), "too_deep"), (-3, _nested(10), None),
    (-4, '{"a": "' + "x" * 1_048_577 + '"}', "too_large"), (-5, '{"<script>x</script>": 1}', "bad_key"),
    (-6, '{"a": [1, {"b": "1 UNION SELECT secret"}]}', "bad_value"), (-7, None, None), (-8, "[]", None),
]


def q_check_json(spark, sf):
    """Every event's props, and the inline documents that fail one rule each."""
    ev = _t(spark, sf, "events").select("event_id", "props")
    cases = spark.createDataFrame([(i, text) for i, text, _ in JSON_CASES], "event_id bigint, props string")
    return scan.check_json(ev.unionByName(cases), "props", keep=["event_id"]).select("event_id", "valid", "reason")


# --- audit log analytics ----------------------------------------------------------

def q_audit_search(spark, sf):
    return audit.search(_log(spark, sf), event_type="error", start=AUDIT_FROM, end=AUDIT_TO)


def q_audit_tail(spark, sf):
    return audit.tail(_log(spark, sf), 100)


def q_audit_typed(spark, sf):
    return audit.typed_view(_log(spark, sf), "purchase", "k bigint")


# How the inline details of a field type read from an event's id, in Spark and in the oracle's SQL.
_FIELD_SPARK = {"string": lambda i: F.concat(F.lit("s"), i), "bigint": lambda i: i, "double": lambda i: i / 2,
                "boolean": lambda i: i % 2 == 0, "array<string>": lambda i: F.array(F.concat(F.lit("a"), i))}
_FIELD_SQL = {"string": "'s' || event_id", "bigint": "CAST(event_id AS VARCHAR)",
              "double": "CAST(event_id / 2 AS VARCHAR)", "boolean": "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END",
              "array<string>": "'a' || event_id"}


def _fields(event_type: str) -> list[list[str]]:
    return [f.split(" ") for f in audit.EVENT_DETAIL_FIELDS[event_type].split(", ")]


def _typed_log(spark, sf) -> DataFrame:
    """The events as log entries of the twelve types in turn, with JSON details of each type's fields."""
    types = list(audit.EVENT_DETAIL_FIELDS)
    log = _log(spark, sf)
    turn, details = F.col("seq") % len(types), F.lit(None).cast("string")
    for n, t in enumerate(types):
        fields = [_FIELD_SPARK[kind](F.col("seq")).alias(name) for name, kind in _fields(t)]
        details = F.when(turn == n, F.to_json(F.struct(*fields))).otherwise(details)
    names = F.element_at(F.array(*[F.lit(t) for t in types]), (turn + 1).cast("int"))
    return log.withColumn("details", details).withColumn("event_type", names)


def q_audit_typed_views(spark, sf):
    """All twelve typed views: each entry's detail columns, read back from its JSON details."""
    log, out = _typed_log(spark, sf), None
    for t in audit.EVENT_DETAIL_FIELDS:
        view = audit.typed_view(log, t)
        fields = view.columns[len(log.columns) - 1:]  # what follows the log's own columns but its details
        part = view.select("seq", "event_type", "success", F.concat_ws("|", *[
            F.array_join(c, "") if "array" in dict(view.dtypes)[c] else F.col(c).cast("string") for c in fields]).alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out


def _typed_views_sql() -> str:
    types = list(audit.EVENT_DETAIL_FIELDS)
    cases = " ".join(f"WHEN {n} THEN " + " || '|' || ".join(_FIELD_SQL[kind] for _, kind in _fields(t)) for n, t in enumerate(types))
    names = " ".join(f"WHEN {n} THEN {O.q(t)}" for n, t in enumerate(types))
    return (f"SELECT event_id AS seq, CASE event_id % {len(types)} {names} END AS event_type, "
            f"event_type <> 'error' AS success, CASE event_id % {len(types)} {cases} END AS fields FROM events")


def q_audit_log_file(spark, sf):
    """The events written as log lines (with broken lines among them), read back and searched."""
    from ..sources.files import read_audit_log
    from ..streaming.jobs import shared_path
    log = _log(spark, sf)
    message = F.struct("event_type", "user", "success", F.struct("details").alias("details"))
    lines = log.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "level",
                                          message.alias("message"))).alias("value"))
    broken = spark.createDataFrame([("{broken",), ('{"timestamp": "no time", "level": "ERROR", "message": '
                                                   '{"event_type": "error", "user": "x", "success": false}}',)], "value string")
    path = shared_path(spark, "audit_log")
    lines.unionByName(broken).write.text(path)
    found = audit.search(read_audit_log(spark, path), event_type="error")
    return found.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "event_type", "user", "success")


def q_rate_rules(spark, sf):
    """The six fixed rate rules in one scan, counted by log level; event types stand in for the routes."""
    routes = {"signup": "login", "purchase": "upload", "click": "anonymize", "view": "audit_logs"}
    route = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])[F.col("event_type")]
    log = _log(spark, sf).withColumn("event_type", F.coalesce(route, F.col("event_type")))
    return audit.rate_breaches_all(log, "level")


def _rate_rules_sql() -> str:
    route = ("CASE event_type WHEN 'signup' THEN 'login' WHEN 'purchase' THEN 'upload' WHEN 'click' THEN 'anonymize' "
             "WHEN 'view' THEN 'audit_logs' ELSE event_type END")
    rules = [("default", None, "day", 200), ("default", None, "hour", 50), ("login", "login", "minute", 10),
             ("upload", "upload", "minute", 10), ("anonymize", "anonymize", "hour", 20), ("audit_logs", "audit_logs", "minute", 30)]
    return " UNION ALL ".join(
        f"SELECT level, date_trunc('{unit}', ts) AS window_start, date_trunc('{unit}', ts) + INTERVAL 1 {unit} AS window_end, "
        f"count(*) AS n_events, {limit} AS \"limit\", '{name}: {limit} per 1 {unit}' AS rule "
        f"FROM (SELECT level, ts, {route} AS route FROM ({_log_sql()})) "
        + (f"WHERE route = '{kind}' " if kind else "") + f"GROUP BY level, date_trunc('{unit}', ts) HAVING count(*) > {limit}"
        for name, kind, unit, limit in rules)


def q_audit_rollup(spark, sf):
    return audit.rollup(_log(spark, sf), "day")


def q_rate_breaches(spark, sf):
    return audit.rate_breaches(_log(spark, sf), "user", "1 day", RATE_LIMIT_PER_DAY)


def _access_inputs(spark, sf):
    log = _log(spark, sf)
    perm = F.create_map(*[x for kv in EVENT_PERMISSION.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    acc = log.select("seq", "user", "event_type", F.element_at(perm, F.col("event_type")).alias("permission"))
    roles = F.array(*[F.lit(r) for r in access.ROLES])
    # stand-in user directory: one row per user seen in the log
    users = log.select("user").distinct().select(
        F.col("user").alias("username"),
        F.element_at(roles, (F.pmod(F.col("user").cast("bigint"), F.lit(len(access.ROLES))) + 1).cast("int"))
        .alias("role"),
        (F.pmod(F.col("user").cast("bigint"), F.lit(10)) != 0).alias("active"))
    return acc, users


def q_access_review(spark, sf):
    acc, users = _access_inputs(spark, sf)
    return access.access_review(acc, users)


def q_lockout_replay(spark, sf):
    ev = _t(spark, sf, "events").where(F.col("event_type").isin("error", "signup"))
    att = ev.select(F.col("user_id").alias("user"), "ts", F.col("event_id").alias("seq"),
                    (F.col("event_type") == "signup").alias("ok"))
    return lockout.lockout_replay(att)


# --- whole jobs through the sinks ------------------------------------------------

JOB_PROFILE = {
    "columns": {
        "c_name": {"transform": "mask", "params": {"keep_last": 4}},
        "c_custkey": {"transform": "hmac", "params": {"out_len": 12}},
    },
    "hmac_key": HMAC_KEY.decode(),
    "k_anonymity": {"k": K}, "l_diversity": {"l": L},
    "quasi_identifiers": CUST_QI, "generalization_levels": {"c_acctbal": 3, "c_nationkey": 0},
    "sensitive_attribute": "c_mktsegment", "seed": SEED,
}


def q_csv_round_trip(spark, sf):
    """S1 + S2: customer written as CSV to the shared folder and read back with its schema."""
    from ..sources.files import read_csv, write_csv
    from ..streaming.jobs import shared_path
    src = _t(spark, sf, "customer")
    path = shared_path(spark, "csv_round_trip")
    write_csv(src, path)
    return read_csv(spark, path, src.schema)


def q_pipeline_job(spark, sf):
    """Transforms -> k search -> l -> Parquet sink -> run log; returns the written table."""
    from ..streaming.jobs import shared_path
    base = shared_path(spark, "pipeline_job")
    res = run(_t(spark, sf, "customer"), JOB_PROFILE, output_path=f"{base}/data", log_path=f"{base}/log")
    return res.data


# --- streaming forms (run to completion over the table with availableNow) -------

STREAM_WINDOW = "1 hour"
STREAM_WATERMARK = "1 hour"


def q_stream_audit_rollup(spark, sf):
    from ..streaming import jobs
    log = audit.events_as_audit(jobs.table_stream(spark, sf, "events"))
    return jobs.run_windows(jobs.rollup_stream(log, STREAM_WINDOW, STREAM_WATERMARK), "audit_rollup").drop("final")


def q_stream_rate_breaches(spark, sf):
    from ..streaming import jobs
    log = audit.events_as_audit(jobs.table_stream(spark, sf, "events"))
    return jobs.run_windows(jobs.rate_breach_stream(log, "user", "1 day", RATE_LIMIT_PER_DAY, "1 day"),
                            "rate_breaches").drop("final")


def q_stream_profile_pipeline(spark, sf):
    from ..streaming import jobs
    return jobs.run_available(jobs.anonymize_stream(jobs.table_stream(spark, sf, "lineitem"), PIPELINE_PROFILE, SEED),
                              "profile_pipeline")


def q_stream_lockout(spark, sf):
    """Every lock with its rejected attempts, from per-user state with timers."""
    from ..streaming import jobs
    from ..streaming.lockout import lockout_stream, run_locks
    ev = jobs.table_stream(spark, sf, "events").where(F.col("event_type").isin("error", "signup"))
    att = ev.select(F.col("user_id").alias("user"), "ts", F.col("event_id").alias("seq"),
                    (F.col("event_type") == "signup").alias("ok"))
    return run_locks(lockout_stream(att), "lockout").drop("closed")


GROWING_FILES = 4


def _growing_part(spark, sf):
    """part landing in four files, one micro-batch each, with the class tables carried along."""
    from ..streaming import jobs
    from ..streaming.growing import accumulate
    landing = jobs.shared_path(spark, "growing_landing")
    part = _t(spark, sf, "part")
    part.repartition(GROWING_FILES, "p_partkey").write.parquet(landing)
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    return accumulate(stream, PART_QI, "p_type", "growing_part")


def q_stream_k_anonymize(spark, sf):
    """A5 over a table that arrived in micro-batches."""
    return _growing_part(spark, sf).k_anonymous(K, {"p_size": 1, "p_brand": 0})[0]


def q_stream_kl_anonymize(spark, sf):
    """L4 over a table that arrived in micro-batches."""
    return _growing_part(spark, sf).k_and_l(K, L, {"p_size": 1, "p_brand": 0})[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dataset_profile": q_dataset_profile,
    "preview_head": q_preview_head,
    "profile_pipeline": q_profile_pipeline,
    "mask_value": q_mask_value,
    "null_value": q_null_value,
    "salted_hash": q_salted_hash,
    "hmac_pseudonym": q_hmac_pseudonym,
    "generalize_age": q_generalize_age,
    "generalize_numeric": q_generalize_numeric,
    "substitute_values": q_substitute_values,
    "substitute_consistent": q_substitute_consistent,
    "shuffle_column": q_shuffle_column,
    "laplace_transform": q_laplace_transform,
    "k_check": q_k_check,
    "k_generalize_numeric": q_k_generalize_numeric,
    "k_generalize_string": q_k_generalize_string,
    "k_suppress": q_k_suppress,
    "k_anonymize": q_k_anonymize,
    "k_anonymize_suppress": q_k_anonymize_suppress,
    "equivalence_classes": q_equivalence_classes,
    "l_check": q_l_check,
    "l_suppress": q_l_suppress,
    "l_report": q_l_report,
    "kl_anonymize": q_kl_anonymize,
    "kl_report": q_kl_report,
    "dp_laplace": q_dp_laplace,
    "dp_gaussian": q_dp_gaussian,
    "dp_noisy_count": q_dp_noisy_count,
    "dp_noisy_sum": q_dp_noisy_sum,
    "dp_noisy_mean": q_dp_noisy_mean,
    "randomized_response": q_randomized_response,
    "dp_columns": q_dp_columns,
    "budget_ledger": q_budget_ledger,
    "dp_ambiguous_keys": q_dp_ambiguous_keys,
    "dp_adaptive": q_dp_adaptive,
    "dp_dataset_report": q_dp_dataset_report,
    "metric_k_anonymity": q_metric_k_anonymity,
    "group_size_histogram": q_group_size_histogram,
    "metric_l_diversity": q_metric_l_diversity,
    "column_entropy": q_column_entropy,
    "distinctness": q_distinctness,
    "reid_risk": q_reid_risk,
    "record_risk": q_record_risk,
    "information_loss": q_information_loss,
    "numeric_error": q_numeric_error,
    "data_retention": q_data_retention,
    "full_report": q_full_report,
    "recommendation": q_recommendation,
    "scan_sql_injection": q_scan_sql_injection,
    "scan_xss": q_scan_xss,
    "scan_dangerous": q_scan_dangerous,
    "sql_injection_pattern_counts": q_sql_injection_pattern_counts,
    "sanitize_sql": q_sanitize_sql,
    "sanitize_xss": q_sanitize_xss,
    "check_string": q_check_string,
    "check_username": q_check_username,
    "check_identifier": q_check_identifier,
    "check_int_range": q_check_int_range,
    "check_float_range": q_check_float_range,
    "check_string_constraint": q_check_string_constraint,
    "check_list": q_check_list,
    "check_json": q_check_json,
    "audit_search": q_audit_search,
    "audit_tail": q_audit_tail,
    "audit_typed": q_audit_typed,
    "audit_typed_views": q_audit_typed_views,
    "audit_log_file": q_audit_log_file,
    "rate_rules": q_rate_rules,
    "audit_rollup": q_audit_rollup,
    "rate_breaches": q_rate_breaches,
    "access_review": q_access_review,
    "lockout_replay": q_lockout_replay,
    "csv_round_trip": q_csv_round_trip,
    "pipeline_job": q_pipeline_job,
    "stream_audit_rollup": q_stream_audit_rollup,
    "stream_rate_breaches": q_stream_rate_breaches,
    "stream_profile_pipeline": q_stream_profile_pipeline,
    "stream_lockout": q_stream_lockout,
    "stream_k_anonymize": q_stream_k_anonymize,
    "stream_kl_anonymize": q_stream_kl_anonymize,
}


# ============================================================================
# Oracle SQL (DuckDB)
# ============================================================================

def _cust_gen_sql() -> str:
    return (f"SELECT c_custkey, c_name, c_nationkey, {O.gen_qi_num_sql('c_acctbal', 3)} AS c_acctbal, "
            f"c_mktsegment FROM customer")


def _part_gen_sql() -> str:
    return (f"SELECT p_partkey, p_name, p_brand, p_type, {O.gen_qi_num_sql('p_size', 1, 'INTEGER')} AS p_size, "
            f"p_retailprice FROM part")


_K_SUPPRESS = f"""
WITH g AS ({_cust_gen_sql()})
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (
  SELECT *, count(*) OVER (PARTITION BY c_acctbal, c_nationkey) AS n FROM g) WHERE n >= {K}"""

_PART_K_SUPPRESS = f"""
WITH g AS ({_part_gen_sql()})
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM (
  SELECT *, count(*) OVER (PARTITION BY p_size, p_brand) AS n FROM g) WHERE n >= {K}"""

_PART_KL = f"""
WITH k AS ({_PART_K_SUPPRESS}),
good AS (SELECT p_size, p_brand FROM k GROUP BY p_size, p_brand HAVING count(DISTINCT p_type) >= {L})
SELECT k.* FROM k SEMI JOIN good USING (p_size, p_brand)"""

_CUST_L_CLASSES = f"""
WITH g AS ({_cust_gen_sql()}),
cls AS (SELECT c_acctbal, c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS d
        FROM g GROUP BY c_acctbal, c_nationkey)"""

_CUST_KL = f"""
WITH g AS ({_cust_gen_sql()}),
k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY c_acctbal, c_nationkey) AS n FROM g) WHERE n >= {K}),
good AS (SELECT c_acctbal, c_nationkey FROM k GROUP BY 1, 2 HAVING count(DISTINCT c_mktsegment) >= {L})
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM k SEMI JOIN good USING (c_acctbal, c_nationkey)"""


def _entropy_sql(frame_sql: str, cols: list[str], tag: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c}{' + 0.0' if c in DOUBLE_COLS else ''} AS VARCHAR) AS v "
        f"FROM f_{tag} WHERE {c} IS NOT NULL" for c in cols)
    return f"""f_{tag} AS ({frame_sql}),
cnt_{tag} AS (SELECT col, v, count(*) AS n FROM ({parts}) GROUP BY col, v),
ent_{tag} AS (SELECT col, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM cnt_{tag} GROUP BY col)"""


CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
DOUBLE_COLS = {"c_acctbal"}  # -0.0 and 0.0 are one value when counting


def _rec_sql(k_ok: str, l_ok: str | None, hr: str, rt: str) -> str:
    parts = [f"CASE WHEN NOT ({k_ok}) THEN 'CRITICAL: k-anonymity not satisfied. Increase generalization or suppression.' END"]
    if l_ok:
        parts.append(f"CASE WHEN NOT ({l_ok}) THEN 'WARNING: l-diversity not satisfied. Consider data augmentation or suppression.' END")
    h1, h2 = "ALERT: ", "% of records at high re-identification risk."
    r1, r2 = "WARNING: Low data retention (", "%). Consider less aggressive anonymization."
    parts.append(f"CASE WHEN {hr} > 10 THEN {O.q(h1)} || printf('%.1f', {hr}) || {O.q(h2)} END")
    parts.append(f"CASE WHEN {rt} < 50 THEN {O.q(r1)} || printf('%.1f', {rt}) || {O.q(r2)} END")
    j = f"concat_ws(' ', {', '.join(parts)})"
    return f"CASE WHEN {j} = '' THEN 'All privacy requirements met with acceptable utility. Dataset is ready for sharing.' ELSE {j} END"


def _full_report_sql() -> str:
    c = f"""
WITH anon AS ({_CUST_KL}),
cls AS (SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS d FROM anon GROUP BY c_acctbal, c_nationkey),
cm AS (SELECT count(*) AS num_groups, min(n) AS mn, max(n) AS mx, avg(n) AS av,
              min(d) AS dmn, max(d) AS dmx, avg(d) AS dav,
              count(*) FILTER (WHERE d >= {L}) AS dok, count(*) FILTER (WHERE d < {L}) AS dbad,
              avg(1.0 / n) AS ar, max(1.0 / n) AS xr, min(1.0 / n) AS nr,
              coalesce(sum(n) FILTER (WHERE 1.0 / n > 0.33), 0) AS hi,
              coalesce(sum(n) FILTER (WHERE 1.0 / n > 0.10 AND 1.0 / n <= 0.33), 0) AS me,
              coalesce(sum(n) FILTER (WHERE 1.0 / n <= 0.10), 0) AS lo,
              sum(n) AS tot FROM cls),
ret AS (SELECT (SELECT count(*) FROM customer) AS o, (SELECT count(*) FROM anon) AS a),
{_entropy_sql("SELECT * FROM customer", CUST_COLS, "o")},
{_entropy_sql("SELECT * FROM anon", CUST_COLS, "a")},
loss AS (SELECT avg(CASE WHEN coalesce(o.h, 0) > 0 THEN (coalesce(o.h, 0) - coalesce(a.h, 0)) / coalesce(o.h, 0) * 100
                    ELSE 0.0 END) AS avg_loss, count(*) AS ncols
         FROM (SELECT unnest({CUST_COLS!r}) AS col) c LEFT JOIN ent_o o USING (col) LEFT JOIN ent_a a USING (col)),
fig AS (SELECT cm.*, ret.o, ret.a, loss.avg_loss, loss.ncols,
               CASE WHEN ret.o > 0 THEN ret.a / ret.o * 100.0 ELSE 0.0 END AS rt,
               CASE WHEN tot > 0 THEN hi / tot * 100.0 ELSE 0.0 END AS hr,
               coalesce(mn, 0) >= {K} AND num_groups > 0 AS k_ok,
               dmn IS NOT NULL AND dmn >= {L} AS l_ok
        FROM cm, ret, loss)
SELECT CAST(coalesce(mn, 0) AS BIGINT) AS k_value, k_ok AS satisfies_k_anonymity,
       CAST(coalesce(mn, 0) AS BIGINT) AS min_group_size, CAST(coalesce(mx, 0) AS BIGINT) AS max_group_size,
       round(coalesce(av, 0.0), 9) AS avg_group_size, CAST(num_groups AS BIGINT) AS num_groups,
       CAST(coalesce(dmn, 0) AS BIGINT) AS l_value, l_ok AS satisfies_l_diversity,
       CAST(coalesce(dmn, 0) AS BIGINT) AS min_diversity, CAST(coalesce(dmx, 0) AS BIGINT) AS max_diversity,
       round(coalesce(dav, 0.0), 9) AS avg_diversity, CAST(dok AS BIGINT) AS groups_satisfying_l,
       CAST(dbad AS BIGINT) AS groups_not_satisfying_l,
       round(coalesce(ar, 0.0), 9) AS avg_risk, round(coalesce(xr, 0.0), 9) AS max_risk,
       round(coalesce(nr, 0.0), 9) AS min_risk,
       CAST(hi AS BIGINT) AS records_at_high_risk, CAST(me AS BIGINT) AS records_at_medium_risk,
       CAST(lo AS BIGINT) AS records_at_low_risk, round(hr, 9) AS high_risk_percentage,
       round(CASE WHEN tot > 0 THEN me / tot * 100.0 ELSE 0.0 END, 9) AS medium_risk_percentage,
       round(CASE WHEN tot > 0 THEN lo / tot * 100.0 ELSE 0.0 END, 9) AS low_risk_percentage,
       CAST(o AS BIGINT) AS original_records, CAST(a AS BIGINT) AS anonymized_records,
       CAST(o - a AS BIGINT) AS suppressed_records, round(rt, 9) AS retention_rate_pct,
       round(CASE WHEN o > 0 THEN (o - a) / o * 100.0 ELSE 0.0 END, 9) AS suppression_rate_pct,
       round(avg_loss, 9) AS avg_information_loss_pct, CAST(ncols AS BIGINT) AS columns_analyzed,
       k_ok AND l_ok AS privacy_requirements_met,
       {_rec_sql("k_ok", "l_ok", "hr", "rt")} AS recommendation,
       CAST(CASE WHEN k_ok THEN 20 ELSE 80 END AS BIGINT)
         AS dashboard_risk_score
FROM fig"""
    return c


def _recommendation_sql() -> str:
    return f"""
WITH anon AS ({_PART_K_SUPPRESS}),
cls AS (SELECT count(*) AS n FROM anon GROUP BY p_size, p_brand),
f AS (SELECT min(n) >= {K} AS k_ok, sum(n) AS tot,
             coalesce(sum(n) FILTER (WHERE 1.0 / n > 0.33), 0) AS hi FROM cls),
r AS (SELECT (SELECT count(*) FROM part) AS o, (SELECT count(*) FROM anon) AS a),
x AS (SELECT coalesce(k_ok, false) AS k_ok,
             CASE WHEN tot > 0 THEN hi / tot * 100.0 ELSE 0.0 END AS hr,
             CASE WHEN o > 0 THEN a / o * 100.0 ELSE 0.0 END AS rt FROM f, r)
SELECT {_rec_sql("k_ok", None, "hr", "rt")} AS recommendation FROM x"""


def _check_string_sql() -> str:
    s = O.strip_sql("text")
    return f"""SELECT conv_id, turn, CASE
  WHEN text IS NULL THEN 'not_string'
  WHEN length({s}) > 1000 THEN 'too_long'
  WHEN {O.any_match(s, O.SQLI_RE2)} THEN 'sql_injection'
  WHEN {O.any_match(s, O.XSS_RE2)} THEN 'xss'
  WHEN {O.any_match(s, O.DANGEROUS_RE2)} THEN 'dangerous' END AS violation FROM conversations"""


def _identifier_sql(c: str) -> str:
    s = O.strip_sql(f"replace({c}, chr(0), '')")
    return (f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'empty' WHEN length({s}) > 255 THEN 'too_long' "
            f"WHEN {O.any_match(s, O.DANGEROUS_RE2)} THEN 'dangerous' "
            f"WHEN NOT regexp_matches({s}, '^[A-Za-z0-9_-]+$') THEN 'charset' END")


def _sanitize_xss_sql() -> str:
    s = "text"
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = f"replace({s}, {O.q(old)}, {O.q(new)})"
    s = f"regexp_replace({s}, '<script[^>]*>.*?</script>', '', 'gis')"
    s = f"regexp_replace({s}, 'javascript:', '', 'gi')"
    s = f"regexp_replace({s}, {O.q(O.XSS_RE2[1])}, '', 'gi')"
    return f"SELECT conv_id, turn, {s} AS text FROM conversations"


def _sanitize_sql_sql() -> str:
    s = "replace(text, chr(0), '')"
    for old, new in (("'", "''"), (";", ""), ("--", ""), ("/*", ""), ("*/", ""), ("xp_", "")):
        s = f"replace({s}, {O.q(old)}, {O.q(new)})"
    return f"SELECT conv_id, turn, {O.strip_sql(s)} AS text FROM conversations"


def _check_json_sql() -> str:
    bad = lambda e: f"({O.any_match(e, O.SQLI_RE2)} OR {O.any_match(e, O.XSS_RE2)})"
    return f"""
WITH RECURSIVE docs AS (
  SELECT event_id, props, octet_length(encode(props)) > 1048576 AS too_large,
         props IS NOT NULL AND NOT coalesce(json_valid(props), false) AS invalid FROM events),
t AS (SELECT d.event_id, j.id, j.parent, j.key, j.type, j.value FROM docs d, json_tree(d.props) j
      WHERE NOT d.too_large AND NOT d.invalid),
tp AS (SELECT t.*, p.type AS ptype FROM t LEFT JOIN t p ON p.event_id = t.event_id AND p.id = t.parent),
dep(event_id, id, depth) AS (
  SELECT event_id, id, 0 FROM t WHERE parent IS NULL
  UNION ALL SELECT t.event_id, t.id, dep.depth + 1 FROM t JOIN dep ON t.event_id = dep.event_id AND t.parent = dep.id),
f AS (SELECT tp.event_id,
             bool_or(dep.depth > 10) AS deep,
             bool_or(tp.ptype = 'OBJECT' AND {bad('tp.key')}) AS bkey,
             bool_or(tp.type = 'VARCHAR' AND {bad("(tp.value ->> '$')")}) AS bval
      FROM tp JOIN dep ON tp.event_id = dep.event_id AND tp.id = dep.id GROUP BY tp.event_id),
r AS (SELECT docs.event_id, CASE WHEN docs.too_large THEN 'too_large' WHEN docs.invalid THEN 'invalid_json'
             WHEN coalesce(f.deep, false) THEN 'too_deep' WHEN coalesce(f.bkey, false) THEN 'bad_key'
             WHEN coalesce(f.bval, false) THEN 'bad_value' END AS reason
      FROM docs LEFT JOIN f USING (event_id))
SELECT event_id, reason IS NULL AS valid, reason FROM r"""


def _log_sql() -> str:
    return ("SELECT event_id AS seq, ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, "
            "event_type, CAST(user_id AS VARCHAR) AS \"user\", event_type <> 'error' AS success, props AS details "
            "FROM events")


def _access_sql() -> str:
    perm = " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in EVENT_PERMISSION.items())
    # fixed values, stated apart from the operator: the grants of each role
    by_role = {
        "admin": "read_data write_data mask_data anonymize_data configure_profile view_audit_logs manage_users export_data "
                 "delete_data configure_k_anonymity configure_l_diversity configure_diff_privacy",
        "data_owner": "read_data write_data mask_data anonymize_data configure_profile export_data configure_k_anonymity "
                      "configure_l_diversity configure_diff_privacy",
        "data_analyst": "read_data export_data",
        "viewer": "read_data",
    }
    roles = " ".join(f"WHEN {i} THEN {O.q(r)}" for i, r in enumerate(by_role))
    grants = ", ".join(f"({O.q(r)}, {O.q(p)})" for r, held in by_role.items() for p in held.split())
    return f"""
WITH log AS ({_log_sql()}),
acc AS (SELECT seq, "user", event_type, CASE event_type {perm} END AS permission FROM log),
users AS (SELECT DISTINCT "user" AS username,
            CASE CAST(CAST("user" AS BIGINT) % {len(by_role)} AS INTEGER) {roles} END AS role,
            CAST("user" AS BIGINT) % 10 <> 0 AS active FROM log),
rp(role, permission) AS (VALUES {grants})
SELECT acc.seq, acc."user", acc.event_type, acc.permission, users.role, users.active,
       coalesce(users.active, false) AND rp.role IS NOT NULL AS granted
FROM acc LEFT JOIN users ON acc."user" = users.username
LEFT JOIN rp ON users.role = rp.role AND acc.permission = rp.permission"""


def _lockout_sql() -> str:
    """Sequential statement of the lockout rule: a recursive walk over each user's attempts."""
    lim, mins = 5, 15  # the rule, stated apart from the operator
    rej = "(st.until IS NOT NULL AND n.ts < st.until)"
    c0 = "(CASE WHEN st.until IS NOT NULL THEN 0 ELSE st.cnt END)"
    tail = ", CAST(coalesce(r.r, 0) AS BIGINT) AS rejected_while_locked"
    return f"""
WITH RECURSIVE a AS (
  SELECT CAST(user_id AS VARCHAR) AS "user", ts, event_id AS seq, event_type = 'signup' AS ok
  FROM events WHERE event_type IN ('error', 'signup')),
n AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts, seq) AS i FROM a),
st("user", i, cnt, until, new_lock, rejected) AS (
  SELECT DISTINCT "user", CAST(0 AS BIGINT), 0, CAST(NULL AS TIMESTAMP), false, false FROM n
  UNION ALL
  SELECT n."user", n.i,
         CASE WHEN {rej} THEN st.cnt WHEN n.ok THEN 0 ELSE {c0} + 1 END,
         CASE WHEN {rej} THEN st.until WHEN NOT n.ok AND {c0} + 1 >= {lim}
              THEN n.ts + INTERVAL {mins} MINUTE ELSE NULL END,
         NOT {rej} AND NOT n.ok AND {c0} + 1 >= {lim},
         {rej}
  FROM st JOIN n ON n."user" = st."user" AND n.i = st.i + 1),
locks AS (SELECT st."user", n.ts AS locked_at, st.until AS locked_until
          FROM st JOIN n ON n."user" = st."user" AND n.i = st.i WHERE st.new_lock),
r AS (SELECT "user", until, count(*) AS r FROM st WHERE rejected GROUP BY 1, 2)
SELECT l."user", l.locked_at, l.locked_until{tail}
FROM locks l LEFT JOIN r ON r."user" = l."user" AND r.until = l.locked_until"""


def _shuffle_sql(columns: dict[str, str] = {"c_acctbal": "c_acctbal", "c_mktsegment": "c_mktsegment"}, seed: int = SEED) -> str:
    """Columns of customer by the names they are shuffled under, each moved by its Feistel network over places in key order, walked until inside."""
    from ..functions.permute import PRIMES, Permutation

    def network(name: str, x: str, table: str) -> str:
        """SELECT src, one pass of x: each round is one more nested select."""
        out = f"SELECT src, n, a, b, {x} // b AS l, {x} % b AS r FROM {table}"
        for i, (m1, c1, m2, c2) in enumerate(Permutation(0, seed, name).constants()):
            half, other = ("r", "l") if i % 2 == 0 else ("l", "r")
            moved = f"({other} + ((({half} * {m1} + {c1}) % {PRIMES[0]}) * {m2} + {c2}) % {PRIMES[1]}) % {'a' if other == 'l' else 'b'}"
            out = f"SELECT src, n, a, b, {moved if other == 'l' else 'l'} AS l, {moved if other == 'r' else 'r'} AS r FROM ({out})"
        return f"SELECT src, n, a, b, l * b + r AS x FROM ({out})"

    def walk(name: str) -> str:
        return f"""w_{name}(src, n, a, b, x) AS (
  {network(name, 'src', 'size')} UNION ALL {network(name, 'x', f'(SELECT * FROM w_{name} WHERE x >= n)')}
)"""

    joins = " ".join(f"JOIN w_{c} ON w_{c}.x = i.src AND w_{c}.x < w_{c}.n JOIN i AS i_{c} ON i_{c}.src = w_{c}.src" for c in columns)
    return f"""
WITH RECURSIVE i AS (SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS src, * FROM customer),
root AS (SELECT src, n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM i, (SELECT count(*) AS n FROM customer)),
size AS (SELECT src, n, a, (n + a - 1) // a AS b FROM root),
{', '.join(walk(c) for c in columns)}
SELECT i.c_custkey, {', '.join(f'i_{c}.{x} AS {c}' for c, x in columns.items())} FROM i {joins}"""


def _lane_sql(key: str, name: str, lane: int, seed: int = SEED) -> str:
    """40 bits of SHA-256 of 'seed|length:name|+key' ('-' for a NULL key): three draws in each 30 hex digits."""
    digest = f"sha256('{seed}|{len(name)}:{name}|' || coalesce('+' || ({key}), '-'))"
    pair, place = divmod(lane, 3)
    first, second = (f"('0x' || substr({digest}, {1 + 15 * (2 * pair + i)}, 15))::BIGINT" for i in (0, 1))
    return (f"({first} >> 20)", f"((({first} & 1048575) << 20) | ({second} >> 40))", f"({second} & 1099511627775)")[place]


def _named_sql(*parts: str) -> str:
    return "".join(f"{len(p)}:{p}" for p in parts)


def _key_sql(*columns: str) -> str:
    """Each column as length and text, NULL as a dash."""
    text = [f"CAST({c} AS VARCHAR)" for c in columns]
    return "(" + " || ".join(f"coalesce(length({t}) || ':' || {t}, '-')" for t in text) + ")"


def _substitute_consistent_sql() -> str:
    """Consistent fake names: word lists indexed by draws from the value."""
    from ..functions.substitute import FIRST_NAMES, LAST_NAMES
    def pick(words, draw):
        lst = "[" + ", ".join(O.q(w) for w in words) + "]"
        return f"{lst}[{_lane_sql('CAST(o_custkey AS VARCHAR)', '0', draw)} % {len(words)} + 1]"
    return (f"SELECT o_orderkey, CASE WHEN o_custkey IS NULL THEN NULL ELSE "
            f"{pick(FIRST_NAMES, 0)} || ' ' || {pick(LAST_NAMES, 1)} END AS customer_alias FROM orders")


def _u_sql(key: str, name: str, lane: int = 0, seed: int = SEED) -> str:
    return f"(({_lane_sql(key, name, lane, seed)}::DOUBLE + 0.5) / 1099511627776.0)"


def _laplace_sql(key: str, name: str, scale: str, lane: int = 0, seed: int = SEED) -> str:
    u = f"({_u_sql(key, name, lane, seed)} - 0.5)"
    return f"(sign({u}) * ln(1.0 - 2.0 * abs({u})) * -({scale}))"


_LINE_KEY_SQL = _key_sql("l_orderkey", "l_linenumber")


def _substitute_values_sql() -> str:
    """Every fake value type, drawn from the customer's key and the type, six draws to a digest."""
    from ..functions import substitute as s

    def d(t, i, n):
        return f"({_lane_sql(_key_sql('c_custkey'), f'{t}|{(i - 1) // 6}', (i - 1) % 6)} % {n})"

    def pick(t, i, words):
        return f"[{', '.join(O.q(w) for w in words)}][{d(t, i, len(words))} + 1]"

    def digits(t, i, k):
        return f"lpad(CAST({d(t, i, 10 ** k)} AS VARCHAR), {k}, '0')"

    def pad(x, k):
        return f"lpad(CAST({x} AS VARCHAR), {k}, '0')"

    body = [d("credit_card", i + 1, 10) for i in range(15)]
    doubled = [f"(CASE WHEN {x} * 2 > 9 THEN {x} * 2 - 9 ELSE {x} * 2 END)" if j % 2 == 0 else x for j, x in enumerate(body)]
    check = f"((10 - ({' + '.join(doubled)}) % 10) % 10)"
    sentence = " || ' ' || ".join(pick("text", i + 1, s.WORDS) for i in range(8))
    fakes = {
        "name": f"{pick('name', 1, s.FIRST_NAMES)} || ' ' || {pick('name', 2, s.LAST_NAMES)}",
        "email": f"lower({pick('email', 1, s.FIRST_NAMES)}) || '.' || lower({pick('email', 2, s.LAST_NAMES)}) || "
                 f"CAST({d('email', 3, 100)} AS VARCHAR) || '@' || {pick('email', 4, s.EMAIL_DOMAINS)}",
        "phone": f"'(' || CAST({d('phone', 1, 800)} + 200 AS VARCHAR) || ') ' || {digits('phone', 2, 3)} || '-' || "
                 f"{digits('phone', 3, 4)}",
        "address": f"CAST({d('address', 1, 9899)} + 100 AS VARCHAR) || ' ' || {pick('address', 2, s.STREET_NAMES)} || "
                   f"', ' || {pick('address', 3, s.CITIES)}",
        "company": f"{pick('company', 1, s.COMPANY_WORDS)} || ' ' || {pick('company', 2, s.COMPANY_SUFFIXES)}",
        "ssn": f"{pad(d('ssn', 1, 899) + ' + 1', 3)} || '-' || {pad(d('ssn', 2, 99) + ' + 1', 2)} || '-' || "
               f"{pad(d('ssn', 3, 9999) + ' + 1', 4)}",
        "credit_card": " || ".join(f"CAST({x} AS VARCHAR)" for x in [*body, check]),
        "date": f"strftime(DATE '1940-01-01' + CAST({d('date', 1, 365 * 66)} AS INTEGER), '%Y-%m-%d')",
        "city": pick("city", 1, s.CITIES),
        "country": pick("country", 1, s.COUNTRIES),
        "zipcode": digits("zipcode", 1, 5),
        "url": f"'https://www.' || {pick('url', 1, s.WORDS)} || '.' || {pick('url', 2, s.TLDS)} || '/'",
        "ip": " || '.' || ".join(f"CAST({d('ip', i + 1, 256)} AS VARCHAR)" for i in range(4)),
        "text": f"upper(left({sentence}, 1)) || substr({sentence}, 2) || '.'",
        "other": pick("other", 1, s.WORDS),
    }
    return "SELECT c_custkey, " + ", ".join(
        f"CASE WHEN c_name IS NULL THEN NULL ELSE {x} END AS fake_{t}" for t, x in fakes.items()) + " FROM customer"


def _noise_sql() -> dict[str, str]:
    """The noisy queries: inverse-CDF Laplace and Box-Muller noise from keyed draws, epsilon 1."""
    key, price = _LINE_KEY_SQL, "l_extendedprice"
    normal = (f"(sqrt(-2.0 * ln({_u_sql(key, price)})) * cos(2.0 * pi() * {_u_sql(key, price, 1)}) * "
              "sqrt(2.0 * ln(1.25 / 0.00001)))")
    flag = "l_returnflag"
    clamped = f"greatest(0.0, least(0.1, l_discount + {_laplace_sql(key, 'l_discount', '0.1 / (SELECT count(l_discount) FROM lineitem)')}))"
    noisy = {c: f"({c} + {_laplace_sql(key, c, '1.0')})" for c in ("l_quantity", price)}
    group, returned = _key_sql("o_orderstatus", "o_orderpriority"), _key_sql(flag)
    columns = _named_sql("columns", "l_quantity", price, "l_discount")
    report = _named_sql("columns", "l_quantity", price)
    return {
        "laplace_transform": f"SELECT l_orderkey, l_linenumber, round({price} + {_laplace_sql(key, 'laplace', '1.0')}, 4) AS price_noisy FROM lineitem",
        "dp_laplace": f"SELECT l_orderkey, l_linenumber, round({noisy[price]}, 4) AS {price} FROM lineitem",
        "dp_gaussian": f"SELECT l_orderkey, l_linenumber, round({price} + {normal}, 4) AS {price} FROM lineitem",
        "dp_noisy_count": f"SELECT o_orderstatus, o_orderpriority, greatest(0, CAST(round_even(count(*) + {_laplace_sql(group, 'noisy_count', '1.0')}, 0) AS BIGINT)) AS noisy_count FROM orders GROUP BY o_orderstatus, o_orderpriority",
        "dp_noisy_sum": f"SELECT {flag}, round(sum({price}) + max(abs({price})) * {_laplace_sql(returned, _named_sql('noisy_sum', price), '1.0')}, 2) AS noisy_sum, true AS data_dependent_sensitivity FROM lineitem GROUP BY {flag}",
        "dp_noisy_mean": f"SELECT {flag}, round(avg(l_quantity) + (max(l_quantity) - min(l_quantity)) / count(l_quantity) * {_laplace_sql(returned, _named_sql('noisy_mean', 'l_quantity'), '1.0')}, 4) AS noisy_mean, true AS data_dependent_sensitivity FROM lineitem GROUP BY {flag}",
        "randomized_response": f"SELECT doc_id, CASE WHEN {_u_sql(_key_sql('doc_id'), 'response')} < exp(1.0) / (1.0 + exp(1.0)) THEN toxic = 1 ELSE NOT (toxic = 1) END AS toxic_reported FROM labels",
        "dp_columns": f"SELECT * REPLACE (round(l_quantity + {_laplace_sql(key, columns, '1.0')}, 4) + 0.0 AS l_quantity, round({price} + {_laplace_sql(key, columns, '100.0', 1)}, 4) AS {price}, round(l_discount + {_laplace_sql(key, columns, '1.0', 2)}, 4) + 0.0 AS l_discount) FROM lineitem",
        "dp_ambiguous_keys": "SELECT a, b, r_regionkey, round(" + _laplace_sql(_key_sql("a", "b", "r_regionkey"), "x", "1.0") + ", 4) + 0.0 AS noise FROM (VALUES "
                             + ", ".join(f"({', '.join('NULL' if x is None else O.q(x) for x in r)})" for r in _AMBIGUOUS) + ") v(a, b), region",
        "dp_adaptive": f"SELECT l_orderkey, l_linenumber, round({clamped}, 12) AS l_discount FROM lineitem",
        "dp_dataset_report": " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS original_mean, round(avg({x}), 6) AS noisy_mean, round(abs(avg({c}) - avg({x})), 6) AS absolute_error FROM lineitem"
            for c, x in ((c, f"({c} + {_laplace_sql(key, report, '1.0', i)})") for i, c in enumerate(("l_quantity", price)))),
    }


def _profile_pipeline_sql() -> str:
    return f"""SELECT {O.hmac_sql('l_orderkey', HMAC_KEY, 12)} AS l_orderkey,
  sha256({O.q(SALT)} || CAST(l_partkey AS VARCHAR)) AS l_partkey, l_suppkey, l_linenumber,
  {O.age_sql('l_quantity')} AS l_quantity, {O.gen_numeric_sql('l_extendedprice', 0)} AS l_extendedprice,
  {O.gen_numeric_sql('l_discount', 1)} AS l_discount, CAST(NULL AS DOUBLE) AS l_tax,
  {O.mask_sql('l_returnflag', 4)} AS l_returnflag, {O.mask_sql('l_linestatus', 0, '#')} AS l_linestatus,
  l_shipdate FROM lineitem"""


ORACLE_SQL: dict[str, str] = {
    "dataset_profile": " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, "
        f"count({c}) AS n_non_null, count(DISTINCT {c}) AS n_distinct FROM customer"
        for i, (c, t) in enumerate(zip(CUST_COLS, ["bigint", "string", "int", "double", "string"]))),
    "preview_head": f"SELECT c_custkey, {O.mask_sql('c_name')} AS c_name, c_nationkey, c_acctbal, c_mktsegment "
                    f"FROM customer ORDER BY c_custkey LIMIT 10",
    "profile_pipeline": _profile_pipeline_sql(),
    "mask_value": f"SELECT c_custkey, {O.mask_sql('c_name')} AS c_name, {O.mask_sql('c_mktsegment', 2, '#')} "
                  f"AS c_mktsegment, {O.mask_sql('c_custkey', 0)} AS key_masked FROM customer",
    "null_value": "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer",
    "salted_hash": f"SELECT c_custkey, sha256({O.q(SALT)} || c_name) AS c_name_hash, "
                   f"sha256(CAST(c_custkey AS VARCHAR)) AS key_hash FROM customer",
    "hmac_pseudonym": f"SELECT c_custkey, {O.hmac_sql('c_name', HMAC_KEY, 12)} AS c_name_pseudo, "
                      f"{O.hmac_sql('c_custkey', HMAC_KEY, 16)} AS key_pseudo FROM customer",
    "generalize_age": f"SELECT p_partkey, {O.age_sql('p_size')} AS size_band, "
                      f"{O.age_sql('p_size', [0, 10, 20, 30, 40, 50])} AS size_band_custom, "
                      f"{O.age_width_sql('p_size', 10)} AS size_band_width FROM part",
    "generalize_numeric": f"SELECT l_orderkey, l_linenumber, {O.gen_numeric_sql('l_extendedprice', 0)} AS price_p0, "
                          f"{O.gen_numeric_sql('l_extendedprice', 1)} AS price_p1, "
                          f"{O.gen_numeric_sql('l_discount', 1)} AS discount_p1, "
                          f"{O.gen_numeric_sql('l_extendedprice', -2)} AS price_m2 FROM lineitem",
    "shuffle_column": _shuffle_sql(),
    "k_check": f"""SELECT CASE WHEN count(*) = 0 THEN true ELSE min(n) >= {K} END AS satisfies,
        CAST(coalesce(min(n), 0) AS BIGINT) AS min_group_size
        FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)""",
    "k_generalize_numeric": f"SELECT c_custkey, {O.gen_qi_num_sql('c_acctbal', 2)} AS c_acctbal, "
                            f"{O.gen_qi_num_sql('c_nationkey', 1, 'INTEGER')} AS c_nationkey FROM customer",
    "k_generalize_string": f"SELECT p_partkey, {O.gen_qi_str_sql('p_brand', 1)} AS p_brand, "
                           f"{O.gen_qi_str_sql('p_type', 3)} AS p_type, {O.gen_qi_str_sql('p_name', 5)} AS p_name "
                           f"FROM part",
    "k_suppress": _K_SUPPRESS,
    "k_anonymize": f"SELECT p_partkey, p_name, {O.gen_qi_str_sql('p_brand', 1)} AS p_brand, p_type, "
                   f"{O.gen_qi_num_sql('p_size', 1, 'INTEGER')} AS p_size, p_retailprice FROM part",
    "k_anonymize_suppress": _PART_K_SUPPRESS,
    "equivalence_classes": "SELECT c_nationkey, c_mktsegment, count(*) AS class_size, "
                           f"substr(sha256({_key_sql('c_nationkey', 'c_mktsegment')}), 1, 32) AS class_id "
                           "FROM customer GROUP BY c_nationkey, c_mktsegment",
    "l_check": f"""{_CUST_L_CLASSES}
        SELECT CASE WHEN count(*) = 0 THEN true ELSE min(d) >= {L} END AS satisfies,
               CAST(coalesce(min(d), 0) AS BIGINT) AS min_diversity FROM cls""",
    "l_suppress": f"""{_CUST_L_CLASSES}
        SELECT g.* FROM g SEMI JOIN (SELECT * FROM cls WHERE d >= {L}) ok USING (c_acctbal, c_nationkey)""",
    "l_report": f"""{_CUST_L_CLASSES}
        SELECT coalesce(min(d), 0) >= {L} AS satisfies_l_diversity, CAST(coalesce(min(d), 0) AS BIGINT) AS min_diversity,
               CAST(coalesce(max(d), 0) AS BIGINT) AS max_diversity, round(coalesce(avg(d), 0.0), 9) AS avg_diversity,
               count(*) AS num_equivalence_classes, CAST(coalesce(min(n), 0) AS BIGINT) AS records_per_class_min,
               CAST(coalesce(max(n), 0) AS BIGINT) AS records_per_class_max,
               round(coalesce(avg(n), 0.0), 9) AS records_per_class_avg FROM cls""",
    "kl_anonymize": _PART_KL,
    "kl_report": f"""WITH fin AS ({_PART_KL}),
        cls AS (SELECT count(*) AS n, count(DISTINCT p_type) AS d FROM fin GROUP BY p_size, p_brand),
        o AS (SELECT count(*) AS o FROM part), a AS (SELECT count(*) AS a FROM fin),
        s AS (SELECT count(*) AS nc, min(n) AS mn, min(d) AS md FROM cls)
        SELECT CAST(o AS BIGINT) AS original_records, CAST(a AS BIGINT) AS anonymized_records,
               CAST(o - a AS BIGINT) AS records_suppressed,
               round(CASE WHEN o > 0 THEN (o - a) / o * 100 ELSE 0 END, 9) AS suppression_rate,
               CAST({K} AS BIGINT) AS k, CASE WHEN nc = 0 THEN true ELSE mn >= {K} END AS k_satisfies,
               CAST(coalesce(mn, 0) AS BIGINT) AS min_group_size, CAST({L} AS BIGINT) AS l,
               CASE WHEN nc = 0 THEN true ELSE md >= {L} END AS l_satisfies,
               CAST(coalesce(md, 0) AS BIGINT) AS min_diversity FROM o, a, s""",
    "budget_ledger": """SELECT dataset, epsilon, used AS privacy_budget_used, epsilon - used AS privacy_budget_remaining,
  used >= epsilon AS budget_exhausted, CAST(charges AS BIGINT) AS charges, CAST(refused AS BIGINT) AS refused
FROM (VALUES ('orders', 2.0::DOUBLE, 2.0::DOUBLE, 2, 1), ('lineitem', 2.0, 0.75, 3, 0), ('part', 1.0, 0.0, 0, 0)) v(dataset, epsilon, used, charges, refused)""",
    "metric_k_anonymity": f"""SELECT CAST(coalesce(min(n), 0) AS BIGINT) AS k_value,
        coalesce(min(n), 0) >= {K} AS satisfies_k_anonymity, CAST(coalesce(min(n), 0) AS BIGINT) AS min_group_size,
        CAST(coalesce(max(n), 0) AS BIGINT) AS max_group_size, round(coalesce(avg(n), 0.0), 9) AS avg_group_size,
        count(*) AS num_groups FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)""",
    "group_size_histogram": """SELECT n AS group_size, count(*) AS num_groups
        FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) GROUP BY n""",
    "metric_l_diversity": f"""{_CUST_L_CLASSES}
        SELECT CAST(coalesce(min(d), 0) AS BIGINT) AS l_value, min(d) IS NOT NULL AND min(d) >= {L} AS satisfies_l_diversity,
               CAST({L} AS BIGINT) AS required_l, CAST(coalesce(min(d), 0) AS BIGINT) AS min_diversity,
               CAST(coalesce(max(d), 0) AS BIGINT) AS max_diversity, round(coalesce(avg(d), 0.0), 9) AS avg_diversity,
               CAST(count(*) FILTER (WHERE d >= {L}) AS BIGINT) AS groups_satisfying_l,
               CAST(count(*) FILTER (WHERE d < {L}) AS BIGINT) AS groups_not_satisfying_l FROM cls""",
    "column_entropy": f"""WITH {_entropy_sql("SELECT * FROM customer", CUST_COLS, "o")}
        SELECT c.col AS "column", round(coalesce(h, 0.0), 9) AS entropy
        FROM (SELECT unnest({CUST_COLS!r}) AS col) c LEFT JOIN ent_o USING (col)""",
    "distinctness": """SELECT round(CASE WHEN count(*) > 0 THEN count(*) / sum(n) ELSE 0.0 END, 9) AS distinctness
        FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)""",
    "reid_risk": f"""WITH g AS ({_cust_gen_sql()}),
        cls AS (SELECT count(*) AS n FROM g GROUP BY c_acctbal, c_nationkey),
        a AS (SELECT avg(1.0 / n) AS ar, max(1.0 / n) AS xr, min(1.0 / n) AS nr,
                     coalesce(sum(n) FILTER (WHERE 1.0 / n > 0.33), 0) AS hi,
                     coalesce(sum(n) FILTER (WHERE 1.0 / n > 0.10 AND 1.0 / n <= 0.33), 0) AS me,
                     coalesce(sum(n) FILTER (WHERE 1.0 / n <= 0.10), 0) AS lo FROM cls),
        t AS (SELECT count(*) AS tot FROM g)
        SELECT round(coalesce(ar, 0.0), 9) AS avg_risk, round(coalesce(xr, 0.0), 9) AS max_risk,
               round(coalesce(nr, 0.0), 9) AS min_risk, CAST(hi AS BIGINT) AS records_at_high_risk,
               CAST(me AS BIGINT) AS records_at_medium_risk, CAST(lo AS BIGINT) AS records_at_low_risk,
               round(CASE WHEN tot > 0 THEN hi / tot * 100.0 ELSE 0.0 END, 9) AS high_risk_percentage,
               round(CASE WHEN tot > 0 THEN me / tot * 100.0 ELSE 0.0 END, 9) AS medium_risk_percentage,
               round(CASE WHEN tot > 0 THEN lo / tot * 100.0 ELSE 0.0 END, 9) AS low_risk_percentage FROM a, t""",
    "record_risk": f"""WITH g AS ({_cust_gen_sql()})
        SELECT c_custkey, round(1.0 / count(*) OVER (PARTITION BY c_acctbal, c_nationkey), 9) AS reid_risk FROM g""",
    "information_loss": f"""WITH {_entropy_sql("SELECT * FROM customer", CUST_COLS, "o")},
        {_entropy_sql(_K_SUPPRESS, CUST_COLS, "a")}
        SELECT c.col AS "column", round(coalesce(o.h, 0.0), 9) AS original_entropy,
               round(coalesce(a.h, 0.0), 9) AS anonymized_entropy,
               round(CASE WHEN coalesce(o.h, 0.0) > 0 THEN (coalesce(o.h, 0.0) - coalesce(a.h, 0.0)) / o.h * 100
                     ELSE 0.0 END, 9) AS information_loss_pct
        FROM (SELECT unnest({CUST_COLS!r}) AS col) c LEFT JOIN ent_o o USING (col) LEFT JOIN ent_a a USING (col)""",
    "numeric_error": " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg({c}), 9) AS original_mean,
        round(avg({O.gen_numeric_sql(c, 0)}), 9) AS anonymized_mean,
        round(abs(avg({c}) - avg({O.gen_numeric_sql(c, 0)})), 9) AS absolute_error,
        round(CASE WHEN avg({c}) <> 0 THEN abs(avg({c}) - avg({O.gen_numeric_sql(c, 0)})) / avg({c}) * 100 ELSE 0.0 END, 9)
          AS relative_error_pct,
        round(stddev_samp({c}), 9) AS original_std, round(stddev_samp({O.gen_numeric_sql(c, 0)}), 9) AS anonymized_std
        FROM lineitem""" for c in NUM_COLS),
    "data_retention": f"""WITH a AS ({_K_SUPPRESS}), c AS (SELECT (SELECT count(*) FROM customer) AS o,
        (SELECT count(*) FROM a) AS a)
        SELECT o AS original_records, a AS anonymized_records, o - a AS suppressed_records,
               round(CASE WHEN o > 0 THEN a / o * 100.0 ELSE 0.0 END, 9) AS retention_rate_pct,
               round(CASE WHEN o > 0 THEN (o - a) / o * 100.0 ELSE 0.0 END, 9) AS suppression_rate_pct FROM c""",
    "full_report": _full_report_sql(),
    "recommendation": _recommendation_sql(),
    "scan_sql_injection": f"SELECT doc_id, {O.n_matches('text', O.SQLI_RE2)} > 0 AS hit, "
                          f"{O.n_matches('text', O.SQLI_RE2)} AS n_patterns FROM documents",
    "scan_xss": f"SELECT page_id, {O.n_matches('html', O.XSS_RE2)} > 0 AS hit, "
                f"{O.n_matches('html', O.XSS_RE2)} AS n_patterns FROM pages",
    "scan_dangerous": f"SELECT doc_id, {O.n_matches('text', O.DANGEROUS_RE2)} > 0 AS hit, "
                      f"{O.n_matches('text', O.DANGEROUS_RE2)} AS n_patterns FROM documents",
    "sql_injection_pattern_counts": " UNION ALL ".join(
        f"SELECT {i} AS pattern_id, {O.q(p)} AS pattern, count(*) FILTER (WHERE regexp_matches(text, {O.q(r)}, 'i')) "
        f"AS n_rows FROM documents" for i, (p, r) in enumerate(zip(SQL_INJECTION_PATTERNS, O.SQLI_RE2))),
    "sanitize_sql": _sanitize_sql_sql(),
    "sanitize_xss": _sanitize_xss_sql(),
    "check_string": _check_string_sql(),
    "check_username": f"""SELECT c_custkey, CASE WHEN c_name IS NULL OR c_name = '' THEN 'empty'
        WHEN length({O.strip_sql('c_name')}) < 3 OR length({O.strip_sql('c_name')}) > 50 THEN 'length'
        WHEN {O.any_match(O.strip_sql('c_name'), O.SQLI_RE2)} THEN 'sql_injection'
        WHEN NOT regexp_matches({O.strip_sql('c_name')}, '^[a-zA-Z0-9._-]+$') THEN 'charset' END AS violation
        FROM customer""",
    "check_identifier": f"SELECT p_partkey, {_identifier_sql('p_type')} AS type_violation, "
                        f"{_identifier_sql('p_brand')} AS brand_violation FROM part",
    "check_int_range": """SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'not_integer' WHEN p_size < 1 THEN 'below_min'
        WHEN p_size > 45 THEN 'above_max' END AS violation FROM part""",
    "check_float_range": """SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'not_number'
        WHEN NOT isnan(c_acctbal) AND c_acctbal < 0.0 THEN 'below_min'
        WHEN NOT isnan(c_acctbal) AND c_acctbal > 9000.0 THEN 'above_max' END AS violation FROM customer""",
    "check_string_constraint": """SELECT p_partkey, CASE WHEN p_name IS NULL THEN 'not_string'
        WHEN length(replace(p_name, chr(0), '')) < 5 THEN 'too_short'
        WHEN length(replace(p_name, chr(0), '')) > 40 THEN 'too_long'
        WHEN NOT regexp_matches(replace(p_name, chr(0), ''), '^(?:[a-z ]+)') THEN 'pattern' END AS violation FROM part""",
    "check_list": """SELECT vec_id, CASE WHEN embedding IS NULL THEN 'not_list' WHEN len(embedding) < 1 THEN 'too_few'
        WHEN len(embedding) > 64 THEN 'too_many' WHEN list_count(embedding) < len(embedding) THEN 'item_type'
        END AS violation FROM embeddings""",
    "check_json": _check_json_sql() + " UNION ALL " + " UNION ALL ".join(
        f"SELECT {i}, {'true' if reason is None else 'false'}, {'NULL' if reason is None else O.q(reason)}"
        for i, _, reason in JSON_CASES),
    "audit_search": f"SELECT * FROM ({_log_sql()}) WHERE event_type = 'error' "
                    f"AND ts >= TIMESTAMP '{AUDIT_FROM}' AND ts <= TIMESTAMP '{AUDIT_TO}'",
    "audit_tail": f"SELECT * FROM ({_log_sql()}) ORDER BY ts DESC, seq DESC LIMIT 100",
    "audit_typed": f"""SELECT seq, ts, level, event_type, "user", success,
        CAST(json_extract(details, '$.k') AS BIGINT) AS k FROM ({_log_sql()}) WHERE event_type = 'purchase'""",
    "audit_typed_views": _typed_views_sql(),
    "audit_log_file": f"""SELECT date_trunc('second', ts) AS ts, level, event_type, "user", success
        FROM ({_log_sql()}) WHERE event_type = 'error'
        UNION ALL SELECT NULL, 'ERROR', 'error', 'x', false""",
    "rate_rules": _rate_rules_sql(),
    "audit_rollup": f"""SELECT date_trunc('day', ts) AS bucket, event_type, success, count(*) AS n_events
        FROM ({_log_sql()}) GROUP BY ALL""",
    "rate_breaches": f"""SELECT "user", date_trunc('day', ts) AS window_start,
        date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n_events,
        {RATE_LIMIT_PER_DAY} AS "limit", '{RATE_LIMIT_PER_DAY} per 1 day' AS rule
        FROM ({_log_sql()}) GROUP BY "user", date_trunc('day', ts) HAVING count(*) > {RATE_LIMIT_PER_DAY}""",
    "access_review": _access_sql(),
    "stream_audit_rollup": f"""SELECT date_trunc('hour', ts) AS window_start,
        date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, success, count(*) AS n_events
        FROM ({_log_sql()}) GROUP BY 1, 2, 3, 4""",
    "stream_rate_breaches": f"""SELECT "user", date_trunc('day', ts) AS window_start,
        date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n_events, {RATE_LIMIT_PER_DAY} AS "limit"
        FROM ({_log_sql()}) GROUP BY "user", date_trunc('day', ts)
        HAVING count(*) > {RATE_LIMIT_PER_DAY}""",
    "stream_profile_pipeline": _profile_pipeline_sql(),
    "csv_round_trip": "SELECT * FROM customer",
    "pipeline_job": f"""WITH kl AS ({_CUST_KL})
        SELECT {O.hmac_sql('c_custkey', HMAC_KEY, 12)} AS c_custkey, {O.mask_sql('c_name')} AS c_name,
               c_nationkey, c_acctbal, c_mktsegment FROM kl""",
    "substitute_consistent": _substitute_consistent_sql(),
    "substitute_values": _substitute_values_sql(),
    **_noise_sql(),
    "lockout_replay": _lockout_sql(),
    "stream_lockout": _lockout_sql(),
    "stream_k_anonymize": _PART_K_SUPPRESS,
    "stream_kl_anonymize": _PART_KL,
}
