"""

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. Each query is executed in
full through the ``noop`` sink (no rows are collected to the driver); the
reported time is the best of ``$BENCH_REPEAT`` runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from veilframe.operators import audit, classes, dp, report, scan  # noqa: E402
from veilframe.operators.shuffle import shuffle_column  # noqa: E402
from veilframe.plans import catalog  # noqa: E402
from veilframe.plans.pipeline import apply_profile  # noqa: E402
from veilframe.session import local_session  # noqa: E402
from veilframe.sources.tables import table  # noqa: E402


def q_profile_pipeline(spark, sf):
    return apply_profile(table(spark, sf, "lineitem"), catalog.PIPELINE_PROFILE, seed=catalog.SEED)


def q_shuffle_column(spark, sf):
    return shuffle_column(table(spark, sf, "lineitem"), "l_extendedprice", seed=catalog.SEED)


def q_k_anonymize_customer(spark, sf):
    out, _ = classes.apply_k_anonymity(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], catalog.K,
                                       {"c_acctbal": 3, "c_nationkey": 0})
    return out


def q_k_anonymize_orders(spark, sf):
    out, _ = classes.apply_k_anonymity(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_totalprice"],
                                       catalog.K, {"o_orderstatus": 0, "o_orderpriority": 0, "o_totalprice": 4})
    return out


def q_kl_anonymize_customer(spark, sf):
    out, _ = classes.apply_k_and_l(catalog._cust_gen(spark, sf), catalog.CUST_QI, "c_mktsegment", catalog.K,
                                   catalog.L, {"c_acctbal": 0, "c_nationkey": 0})
    return out


def q_full_report_customer(spark, sf):
    anon = catalog._cust_kl(spark, sf)
    _, df = report.full_report(table(spark, sf, "customer"), anon, catalog.CUST_QI, "c_mktsegment", ["c_acctbal"],
                               catalog.K, catalog.L)
    return df


def q_dp_columns(spark, sf):
    acct = dp.PrivacyAccountant(1.0, 1e-5, "lineitem")
    return dp.dp_columns(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                         acct, seed=catalog.SEED)


def q_scan_sql_injection(spark, sf):
    return scan.scan(table(spark, sf, "documents"), "text", "sql_injection", keep=["doc_id"])


def q_scan_xss(spark, sf):
    return scan.scan(table(spark, sf, "pages"), "html", "xss", keep=["page_id"])


def q_rate_breaches(spark, sf):
    return audit.rate_breaches_all(audit.events_as_audit(table(spark, sf, "events")), "user")


def q_audit_rollup(spark, sf):
    return audit.rollup(audit.events_as_audit(table(spark, sf, "events")), "hour")


def q_check_json(spark, sf):
    ev = table(spark, sf, "events")
    return scan.check_json(ev.select("event_id", "props"), "props", keep=["event_id"])


def q_lockout_replay(spark, sf):
    return catalog.q_lockout_replay(spark, sf)


BENCH = {
    "profile_pipeline": q_profile_pipeline,
    "shuffle_column": q_shuffle_column,
    "k_anonymize_customer": q_k_anonymize_customer,
    "k_anonymize_orders": q_k_anonymize_orders,
    "kl_anonymize_customer": q_kl_anonymize_customer,
    "full_report_customer": q_full_report_customer,
    "dp_columns": q_dp_columns,
    "scan_sql_injection": q_scan_sql_injection,
    "scan_xss": q_scan_xss,
    "rate_breaches": q_rate_breaches,
    "audit_rollup": q_audit_rollup,
    "check_json": q_check_json,
    "lockout_replay": q_lockout_replay,
}


def run_once(spark, fn, sf) -> float:
    t0 = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def timed(spark, fn, sf) -> float:
    spark.catalog.clearCache()  # no run answers from what another left in memory
    return run_once(spark, fn, sf)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    only = set(sys.argv[1:])
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app_name="veilframe-bench")
    spark.range(1000).select(F.sum("id")).collect()  # JVM warm-up
    times = {}
    for name, fn in BENCH.items():
        if only and name not in only:
            continue
        run_once(spark, fn, sf)  # warm-up: Python workers, codegen
        best = min(timed(spark, fn, sf) for _ in range(repeat))
        times[name] = round(best, 3)
        print(f"# {name}: {best:.3f}s", file=sys.stderr, flush=True)
    sf_name = os.path.basename(os.path.normpath(sf)).replace("sf", "")
    try:
        sf_name = float(sf_name)
    except ValueError:
        pass
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_name, "cpus": cpus}))


if __name__ == "__main__":
    main()
