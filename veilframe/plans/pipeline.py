"""Profile-driven pipeline: P1/P2 dispatch and the composite job.

Order (observable, kept from the reference): per-column transforms in profile
order -> k-anonymity then l-diversity -> differential privacy -> write ->
run log -> report. QI generalisation therefore sees already-transformed
columns (an age turned into ``'18-29'`` is a string and is truncated, not
rounded).

All narrow transforms of a profile become one ``withColumns`` projection, so
they fuse into a single code-generated stage; shuffles (T4) follow as index
joins.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..functions.draws import row_key
from ..functions.generalize import generalize_age, generalize_numeric
from ..functions.masking import hmac_pseudonym, mask, null_out, salted_hash
from ..functions.noise import add_laplace, fresh_seed
from ..functions.substitute import substitute
from ..operators.classes import apply_k_and_l, apply_k_anonymity
from ..operators.dp import compare_means, dp_dataset
from ..operators.shuffle import shuffle_columns
from .profile import ColumnSpec, Profile, ProfileError, normalize


def _now() -> str:
    return _dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")


def column_expr(spec: ColumnSpec, df: DataFrame, profile: Profile, seed: int, i: int) -> Column:
    """The Column for one narrow transform (everything but ``shuffle``)."""
    c, p, dt = spec.column, spec.params, df.schema[spec.column].dataType
    key = row_key([k for k in profile.row_key if k in df.columns]) if profile.row_key else None
    t = spec.transform
    if t == "mask":
        return mask(c, p["keep_last"], p["mask_char"])
    if t == "null":
        return null_out(c, dt)
    if t == "substitute":
        return substitute(c, p["data_type"], p["mode"], seed=(seed + 31 * i) % (2 ** 62), key=key, name=c)
    if t == "hash":
        return salted_hash(c, p.get("salt", profile.salt))
    if t == "hmac":
        if not profile.hmac_key:
            raise ProfileError("hmac transform requires a key")
        return hmac_pseudonym(c, profile.hmac_key, p["out_len"])
    if t == "generalize_age":
        return generalize_age(c, p.get("bins"), dtype=dt, bin_size=p.get("bin_size"),
                              on_invalid=p.get("on_invalid", "null"))
    if t == "generalize_numeric":
        return generalize_numeric(c, p["precision"], p.get("bin_size"), p.get("on_invalid", "null"))
    if t == "differential_privacy":
        return add_laplace(c, p["epsilon"], p["sensitivity"], seed=(seed + 131 * i) % (2 ** 62), key=key, name=c)
    raise ProfileError(f"no column expression for transform {t!r}")


def apply_profile(df: DataFrame, profile: Profile | dict, seed: int | None = None,
                  events: list | None = None) -> DataFrame:
    """Apply every column transform of the profile; unknown columns are skipped (logged)."""
    prof = profile if isinstance(profile, Profile) else normalize(profile)
    seed = prof.seed if seed is None and prof.seed is not None else (fresh_seed() if seed is None else seed)
    events = events if events is not None else []
    narrow, shuffled = {}, []
    for i, spec in enumerate(prof.columns):
        if spec.column not in df.columns:
            events.append({"timestamp": _now(), "level": "WARNING", "event_type": "SECURITY_EVENT", "success": True,
                           "details": {"event_type": "COLUMN_NOT_FOUND",
                                       "description": f"Column '{spec.column}' in profile not found in dataset",
                                       "severity": "WARNING"}})
            continue
        if spec.transform == "shuffle":
            shuffled.append(spec.column)
        else:
            narrow[spec.column] = column_expr(spec, df, prof, seed, i)
        events.append({"timestamp": _now(), "event_type": "TRANSFORMATION",
                       "details": {"transformation_type": spec.transform, "column": spec.column,
                                   "parameters": spec.params}})
    out = df.withColumns(narrow) if narrow else df
    if shuffled:
        # the key serves if the narrow transforms leave it as it was
        keyed = bool(prof.row_key) and set(prof.row_key) <= set(df.columns) - set(narrow) - set(shuffled)
        out = shuffle_columns(out, shuffled, (seed + 7) % (2 ** 62), list(prof.row_key) if keyed else None)
    return out


@dataclass
class RunResult:
    data: DataFrame
    original: DataFrame
    kl_report: dict | None = None
    dp_report: dict | None = None
    report: dict | None = None
    events: list = field(default_factory=list)


def run(df: DataFrame, profile: Profile | dict, seed: int | None = None, output_path: str | None = None,
        output_format: str = "parquet", log_path: str | None = None, with_report: bool = False,
        user: str | None = None, profile_path: str | None = None) -> RunResult:
    """The composite job (transforms -> k/l -> DP -> write -> run log -> report).

    With a report and an output path, the report is written twice: nested as one JSON
    document and in long form as a table. ``profile_path`` is named in the run log.
    """
    from ..operators.report import full_report, report_long
    from ..sources.files import append_run_log, report_path_for, report_rows_path_for, write_csv, write_parquet, write_report

    prof = profile if isinstance(profile, Profile) else normalize(profile)
    seed = prof.seed if seed is None and prof.seed is not None else (fresh_seed() if seed is None else seed)
    events: list = [{"timestamp": _now(), "event_type": "PROFILE_LOAD",
                     "details": {"profile_path": profile_path, "columns_configured": len(prof.columns)}}]
    out = apply_profile(df, prof, seed, events)
    res = RunResult(data=out, original=df, events=events)
    if prof.k_enabled:
        qi = list(prof.quasi_identifiers)
        if prof.l_enabled:
            out, rep = apply_k_and_l(out, qi, prof.sensitive_attribute, prof.k, prof.l, prof.k_levels, prof.null_qi)
            res.kl_report = rep.as_row()
            events.append({"timestamp": _now(), "event_type": "K_ANONYMITY", "success": rep.k_satisfies,
                           "details": {"k": prof.k, "quasi_identifiers": qi, "satisfies": rep.k_satisfies,
                                       "min_group_size": rep.min_group_size}})
            events.append({"timestamp": _now(), "event_type": "L_DIVERSITY", "success": rep.l_satisfies,
                           "details": {"l": prof.l, "sensitive_attribute": prof.sensitive_attribute,
                                       "satisfies": rep.l_satisfies, "min_diversity": rep.min_diversity}})
        else:
            out, kres = apply_k_anonymity(out, qi, prof.k, prof.k_levels, prof.null_qi)
            events.append({"timestamp": _now(), "event_type": "K_ANONYMITY",
                           "success": kres.satisfied_after_generalization,
                           "details": {"k": prof.k, "quasi_identifiers": qi,
                                       "satisfies": kres.satisfied_after_generalization,
                                       "min_group_size": kres.min_size_after_generalization,
                                       "generalized": kres.generalized,
                                       "suppressed_classes": kres.suppressed_classes}})
    if prof.dp_columns:
        # DP10: noise plus the per-column comparison of original and noisy means
        before_noise = out
        out, dp_rep, comp = dp_dataset(out, list(prof.dp_columns), prof.epsilon, prof.delta,
                                       seed=(seed + 17) % (2 ** 62), keys=list(prof.row_key) or None)
        res.dp_report = dp_rep
        events.append({"timestamp": _now(), "event_type": "DIFFERENTIAL_PRIVACY",
                       "details": {"epsilon": prof.epsilon, "delta": prof.delta, "columns": list(prof.dp_columns),
                                   "budget_used": dp_rep["privacy_budget_used"]}})
    res.data = out
    if output_path:
        (write_csv if output_format == "csv" else write_parquet)(out, output_path)
        # report and callers read the written table: the lineage is cut and
        # the report describes exactly the rows that were written
        spark = out.sparkSession
        reader = spark.read.schema(out.schema)
        out = (reader.option("header", True).csv(output_path) if output_format == "csv"
               else reader.parquet(output_path))
        res.data = out
        n_out = out.count()
        events.append({"timestamp": _now(), "event_type": "DATA_EXPORT",
                       "details": {"output_file": output_path, "format": output_format.upper(),
                                   "records_count": n_out}})
    if res.dp_report is not None:
        if output_path:  # the means of what was published
            comp = compare_means(before_noise, out, list(prof.dp_columns))
        res.dp_report["comparison"] = {r["column"]: {k: r[k] for k in ("original_mean", "noisy_mean", "absolute_error")}
                                       for r in comp.collect()}
    if with_report:
        rep, _ = full_report(df, out, list(prof.quasi_identifiers), prof.sensitive_attribute,
                             list(prof.dp_columns) or None, prof.k or 3, prof.l or 2)
        res.report = rep
        if output_path:
            write_report(out.sparkSession, rep, report_path_for(output_path))
            write_parquet(report_long(rep, out, list(prof.quasi_identifiers)), report_rows_path_for(output_path))
    summary = {"method": "PROFILE_BASED", "output_file": output_path}
    if res.kl_report:
        summary.update({k: res.kl_report[k] for k in ("original_records", "anonymized_records")})
        summary["suppression_rate"] = res.kl_report["suppression_rate"]
    events.append({"timestamp": _now(), "event_type": "ANONYMIZATION", "details": summary})
    for e in events:
        e.setdefault("user", user)
    if log_path:
        # every transform covers all input rows
        affected = res.kl_report["original_records"] if res.kl_report else df.count()
        for e in events:
            if e["event_type"] == "TRANSFORMATION":
                e["details"]["records_affected"] = affected
        append_run_log(out.sparkSession, events, log_path)
    return res
