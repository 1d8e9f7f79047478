"""Equivalence classes, k-anonymity (A1-A6) and l-diversity (L1-L4).

Everything starts from the *class table*: one row per distinct quasi-identifier
(QI) tuple with its size and, when a sensitive column is named, its number of
distinct sensitive values. Sizes come from a partial+final hash aggregation,
so a class holding a third of all rows costs one counter per map task, not a
hot reducer. Rows are filtered against the class table with a semi/anti join:
broadcast when its exact row count fits the byte budget, otherwise a shuffle
join that AQE splits when one class is skewed. No window over QI partitions
(which would buffer a whole hot class in one task) and nothing collected.

Null QI values: a row with a NULL quasi-identifier belongs to no class (as
with a pandas group-by). ``null_qi='suppress'`` (default) drops such rows from
anonymised output; ``null_qi='keep'`` keeps them, as the reference's
suppression step does.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.generalize import generalize_qi
from ..session import ensure_checkpoint_dir
from .joins import sized_join

SIZE = "class_size"
DIVERSITY = "diversity"


def _check_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def qi_present(qi: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in qi], F.lit(True))


def class_table(df: DataFrame, qi: list[str], sensitive: str | None = None) -> DataFrame:
    """One row per equivalence class: ``qi..., class_size[, diversity]``.

    Rows with a NULL QI value are in no class. ``diversity`` counts distinct
    non-null sensitive values (Spark plans it as a two-level aggregation, so
    it is skew-safe as well).
    """
    _check_columns(df, qi + ([sensitive] if sensitive else []))
    aggs = [F.count(F.lit(1)).alias(SIZE)]
    if sensitive:
        aggs.append(F.count_distinct(F.col(sensitive)).alias(DIVERSITY))
    return df.where(qi_present(qi)).groupBy(*qi).agg(*aggs)


def _class_id(df: DataFrame, qi: list[str]) -> Column:
    """128 bits of SHA-256 over the QI values, each as length and text (64 bits would collide at 10^9 classes)."""
    def text(c: str) -> Column:
        col = F.col(c)
        if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
            col = col + F.lit(0.0)  # grouping takes -0.0 and 0.0 as one
        return col.cast("string")

    parts = [F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)) for c in qi]
    return F.substring(F.sha2(F.concat(F.lit(""), *parts), 256), 1, 32)


def class_summary(df: DataFrame, qi: list[str]) -> DataFrame:
    """Equivalence classes with a stable class id and size."""
    return class_table(df, qi).withColumn("class_id", _class_id(df, qi))


def with_class_id(df: DataFrame, qi: list[str], name: str = "class_id") -> DataFrame:
    """A6 at row level: tag each row with its class id (a narrow projection; NULL QIs have none)."""
    return df.withColumn(name, F.when(qi_present(qi), _class_id(df, qi)))


def diverse_classes(df: DataFrame, qi: list[str], sensitive: str, l: int) -> DataFrame:
    """One row per class: ``qi..., enough`` - whether it holds at least l different sensitive values.

    Each task keeps a theta sketch a class, which holds the smallest value hashes,
    at least l of them, and is exact until it has seen more than it holds; beyond
    that its estimate is at least what it holds. So ``estimate >= l`` decides "at
    least l" for sure (up to equal 64-bit hashes within one class), and what is
    shuffled is bounded by classes times l, however many values a class has.
    """
    _check_columns(df, qi + [sensitive])
    lg = max(4, (l - 1).bit_length())
    # NULLs are no value; the hash also covers types that the sketch doesn't take
    value = F.when(F.col(sensitive).isNotNull(), F.xxhash64(F.col(sensitive)))
    sketch = F.theta_sketch_agg(value, lg)
    rows = df.where(qi_present(qi)).groupBy(*qi).agg(sketch.alias("sketch"))
    return rows.select(*qi, (F.theta_sketch_estimate("sketch") >= F.lit(l)).alias("enough"))


# --- A1 ---------------------------------------------------------------------

def k_stats(classes: DataFrame) -> DataFrame:
    """One row: n_classes, min/max class size, rows in classes."""
    return classes.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min(SIZE).alias("min_size"),
        F.max(SIZE).alias("max_size"),
        F.sum(SIZE).alias("n_rows"),
    )


def k_check_frame(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    """A1 as a one-row DataFrame ``(satisfies, min_group_size)``."""
    if k < 2:
        raise ValueError("k must be at least 2")
    if not qi:
        n = df.agg(F.count(F.lit(1)).alias("n"))
        return n.select(F.lit(True).alias("satisfies"), F.col("n").alias("min_group_size"))
    st = k_stats(class_table(df, qi))
    return st.select(
        F.when(F.col("n_classes") == 0, F.lit(True)).otherwise(F.col("min_size") >= F.lit(k)).alias("satisfies"),
        F.coalesce(F.col("min_size"), F.lit(0)).cast("bigint").alias("min_group_size"),
    )


def check_k(df: DataFrame, qi: list[str], k: int) -> tuple[bool, int]:
    """A1: ``(satisfies, min_group_size)``; empty frame or no classes -> (True, 0)."""
    row = k_check_frame(df, qi, k).first()
    return bool(row["satisfies"]), int(row["min_group_size"])


def _check_hist(hist: DataFrame, k: int) -> tuple[bool, int, int, int, int]:
    """k-check on a (possibly re-aggregated) QI histogram in one pass.

    Returns (satisfies, min class size, #classes, #small classes, #rows); rows
    with a NULL QI count towards #rows but form no class.
    """
    present = qi_present([c for c in hist.columns if c != SIZE])
    row = hist.agg(
        F.count_if(present).alias("n"),
        F.min(F.when(present, F.col(SIZE))).alias("mn"),
        F.count_if(present & (F.col(SIZE) < F.lit(k))).alias("small"),
        F.coalesce(F.sum(SIZE), F.lit(0)).alias("rows"),
    ).first()
    n, mn, small, rows = int(row["n"]), row["mn"], int(row["small"]), int(row["rows"])
    if n == 0:
        return True, 0, 0, 0, rows
    return int(mn) >= k, int(mn), n, small, rows


# --- A2/A3 over a whole frame -----------------------------------------------

def generalize_columns(df: DataFrame, levels: dict[str, int]) -> DataFrame:
    """Apply the QI generalisers (A3b dispatch) to the named columns at their levels."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: generalize_qi(c, types[c], lvl).alias(c) for c, lvl in levels.items()})


# --- A4 ---------------------------------------------------------------------

def suppress_small_classes(df: DataFrame, qi: list[str], k: int, null_qi: str = "suppress",
                           classes: DataFrame | None = None, n_small: int | None = None) -> DataFrame:
    """A4: drop the rows of classes smaller than k.

    ``classes`` may pass a class table already computed for ``df`` (the k
    search has one) and ``n_small`` its number of small classes; otherwise
    they are computed here.
    """
    if null_qi not in ("suppress", "keep"):
        raise ValueError("null_qi must be 'suppress' or 'keep'")
    ct = classes if classes is not None else class_table(df, qi)
    small = ct.where(qi_present(qi) & (F.col(SIZE) < F.lit(k))).select(*qi)
    base = df.where(qi_present(qi)) if null_qi == "suppress" else df
    if n_small == 0:
        return base
    # anti join with the small classes: rows with a NULL QI never match, so
    # 'keep' keeps them and 'suppress' has filtered them above.
    return sized_join(base, small, qi, "left_anti")


# --- A5 ---------------------------------------------------------------------

@dataclass
class KResult:
    satisfied_initially: bool
    generalized: list[str] = field(default_factory=list)
    levels: dict[str, int] = field(default_factory=dict)
    satisfied_after_generalization: bool = False
    min_size_after_generalization: int = 0
    suppressed_classes: int = 0
    total_rows: int = 0
    history: list[tuple[str, bool, int]] = field(default_factory=list)


def apply_k_anonymity(df: DataFrame, qi: list[str], k: int, levels: dict[str, int] | None = None,
                      null_qi: str = "suppress", histogram: DataFrame | None = None) -> tuple[DataFrame, KResult]:
    """A5: generalise QIs in list order (cumulatively) until k holds, then suppress.

    The search runs on the QI histogram, never on the rows: generalisation is
    a function of the QI values only, so each step re-aggregates the
    (checkpointed) histogram. The winning prefix is applied to the rows once.
    ``histogram`` may pass one already kept for ``df``: ``qi..., class_size``.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    _check_columns(df, qi)
    if not qi:
        return df, KResult(True)
    levels = {c: (levels or {}).get(c, 1) for c in qi}
    ensure_checkpoint_dir(df.sparkSession)
    hist = histogram if histogram is not None else df.groupBy(*qi).agg(F.count(F.lit(1)).alias(SIZE)).checkpoint()
    ok, mn, _, _, total = _check_hist(hist, k)
    res = KResult(satisfied_initially=ok, min_size_after_generalization=mn, satisfied_after_generalization=ok,
                  total_rows=total)
    res.history.append(("<none>", ok, mn))
    if ok:
        out = df.where(qi_present(qi)) if null_qi == "suppress" else df
        return out, res
    applied: dict[str, int] = {}
    cur = hist
    small = 0
    for c in qi:
        applied[c] = levels[c]
        cur = generalize_columns(hist, applied).groupBy(*qi).agg(F.sum(SIZE).alias(SIZE))
        ok, mn, _, small, _ = _check_hist(cur, k)
        res.history.append((c, ok, mn))
        if ok:
            break
    res.generalized = list(applied)
    res.levels = dict(applied)
    res.satisfied_after_generalization = ok
    res.min_size_after_generalization = mn
    rows = generalize_columns(df, applied)
    if ok:
        out = rows.where(qi_present(qi)) if null_qi == "suppress" else rows
        return out, res
    res.suppressed_classes = small
    return suppress_small_classes(rows, qi, k, null_qi, classes=cur, n_small=small), res


# --- L1-L4 ------------------------------------------------------------------

def l_check_frame(df: DataFrame, qi: list[str], sensitive: str, l: int) -> DataFrame:
    """L1 as a one-row DataFrame ``(satisfies, min_diversity)``."""
    if l < 1:
        raise ValueError("l must be at least 1")
    ct = class_table(df, qi, sensitive)
    return ct.agg(F.count(F.lit(1)).alias("n"), F.min(DIVERSITY).alias("mn")).select(
        F.when(F.col("n") == 0, F.lit(True)).otherwise(F.col("mn") >= F.lit(l)).alias("satisfies"),
        F.coalesce(F.col("mn"), F.lit(0)).cast("bigint").alias("min_diversity"),
    )


def check_l(df: DataFrame, qi: list[str], sensitive: str, l: int) -> tuple[bool, int]:
    """L1: ``(satisfies, min distinct sensitive values per class)``."""
    row = l_check_frame(df, qi, sensitive, l).first()
    return bool(row["satisfies"]), int(row["min_diversity"])


def enforce_l_diversity(df: DataFrame, qi: list[str], sensitive: str, l: int,
                        classes: DataFrame | None = None) -> DataFrame:
    """L2: keep only classes with at least l distinct sensitive values.

    Whole classes go, so k-anonymity of the input survives. Rows with a NULL
    QI are in no class and are dropped, as in the reference. ``classes`` may pass
    a class table with diversities already computed for ``df``.
    """
    if l < 1:
        raise ValueError("l must be at least 1")
    ensure_checkpoint_dir(df.sparkSession)
    if classes is not None:
        ct = classes.select(*qi, (F.col(DIVERSITY) >= F.lit(l)).alias("enough"))
    else:
        ct = diverse_classes(df, qi, sensitive, l).checkpoint()
    good = ct.where("enough").select(*qi)
    bad = ct.where("NOT enough").select(*qi)
    cnt = ct.agg(F.count_if("enough").alias("good"), F.count_if(~F.col("enough")).alias("bad")).first()
    n_good, n_bad = int(cnt["good"]), int(cnt["bad"])
    base = df.where(qi_present(qi))
    if n_bad == 0:
        return base
    if n_good <= n_bad:
        return sized_join(base, good, qi, "left_semi")
    return sized_join(base, bad, qi, "left_anti")


def l_report_frame(df: DataFrame, qi: list[str], sensitive: str, l: int) -> DataFrame:
    """L3: one row of diversity and class-size statistics."""
    ct = class_table(df, qi, sensitive)
    return ct.agg(
        F.count(F.lit(1)).alias("num_equivalence_classes"),
        F.min(DIVERSITY).alias("min_diversity"),
        F.max(DIVERSITY).alias("max_diversity"),
        F.avg(DIVERSITY).alias("avg_diversity"),
        F.min(SIZE).alias("records_per_class_min"),
        F.max(SIZE).alias("records_per_class_max"),
        F.avg(SIZE).alias("records_per_class_avg"),
    ).select(
        (F.coalesce(F.col("min_diversity"), F.lit(0)) >= F.lit(l)).alias("satisfies_l_diversity"),
        F.coalesce(F.col("min_diversity"), F.lit(0)).cast("bigint").alias("min_diversity"),
        F.coalesce(F.col("max_diversity"), F.lit(0)).cast("bigint").alias("max_diversity"),
        F.coalesce(F.col("avg_diversity"), F.lit(0.0)).alias("avg_diversity"),
        F.col("num_equivalence_classes"),
        F.coalesce(F.col("records_per_class_min"), F.lit(0)).cast("bigint").alias("records_per_class_min"),
        F.coalesce(F.col("records_per_class_max"), F.lit(0)).cast("bigint").alias("records_per_class_max"),
        F.coalesce(F.col("records_per_class_avg"), F.lit(0.0)).alias("records_per_class_avg"),
    )


@dataclass
class KLReport:
    original_records: int
    anonymized_records: int
    records_suppressed: int
    suppression_rate: float
    k: int
    k_satisfies: bool
    min_group_size: int
    l: int
    l_satisfies: bool
    min_diversity: int
    k_search: KResult

    def as_row(self) -> dict:
        return {
            "original_records": self.original_records,
            "anonymized_records": self.anonymized_records,
            "records_suppressed": self.records_suppressed,
            "suppression_rate": self.suppression_rate,
            "k": self.k, "k_satisfies": self.k_satisfies, "min_group_size": self.min_group_size,
            "l": self.l, "l_satisfies": self.l_satisfies, "min_diversity": self.min_diversity,
        }


def apply_k_and_l(df: DataFrame, qi: list[str], sensitive: str, k: int = 3, l: int = 2,
                  levels: dict[str, int] | None = None, null_qi: str = "suppress") -> tuple[DataFrame, KLReport]:
    """L4: A5, then L2, then re-check both on the result.

    The class table of the k-anonymous rows (size + diversity) is computed
    once and checkpointed: L2 filters with it, and the final checks read it
    (L2 drops whole classes, so the result's classes are its ``diversity >= l`` rows).
    """
    _check_columns(df, qi + [sensitive])
    if l < 1:
        raise ValueError("l must be at least 1")
    kdf, kres = apply_k_anonymity(df, qi, k, levels, null_qi)
    ensure_checkpoint_dir(df.sparkSession)
    ct = class_table(kdf, qi, sensitive).checkpoint()
    final = enforce_l_diversity(kdf, qi, sensitive, l, classes=ct)
    kept = ct.where(F.col(DIVERSITY) >= F.lit(l))
    st = kept.agg(
        F.count(F.lit(1)).alias("n"), F.min(SIZE).alias("mn"), F.min(DIVERSITY).alias("md"),
        F.coalesce(F.sum(SIZE), F.lit(0)).alias("rows"),
    ).first()
    n_orig = kres.total_rows if qi else df.count()
    n_final = int(st["rows"])  # L2 keeps exactly the rows of these classes
    n_cls = int(st["n"])
    k_ok = True if n_cls == 0 else int(st["mn"]) >= k
    l_ok = True if n_cls == 0 else int(st["md"]) >= l
    rep = KLReport(
        original_records=n_orig,
        anonymized_records=n_final,
        records_suppressed=n_orig - n_final,
        suppression_rate=((n_orig - n_final) / n_orig * 100) if n_orig > 0 else 0.0,
        k=k, k_satisfies=k_ok, min_group_size=0 if n_cls == 0 else int(st["mn"]),
        l=l, l_satisfies=l_ok, min_diversity=0 if n_cls == 0 else int(st["md"]),
        k_search=kres,
    )
    return final, rep
