"""Privacy metrics (M1-M6b) derived from the class table.

All class-level metrics (k, l, distinctness, re-identification risk) are one
aggregation over the class table, which itself is a partially aggregated
group-by: no row-level window, so a huge class is just one counter.
Entropy (M4) stacks the columns into ``(position, value digest)`` pairs so one
shuffle of 16 bytes a cell serves every column, and uses ``H = log2(N) - sum(n*log2(n))/N`` so each
column needs a single aggregation pass (no per-column window of all values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from .classes import DIVERSITY, SIZE, class_table, qi_present

# Fixed risk thresholds of the re-identification estimate.
HIGH_RISK_THRESHOLD = 0.33
MEDIUM_RISK_THRESHOLD = 0.10


def k_metrics(df: DataFrame, qi: list[str], k: int = 2) -> DataFrame:
    """M1: one row of k-anonymity metrics; ``satisfies`` compares with the requested k."""
    if not qi:
        n = df.agg(F.count(F.lit(1)).alias("n"))
        return n.select(
            F.col("n").alias("k_value"), (F.col("n") > 0).alias("satisfies_k_anonymity"),
            F.col("n").alias("min_group_size"), F.col("n").alias("max_group_size"),
            F.col("n").cast(DoubleType()).alias("avg_group_size"),
            F.when(F.col("n") > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("num_groups"),
        )
    ct = class_table(df, qi)
    st = ct.agg(
        F.count(F.lit(1)).alias("num_groups"),
        F.min(SIZE).alias("mn"), F.max(SIZE).alias("mx"), F.avg(SIZE).alias("av"),
    )
    return st.select(
        F.coalesce(F.col("mn"), F.lit(0)).cast("bigint").alias("k_value"),
        (F.coalesce(F.col("mn"), F.lit(0)) >= F.lit(k)).alias("satisfies_k_anonymity"),
        F.coalesce(F.col("mn"), F.lit(0)).cast("bigint").alias("min_group_size"),
        F.coalesce(F.col("mx"), F.lit(0)).cast("bigint").alias("max_group_size"),
        F.coalesce(F.col("av"), F.lit(0.0)).alias("avg_group_size"),
        F.col("num_groups"),
    )


def group_size_histogram(df: DataFrame, qi: list[str]) -> DataFrame:
    """M2: ``(group_size, num_groups)`` - how many classes have each size."""
    ct = class_table(df, qi)
    return ct.groupBy(F.col(SIZE).alias("group_size")).agg(F.count(F.lit(1)).alias("num_groups"))


def l_metrics(df: DataFrame, qi: list[str], sensitive: str, l: int = 2) -> DataFrame:
    """M3: one row of l-diversity metrics (empty input -> zeros and False)."""
    if sensitive not in df.columns:
        raise ValueError(f"Sensitive attribute '{sensitive}' not found")
    if not qi:
        ct = df.agg(F.count(F.lit(1)).alias(SIZE), F.count_distinct(sensitive).alias(DIVERSITY)).where(F.col(SIZE) > 0)
    else:
        ct = class_table(df, qi, sensitive)
    st = ct.agg(
        F.min(DIVERSITY).alias("mn"), F.max(DIVERSITY).alias("mx"), F.avg(DIVERSITY).alias("av"),
        F.count_if(F.col(DIVERSITY) >= F.lit(l)).alias("ok"),
        F.count_if(F.col(DIVERSITY) < F.lit(l)).alias("bad"),
    )
    return st.select(
        F.coalesce(F.col("mn"), F.lit(0)).cast("bigint").alias("l_value"),
        (F.col("mn").isNotNull() & (F.col("mn") >= F.lit(l))).alias("satisfies_l_diversity"),
        F.lit(l).cast("bigint").alias("required_l"),
        F.coalesce(F.col("mn"), F.lit(0)).cast("bigint").alias("min_diversity"),
        F.coalesce(F.col("mx"), F.lit(0)).cast("bigint").alias("max_diversity"),
        F.coalesce(F.col("av"), F.lit(0.0)).alias("avg_diversity"),
        F.col("ok").cast("bigint").alias("groups_satisfying_l"),
        F.col("bad").cast("bigint").alias("groups_not_satisfying_l"),
    )


def _value_text(df: DataFrame, c: str):
    """Column value as text for stacking; NaN counts as missing (pandas dropna)."""
    dt = df.schema[c].dataType
    col = F.col(c)
    if isinstance(dt, (DoubleType, FloatType)):
        col = F.when(F.isnan(col), F.lit(None)).otherwise(col + F.lit(0.0))  # -0.0 == 0.0
    return col.cast(StringType())


def value_digest(value):
    """A text's 128-bit digest: what crosses a shuffle of cells has one size, whatever the text's length."""
    return F.unhex(F.md5(value))


def stacked_values(df: DataFrame, columns: list[str], tag: str | None = None) -> DataFrame:
    """``(pos, value)`` rows for the named columns by position, values as digests, nulls dropped."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("pos"), value_digest(_value_text(df, c)).alias("value")) for i, c in enumerate(columns)
    ])
    out = df.select(F.inline(pairs)).where(F.col("value").isNotNull())
    return out.withColumn("frame", F.lit(tag)) if tag is not None else out


def entropy_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon entropy (bits) per key from ``(keys..., n)`` value counts."""
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("N"),
        F.sum(F.col("n") * F.log2(F.col("n"))).alias("S"),
    ).select(*keys, (F.log2(F.col("N")) - F.col("S") / F.col("N")).alias("entropy"))


def column_entropy(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """M4: ``(column, entropy)`` for every requested column (missing column -> 0.0)."""
    columns = list(df.columns) if columns is None else list(columns)
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([(c, 0.0) for c in columns], "column string, entropy double")
    counts = stacked_values(df, present).groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n"))
    ent = entropy_from_counts(counts, ["pos"])
    place = {c: i for i, c in enumerate(present)}
    names = df.sparkSession.createDataFrame([(c, place.get(c)) for c in columns], "column string, pos int")
    return names.join(ent, "pos", "left").select(
        "column", F.coalesce(F.col("entropy"), F.lit(0.0)).alias("entropy"))


def distinctness(df: DataFrame, qi: list[str]) -> DataFrame:
    """M5: ``1 / average class size`` (no QI or empty -> 0.0)."""
    if not qi:
        return df.limit(0).agg(F.lit(0.0).alias("distinctness"))
    ct = class_table(df, qi)
    return ct.agg(F.count(F.lit(1)).alias("g"), F.sum(SIZE).alias("n")).select(
        F.when(F.col("g") > 0, F.col("g") / F.col("n")).otherwise(F.lit(0.0)).alias("distinctness"))


def reidentification_risk(df: DataFrame, qi: list[str]) -> DataFrame:
    """M6: class risk 1/size averaged over classes; rows per risk bucket.

    Buckets: high risk > 0.33, medium (0.10, 0.33], low <= 0.10; percentages
    are over all rows (rows with a NULL QI fall in no bucket). One scan: the
    group-by keeps NULL-QI groups so the row total comes from the same pass.
    """
    if not qi:
        total = df.agg(F.count(F.lit(1)).alias("total"))
        return total.select(
            F.lit(0.0).alias("avg_risk"), F.lit(0.0).alias("max_risk"), F.lit(0.0).alias("min_risk"),
            F.lit(0).cast("bigint").alias("records_at_high_risk"),
            F.lit(0).cast("bigint").alias("records_at_medium_risk"),
            F.col("total").alias("records_at_low_risk"),
            F.lit(0.0).alias("high_risk_percentage"), F.lit(0.0).alias("medium_risk_percentage"),
            F.when(F.col("total") > 0, F.lit(100.0)).otherwise(F.lit(0.0)).alias("low_risk_percentage"),
        )
    groups = df.groupBy(*qi).agg(F.count(F.lit(1)).alias(SIZE)).select(
        F.col(SIZE), qi_present(qi).alias("in_class"))
    size = F.when(F.col("in_class"), F.col(SIZE))
    risk = F.lit(1.0) / size
    high = risk > F.lit(HIGH_RISK_THRESHOLD)
    medium = (risk > F.lit(MEDIUM_RISK_THRESHOLD)) & (risk <= F.lit(HIGH_RISK_THRESHOLD))
    low = risk <= F.lit(MEDIUM_RISK_THRESHOLD)
    one = groups.agg(
        F.sum(SIZE).alias("total"),
        F.avg(risk).alias("avg_risk"), F.max(risk).alias("max_risk"), F.min(risk).alias("min_risk"),
        F.sum(F.when(high, size)).alias("high"),
        F.sum(F.when(medium, size)).alias("medium"),
        F.sum(F.when(low, size)).alias("low"),
    )
    pct = lambda c: F.when(F.col("total") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("total") * 100.0).otherwise(F.lit(0.0))
    return one.select(
        F.coalesce(F.col("avg_risk"), F.lit(0.0)).alias("avg_risk"),
        F.coalesce(F.col("max_risk"), F.lit(0.0)).alias("max_risk"),
        F.coalesce(F.col("min_risk"), F.lit(0.0)).alias("min_risk"),
        F.coalesce(F.col("high"), F.lit(0)).cast("bigint").alias("records_at_high_risk"),
        F.coalesce(F.col("medium"), F.lit(0)).cast("bigint").alias("records_at_medium_risk"),
        F.coalesce(F.col("low"), F.lit(0)).cast("bigint").alias("records_at_low_risk"),
        pct("high").alias("high_risk_percentage"),
        pct("medium").alias("medium_risk_percentage"),
        pct("low").alias("low_risk_percentage"),
    )


def record_risk(df: DataFrame, qi: list[str], name: str = "reid_risk") -> DataFrame:
    """Each row's re-identification risk ``1/class size`` (NULL QI -> NULL).

    The class table is joined back on the QI columns; it is broadcast only
    when its measured bytes fit.
    """
    from .joins import sized_join
    ct = class_table(df, qi)
    joined = sized_join(df, ct, qi, "left")
    return joined.select(*[F.col(c) for c in df.columns], (F.lit(1.0) / F.col(SIZE)).alias(name))
