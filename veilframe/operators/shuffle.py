"""Column shuffle (T4): a random permutation of each listed column's values.

Rows keep their other columns; only the shuffled columns move, each by its own
permutation. No single partition ever holds a whole column:

1. The values of the shuffled columns and what identifies their row are written
   once, as a narrow table with a dense index ``0..n-1``: in the order of the
   row's key, or, without a key, of the checkpointed source.
2. Row i's value of a column moves to place ``pi(i)``, where ``pi`` is a keyed
   bijection of ``0..n-1`` (``functions.permute``), one for each column: no random sort.
3. Values and row identities meet by place in one aggregation, and the rows get
   their new values by one join, whatever the number of columns.

With a key, the permutation depends on the seed, the column's name and the
order of the keys alone. The key must be unique and free of NULL, else the job
fails; without one, the source is checkpointed in full, as the identity of its
rows must survive a recomputed partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import fresh_seed
from ..functions.permute import Permutation
from ..session import ensure_checkpoint_dir

_PART_SHIFT = 33  # monotonically_increasing_id = (partition id << 33) + row number
ROWS_PER_TASK = 4_000_000  # narrow rows per sort task


def offsets_table(df: DataFrame, part_col: str) -> tuple[DataFrame, int]:
    """``(part_col, _offset)``: rows before each part, and the row total.

    One count job; one small row per part reaches the driver and goes back as a
    table to join with, so the plan's size does not depend on the number of parts.
    """
    counts = sorted((r[0], r[1]) for r in df.groupBy(F.col(part_col)).agg(F.count(F.lit(1))).collect())
    rows, total = [], 0
    for part, n in counts:
        rows.append((part, total))
        total += n
    return df.sparkSession.createDataFrame(rows, f"{part_col} int, _offset bigint"), total


def dense_index(df: DataFrame, name: str = "_idx") -> tuple[DataFrame, int]:
    """Add a dense 0..n-1 index without a global sort or a single-partition window.

    ``df`` should be checkpointed (or be a deterministic scan) so the count job
    and the indexing see the same partitioning.
    """
    mid = F.monotonically_increasing_id()
    tagged = df.withColumn("_mid", mid).withColumn("_pid", F.shiftright(F.col("_mid"), _PART_SHIFT).cast("int"))
    offsets, n = offsets_table(tagged, "_pid")
    row_in_part = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), _PART_SHIFT)
    # one row of 12 bytes per partition of the input
    out = tagged.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_offset") + row_in_part)
    return out.drop("_mid", "_pid", "_offset"), n


def shuffle_column(df: DataFrame, column: str, seed: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``column``'s values randomly permuted across rows."""
    return shuffle_columns(df, [column], seed, keys)


def shuffle_columns(df: DataFrame, columns: list[str], seed: int | None = None,
                    keys: list[str] | None = None) -> DataFrame:
    """``df`` with each listed column permuted independently; ``keys`` names columns that tell the rows apart."""
    missing = [c for c in [*columns, *(keys or [])] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    if set(columns) & set(keys or []):
        raise ValueError("a key column can't be shuffled")
    if not columns:
        return df
    seed = fresh_seed() if seed is None else seed
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    source = df if keys else df.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    home = list(keys or ["_row"])
    narrow = source.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(home)],
                           *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    if keys:
        by = [f"_k{i}" for i in range(len(home))]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-source.count() // ROWS_PER_TASK))
        narrow = narrow.repartitionByRange(tasks, *by).sortWithinPartitions(*by).checkpoint()
        _require_unique(narrow, by)
    indexed, n = dense_index(narrow, "_idx")
    nothing = [F.lit(None).cast(df.schema[c].dataType) for c in columns]
    key = F.struct(*[F.col(f"_k{i}").alias(f"k{i}") for i in range(len(home))])

    def record(place, identity, values) -> Column:
        return F.struct(place.alias("place"), identity.alias("home"), *[v.alias(f"v{i}") for i, v in enumerate(values)])

    for i, c in enumerate(columns):
        indexed = Permutation(n, seed, c).place(indexed, "_idx", f"_p{i}")
    records = [record(F.col("_idx"), key, nothing)]
    for i in range(len(columns)):
        values = [F.col(f"_v{j}") if j == i else x for j, x in enumerate(nothing)]
        records.append(record(F.col(f"_p{i}"), F.lit(None).cast(indexed.select(key.alias("k")).schema["k"].dataType), values))
    placed = indexed.select(F.explode(F.array(*records)).alias("r")).select("r.*").groupBy("place").agg(
        F.first("home", ignorenulls=True).alias("home"),
        *[F.first(f"v{i}", ignorenulls=True).alias(f"v{i}") for i in range(len(columns))])
    moved = placed.select(*[F.col(f"home.k{i}").alias(k) for i, k in enumerate(home)],
                          *[F.col(f"v{i}").alias(c) for i, c in enumerate(columns)])
    return source.drop(*columns).join(moved, home).select(*df.columns)


def _require_unique(sorted_rows: DataFrame, by: list[str]) -> None:
    """Fail unless the key columns tell all rows apart and hold no NULL."""
    some_null = F.lit(False)
    for c in by:
        some_null = some_null | F.col(c).isNull()
    wrong = sorted_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | some_null)
    if not wrong.isEmpty():
        raise ValueError(f"the key of a shuffle must be unique and without NULL: {by}")
