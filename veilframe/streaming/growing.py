"""k-anonymity and l-diversity over a table that grows (A5, L2, L4 by micro-batches).

Both need the classes of the whole table, which a raw stream never has. Here the
rows of each micro-batch are appended to an accumulated table, and two small
tables are carried on beside it, each a merge of its last version with what the
batch adds:

* the histogram: rows of each combination of quasi-identifiers (QIs);
* the values: up to ``keep`` different sensitive values of each combination. As
  l asks for "at least l", ``keep >= l`` values decide it, also for classes
  that generalisation joins: either one part holds l values, or all parts'
  values are known in full.

So no batch reads earlier rows for its counts. The k search, the suppression and
the l filter then run on these tables (``operators.classes``) and touch the
rows once, to give the same result as the batch operators over all rows.

Versions are written to folders by batch id, each made from the one before, so
a batch that is repeated after a failure replaces its own folders only.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..operators.classes import DIVERSITY, SIZE, KResult, apply_k_anonymity, enforce_l_diversity, generalize_columns, qi_present
from ..session import ensure_checkpoint_dir
from .jobs import shared_path


@dataclass
class GrowingTable:
    """Accumulated rows with their class tables, below one folder of the shared storage."""

    spark: SparkSession
    folder: str
    schema: StructType
    qi: list[str]
    sensitive: str | None = None
    keep: int = 8
    #: The last batch whose tables are written (-1: none).
    version: int = -1

    def _path(self, kind: str, batch: int) -> str:
        return os.path.join(self.folder, kind, f"batch={batch}")

    def _histogram_schema(self) -> StructType:
        return StructType([*[self.schema[c] for c in self.qi]]).add(SIZE, LongType())

    def _values_schema(self) -> StructType:
        return StructType([self.schema[c] for c in [*self.qi, self.sensitive]])

    def rows(self) -> DataFrame:
        """All rows so far."""
        if self.version < 0:
            return self.spark.createDataFrame([], self.schema)
        paths = [self._path("rows", b) for b in range(self.version + 1)]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def histogram(self) -> DataFrame:
        """Rows of each QI combination (NULLs kept as combinations of their own)."""
        return self._table("histogram", self._histogram_schema())

    def values(self) -> DataFrame:
        """Up to ``keep`` different sensitive values of each QI combination."""
        return self._table("values", self._values_schema())

    def _table(self, kind: str, schema: StructType) -> DataFrame:
        if self.version < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(kind, self.version))

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Append a batch and carry the class tables on; a batch id seen before replaces that batch."""
        self.version = batch_id - 1
        batch.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._path("rows", batch_id))
        fresh = self.spark.read.schema(self.schema).parquet(self._path("rows", batch_id))
        added = fresh.groupBy(*self.qi).agg(F.count(F.lit(1)).alias(SIZE))
        merged = self.histogram().unionByName(added).groupBy(*self.qi).agg(F.sum(SIZE).alias(SIZE))
        merged.write.mode("overwrite").parquet(self._path("histogram", batch_id))
        if self.sensitive:
            pairs = fresh.select(*self.qi, self.sensitive).where(qi_present(self.qi) & F.col(self.sensitive).isNotNull())
            different = self.values().unionByName(pairs).distinct()
            order = Window.partitionBy(*self.qi).orderBy(self.sensitive)
            kept = different.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= self.keep)
            kept.drop("_place").write.mode("overwrite").parquet(self._path("values", batch_id))
        self.version = batch_id

    def class_table(self, levels: dict[str, int] | None = None) -> DataFrame:
        """One row per class of the (generalised) QIs: size and, up to ``keep``, different sensitive values."""
        sizes = generalize_columns(self.histogram(), levels or {}).where(qi_present(self.qi))
        sizes = sizes.groupBy(*self.qi).agg(F.sum(SIZE).alias(SIZE))
        if not self.sensitive:
            return sizes
        counts = generalize_columns(self.values(), levels or {}).groupBy(*self.qi).agg(F.count_distinct(self.sensitive).alias(DIVERSITY))
        return sizes.join(counts, self.qi, "left").withColumn(DIVERSITY, F.coalesce(DIVERSITY, F.lit(0)).cast("bigint"))

    def k_anonymous(self, k: int, levels: dict[str, int] | None = None, null_qi: str = "suppress") -> tuple[DataFrame, KResult]:
        """A5 over all rows so far; the search reads the histogram only."""
        return apply_k_anonymity(self.rows(), self.qi, k, levels, null_qi, histogram=self.histogram())

    def l_diverse(self, l: int) -> DataFrame:
        """L2 over all rows so far."""
        return self._enforced(self.rows(), l, {})

    def k_and_l(self, k: int, l: int, levels: dict[str, int] | None = None, null_qi: str = "suppress") -> tuple[DataFrame, KResult]:
        """L4 over all rows so far: A5, then L2 on the classes that A5 leaves."""
        rows, found = self.k_anonymous(k, levels, null_qi)
        return self._enforced(rows, l, found.levels), found

    def _enforced(self, rows: DataFrame, l: int, levels: dict[str, int]) -> DataFrame:
        if not self.sensitive:
            raise ValueError("l-diversity needs a sensitive column")
        if l > self.keep:
            raise ValueError(f"the table keeps {self.keep} values of a class; l = {l} needs as many")
        ensure_checkpoint_dir(self.spark)
        return enforce_l_diversity(rows, self.qi, self.sensitive, l, classes=self.class_table(levels).checkpoint())


def accumulate(stream: DataFrame, qi: list[str], sensitive: str | None = None, name: str = "growing", keep: int = 8,
               folder: str | None = None) -> GrowingTable:
    """Run a stream over everything available now into a ``GrowingTable``.

    With ``folder``, a table begun by an earlier run goes on: the stream's own checkpoint there tells which rows are new.
    """
    spark = stream.sparkSession
    base = folder or shared_path(spark, name)
    missing = [c for c in [*qi, *([sensitive] if sensitive else [])] if c not in stream.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    table = GrowingTable(spark, base, stream.schema, list(qi), sensitive, keep, _last_batch(spark, base))
    query = (stream.writeStream.foreachBatch(table.add).option("checkpointLocation", os.path.join(base, "_checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return table


def _last_batch(spark: SparkSession, base: str) -> int:
    """The newest complete version below a folder (the histogram, or the values, is written last)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(base, "histogram"))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return -1
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return max((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), default=-1)
