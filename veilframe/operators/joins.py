"""Join helper: broadcast only a side whose bytes were measured, shuffle join otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..session import ensure_checkpoint_dir

# Bytes we allow to ship to every executor, and what a row and a field take besides their text.
BROADCAST_BYTES_LIMIT = 64 * 1024 * 1024
_ROW_OVERHEAD = 24
_BYTES_PER_COLUMN = 16


def measured_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take once broadcast (one aggregation)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant")]
    size = F.lit(_ROW_OVERHEAD + _BYTES_PER_COLUMN * max(1, len(df.columns))).cast("bigint")
    for c in texts:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    for c in nested:
        size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0))
    return int(df.agg(F.sum(size)).first()[0] or 0)


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str, written: bool = False) -> DataFrame:
    """Join ``big`` with ``small``, which is computed once (checkpointed, unless ``written`` already) and measured.

    Broadcast when its bytes fit the budget; otherwise a shuffle join, where
    AQE splits a skewed key's partition of ``big`` across tasks.
    """
    ensure_checkpoint_dir(big.sparkSession)
    small = small if written else small.checkpoint()
    side = F.broadcast(small) if measured_bytes(small) <= BROADCAST_BYTES_LIMIT else small
    joined = big.join(side, on=on, how=how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return joined.select(*big.columns)  # a filter: keep the input's column order
    return joined
