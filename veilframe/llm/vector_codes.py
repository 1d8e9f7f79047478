"""Vector codes by member-resident Lloyd iterations (operator 11).

Vectors are floored to integers and cut into equal consecutive parts; every part
position has its own codebook. The parts live in a table laid out by owner: the
members of one (position, entry, salt) lie in one of its files. Salts spread an
entry that takes a third of all rows over many owners. A round has two steps.
Each resident part is compared with its position's codebook where it lies; a
part that keeps its nearest entry is written on by the task that read it, among
the same owner's members, and only a part whose entry changed goes through the
shuffle to its new owner. Then the members are summed where they lie, the sums
of the salts and files meet in one row per (position, entry), and only these
rows (positions x entries) reach the driver, which divides them.

Each round's layout is a written table in the shared folder, so a lost executor
costs one round's tasks; the layout before it is removed. Codes are assigned to
the input rows at the end, without a shuffle.

Defined results. Vectors that are null or hold a null or non-finite component
are dropped. The first entries are the parts of the rows with the smallest ids
(ties: the smaller vector; null ids last); of fewer rows than entries, all.
Repeated rows each count. Parts are as wide as the longest vector needs, and
shorter vectors (an empty one too) count as filled with zeros. An empty table
gives no rows. All arithmetic is exact; a component of 2^62 or more once scaled,
or a squared distance beyond 64 bits, stops the job with a message.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: This many owners share the members of an entry.
SALTS = 64
#: Parts of one task, where there are enough for all cores.
TASK_PARTS = 1_000_000
_LIMIT = 2.0**62
_LOW = (1 << 32) - 1
_OWNER = ("position", "entry", "salt")
_MEMBER = (*_OWNER, "part")


def quantised(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * component) as longs; null unless every component is a finite number."""

    def scaled(x: Column) -> Column:
        return x.cast("double") * F.lit(scale)

    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    fits = F.forall(vector, lambda x: F.abs(scaled(x)) < _LIMIT)
    too_large = F.raise_error(F.lit("a vector component is too large for a 64-bit integer")).cast("array<bigint>")
    return F.when(finite & fits, F.transform(vector, lambda x: F.floor(scaled(x)).cast("bigint"))).when(finite, too_large)


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, width) to the entries (n, entries, width) beside them, exact."""
    high = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * high * high * max(1, parts.shape[1]) >= 2**63:
        parts, entries = parts.astype(object), entries.astype(object)
    away = parts[:, None, :] - entries
    return (away * away).sum(2)


@dataclass(frozen=True)
class Codebooks:
    """The integer entries: (positions, entries, width)."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def sha256(self) -> str:
        """Of all components in order, decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, position: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part (ties: the lower index) and its squared distance."""
        away = distances(parts, self.entries[position])
        best = np.argmin(away, axis=1) if len(away) else np.zeros(0, np.int64)
        return best.astype(np.int32), away[np.arange(len(best)), best]

    def moved(self, sums: list[tuple[int, int, int, list[int]]]) -> Codebooks:
        """Each entry replaced by the floored mean of its members: rows of (position, entry, members, sums)."""
        out = self.entries.copy()
        for position, entry, members, total in sums:
            out[position, entry] = [t // members for t in total]
        return Codebooks(out)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _padded(vector: Column, size: int) -> Column:
    return F.concat(vector, F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size(vector)))


def _nearest_entry(codebooks: Codebooks) -> Column:
    @F.arrow_udf("int")
    def nearest(position: pa.Array, part: pa.Array) -> pa.Array:
        return pa.array(codebooks.nearest(position.to_numpy(), _matrix(part, codebooks.width))[0])

    return nearest("position", "part")


def _sums(resident: DataFrame, width: int) -> list[tuple[int, int, int, list[int]]]:
    """Members and component sums of each entry; a task sums the members that lie with it before anything is shuffled.

    Components are summed as a high and a low half of 32 bits, so that no sum leaves 64 bits.
    """
    halves = []
    for d in range(width):
        x = F.get("part", F.lit(d))
        halves += [F.sum(F.shiftright(x, 32)).alias(f"h{d}"), F.sum(x.bitwiseAND(_LOW)).alias(f"l{d}")]
    rows = resident.groupBy("position", "entry").agg(F.count("*").alias("n"), *halves).collect()
    return [(r.position, r.entry, r.n, [(r[f"h{d}"] << 32) + r[f"l{d}"] for d in range(width)]) for r in rows]


def settled(resident: DataFrame, codebooks: Codebooks, partitions: int) -> tuple[DataFrame, DataFrame]:
    """The members that keep their entry under new codebooks, and, shuffled to their new owner, those that change it."""
    compared = resident.withColumn("next", _nearest_entry(codebooks))
    stay = compared.where("next = entry").select(*_MEMBER)
    move = compared.where("next <> entry").select("position", F.col("next").alias("entry"), "salt", "part")
    return stay, _at_owners(move, partitions)


def _at_owners(members: DataFrame, partitions: int) -> DataFrame:
    return members.repartition(partitions, *_OWNER)


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Codebooks | None:
    """The codebooks after ``rounds`` rounds over all rows (None if no vector takes part)."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).alias("id"), quantised(F.col(vector), scale).alias("v")).where("v is not null")
    rows, longest = kept.agg(F.count("*"), F.max(F.size("v"))).first()
    if not rows:
        return None
    width = -(-longest // parts)
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select(_padded(F.col("v"), parts * width).alias("v")).collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width)
    codebooks = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    if not width or not rounds:
        return codebooks
    folder = scratch.folder(spark, "vector_codes")
    kept.select(_padded(F.col("v"), parts * width).alias("v")).write.parquet(f"{folder}/vectors")
    try:
        return _rounds(spark, folder, codebooks, rounds, -(-rows * parts // TASK_PARTS))
    finally:
        scratch.remove(spark, folder)


def _rounds(spark: SparkSession, folder: str, codebooks: Codebooks, rounds: int, partitions: int) -> Codebooks:
    partitions = max(partitions, spark.sparkContext.defaultParallelism)
    width, positions = codebooks.width, len(codebooks.entries)
    salted = spark.read.parquet(f"{folder}/vectors").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(positions - 1)), lambda p: F.slice("v", p * width + 1, width))
    spread = salted.select("salt", F.posexplode(cut).alias("position", "part"))
    placed = spread.withColumn("entry", _nearest_entry(codebooks)).select(*_MEMBER)
    _at_owners(placed, partitions).write.parquet(f"{folder}/round1")
    for done in range(1, rounds + 1):
        resident = spark.read.parquet(f"{folder}/round{done}")
        codebooks = codebooks.moved(_sums(resident, width))
        if done < rounds:
            stay, move = settled(resident, codebooks, partitions)
            stay.unionByName(move).write.parquet(f"{folder}/round{done + 1}")
            scratch.remove(spark, f"{folder}/round{done}")
    return codebooks


def encode(vectors: DataFrame, codebooks: Codebooks, vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """The rows that take part, as a struct ``row``, with ``code`` (two hex digits a part) and ``error``."""
    positions, _, width = codebooks.entries.shape
    result = "struct<code: string, error: bigint>"
    hex_pairs = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)

    @F.arrow_udf(result)
    def coded(v: pa.Array) -> pa.Array:
        n = len(v)
        parts = _matrix(v, positions * width).reshape(n * positions, width)
        best, away = codebooks.nearest(np.tile(np.arange(positions), n), parts)
        error = away.reshape(n, positions).astype(object).sum(1) if n else away
        if n and max(error) >= 2**63:
            raise ValueError("the squared error of a vector does not fit 64 bits")
        text = hex_pairs[best.reshape(n, positions)].reshape(n, 2 * positions).tobytes().decode()
        codes = [text[i : i + 2 * positions] for i in range(0, len(text), 2 * positions)] if positions else [""] * n
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(list(error), pa.int64())], names=["code", "error"])

    names = [f"c{i}" for i in range(len(vectors.columns))]
    at = [c.lower() for c in vectors.columns].index(vector.lower())
    rows = vectors.toDF(*names).select(F.struct(*names).alias("row"), quantised(F.col(f"c{at}"), scale).alias("v")).where("v is not null")
    found = rows.select("row", coded(_padded(F.col("v"), positions * width)).alias("found"))
    return found.select("row", "found.code", "found.error")


def with_label_error(coded: DataFrame, label: Column) -> DataFrame:
    """``coded`` (from ``encode``) with ``label_error``: the error summed over rows of equal label, nulls together."""
    written = coded.withColumn("label__", label).checkpoint()
    sums = written.groupBy("label__").agg(F.sum("error").alias("label_error")).withColumnRenamed("label__", "of__")
    return written.join(sums, F.col("label__").eqNullSafe(F.col("of__"))).drop("label__", "of__")
