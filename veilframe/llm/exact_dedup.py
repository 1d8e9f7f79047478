"""Exact deduplication by two-pass Bloom filtering (operator 12).

Texts are equal when they are the same without ASCII white space. The texts are
read once: every row's SHA-256, length and number go to a narrow table in the
shared folder. The first pass over that table builds a filter of slots that
count 0, 1 or 2-and-more: a row touches one slot of each of two segments, and
counts add up over tasks, so the filter says which hashes may occur twice and
never misses one that does. The second pass asks it: a row one of whose slots
was touched once has no equal and passes straight through. Only the rows that
are left shuffle, by hash, pre-aggregated, to elect one row of each group.

The filter is as large as the rows ask for, up to ``WAVE_ROWS`` rows (64 MB);
beyond them the hashes are dealt to several waves, each with a filter of its own
over its own folder of the narrow table. Waves run one after the other, each
writes its answers and drops its filter, so neither the driver nor a broadcast
ever holds more than one. The group table is broadcast if its measured bytes
allow, else joined by a shuffle (``operators.joins``). The two narrow tables
stay in the shared folder, as the lazy result reads them.

Defined results. A null text counts as empty; all empty texts are equal. Of
equal texts the longest original (in code points) stays, then the smallest key
(null last), then the row read first: of rows repeated in full one stays. An
empty table gives no rows. Columns that are carried travel in a struct ``doc``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm import scratch
from veilframe.llm import text as tx
from veilframe.operators.joins import sized_join

#: Rows of one wave's filter, and slots for each row in each of the two segments (then a power of two).
WAVE_ROWS, SLOTS_PER_ROW = 1 << 25, 8
SEGMENTS = 2
#: Slots of one block of a filter, the unit that tasks add up.
BLOCK_SLOTS = 1 << 16
#: Keys that a task collects before it counts them.
_BATCH_KEYS = 1 << 20
_SALT = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
WHITE_SPACE = "[ \\t-\\r]+"


def normalised(text: Column) -> Column:
    """The text without white space (null: empty)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def slot_bits(rows: int) -> int:
    """log2 of a segment's slots, for so many rows."""
    return max(16, int(np.ceil(np.log2(max(1, min(rows, WAVE_ROWS)) * SLOTS_PER_ROW))))


def slots(keys: np.ndarray, segment: int, bits: int) -> np.ndarray:
    """The slot of each 64-bit key in one segment."""
    mixed = tx.mix(keys.astype(np.uint64) ^ np.uint64(_SALT[segment]))
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class Block:
    """Counts, up to two, of the slots of one block: which were touched, and which twice."""

    def __init__(self):
        self.once, self.twice = np.zeros(BLOCK_SLOTS, bool), np.zeros(BLOCK_SLOTS, bool)

    def add(self, once: np.ndarray, twice: np.ndarray) -> None:
        """Positions touched, and those of them touched more than once, by rows not counted so far."""
        self.twice[once[self.once[once]]] = True
        self.twice[twice] = True
        self.once[once] = True


def _packed(positions: np.ndarray) -> bytes:
    return positions.astype(np.uint16).tobytes()


_COUNTS = "wave int, segment int, block int, once binary, twice binary"


def _count(bits: int) -> Callable:
    """Per task and million keys: the touched slots of each block, as 16-bit positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waves: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        for batch in batches:
            waves.append(batch.column(0).to_numpy())
            keys.append(batch.column(1).to_numpy())
            if sum(map(len, keys)) >= _BATCH_KEYS:
                yield from counted(np.concatenate(waves), np.concatenate(keys))
                waves, keys = [], []
        if keys:
            yield from counted(np.concatenate(waves), np.concatenate(keys))

    def counted(wave: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        for segment in range(SEGMENTS):
            touched, times = np.unique((wave.astype(np.int64) << bits) | slots(keys, segment, bits), return_counts=True)
            block, at = touched // BLOCK_SLOTS, touched % BLOCK_SLOTS
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(block)]
            of = 1 << (bits - 16)
            rows = [(block[a] // of, block[a] % of, _packed(at[a:b]), _packed(at[a:b][times[a:b] > 1])) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([segment] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                names=["wave", "segment", "block", "once", "twice"],
            )

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a task, each from the counts of all tasks: the slots touched twice."""
    found: dict[tuple[int, int, int], Block] = {}
    for batch in batches:
        for wave, segment, block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault((wave, segment, block), Block()).add(np.frombuffer(once, np.uint16), np.frombuffer(twice, np.uint16))
    for (wave, segment, block), counts in found.items():
        if counts.twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([wave], pa.int32()), pa.array([segment], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(counts.twice).tobytes()], pa.binary())], names=["wave", "segment", "block", "twice"])


class Filter:
    """One wave's slots that were touched twice, one bit each."""

    def __init__(self, bits: int, blocks: list[tuple[int, int, bytes]]):
        self.bits = bits
        self.twice = np.zeros((SEGMENTS, (1 << bits) // 8), np.uint8)
        for segment, block, packed in blocks:
            at = block * (BLOCK_SLOTS // 8)
            self.twice[segment, at : at + BLOCK_SLOTS // 8] = np.frombuffer(packed, np.uint8)

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that occur once."""
        out = np.ones(len(keys), bool)
        for segment in range(SEGMENTS):
            at = slots(keys, segment, self.bits)
            out &= (self.twice[segment, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out


def build_filters(keys: DataFrame, bits: int, waves: int) -> Iterator[Filter]:
    """First pass over (wave, key): each wave's filter, one after the other."""
    counts = keys.mapInArrow(_count(bits), _COUNTS)
    twice = counts.repartition("wave", "segment", "block").mapInArrow(_add_up, "wave int, segment int, block int, twice binary").checkpoint()
    for wave in range(waves):
        yield Filter(bits, [(r.segment, r.block, r.twice) for r in twice.where(F.col("wave") == wave).collect()])
    scratch.remove_checkpoint(twice)


def _probe(shared) -> Column:
    @F.arrow_udf("boolean")
    def may_repeat(keys: pa.Array) -> pa.Array:
        return pa.array(shared.value.may_repeat(keys.to_numpy()))

    return may_repeat("key")


def number_texts(docs: DataFrame, key: str, text: str, carry: list[str], wave_rows: int = WAVE_ROWS) -> tuple[DataFrame, int, int]:
    """The narrow table, written once: carried columns, key, code points, SHA-256, row number, wave; its rows and waves."""
    spark = docs.sparkSession
    scratch.folder(spark, "")  # the shared folder is set
    names = [f"c{i}" for i in range(len(docs.columns))]
    by_name = {c.lower(): f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    rows = docs.toDF(*names)
    total = rows.count()
    waves = max(1, -(-total // wave_rows))
    doc = F.struct(*[F.col(by_name[c.lower()]).alias(f"c{i}") for i, c in enumerate(carry)])
    whole = F.col(by_name[text.lower()])
    narrow = rows.select(
        doc.alias("doc"),
        F.col(by_name[key.lower()]).alias("id"),
        F.length(F.coalesce(whole, F.lit(""))).cast("long").alias("n"),
        F.unhex(F.sha2(normalised(whole), 256)).alias("sha"),
        F.monotonically_increasing_id().alias("number"),
    )
    hashed = narrow.withColumn("key", F.xxhash64("sha")).withColumn("wave", F.pmod(F.xxhash64("key"), F.lit(waves)).cast("int"))
    folder = scratch.folder(spark, "exact_dedup")
    hashed.write.partitionBy("wave").parquet(folder)
    written = spark.read.schema(hashed.schema).parquet(folder)
    return written, total, waves


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, wave_rows: int = WAVE_ROWS) -> DataFrame:
    """Every row as ``doc`` (the columns ``carry``, by default the key), with its group.

    ``keep_id``: the key of the row that stays, ``group_size``, ``kept``, ``text_sha256`` of the normalised text.
    """
    spark = docs.sparkSession
    narrow, total, waves = number_texts(docs, key, text, carry or [key], wave_rows)
    bits = slot_bits(min(total, wave_rows))
    folder = scratch.folder(spark, "exact_dedup")
    for wave, found in enumerate(build_filters(narrow.select("wave", "key"), bits, waves)):
        shared = spark.sparkContext.broadcast(found)
        asked = narrow.where(F.col("wave") == wave).withColumn("may_repeat", _probe(shared)).drop("wave", "key")
        asked.write.mode("append").partitionBy("may_repeat").parquet(folder)
        shared.destroy()
    answered = spark.read.schema(asked.schema).parquet(folder)
    single, repeated = answered.where(~F.col("may_repeat")), answered.where("may_repeat")
    straight = single.select("doc", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), _hex("sha"))
    # the smallest of (-length, null key last, key, row number)
    place = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "number")
    groups = repeated.groupBy("sha").agg(F.min(place).alias("best"), F.count("*").alias("size")).where("size > 1")
    joined = sized_join(repeated, groups, ["sha"], "left")
    keep = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    kept = F.col("best").isNull() | (F.col("best.number") == F.col("number"))
    size = F.coalesce("size", F.lit(1).cast("long"))
    grouped = joined.select("doc", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), _hex("sha"))
    return straight.unionByName(grouped)


def _hex(sha: str) -> Column:
    return F.lower(F.hex(sha)).alias("text_sha256")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    found = exact_duplicates(docs, key, text, docs.columns).where("kept")
    return found.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])
