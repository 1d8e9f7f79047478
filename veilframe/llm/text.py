"""Vectorised UTF-8 text helpers that the operators of this package share.

Texts reach the tasks as Arrow string columns, whose data buffer is one run of
UTF-8 bytes with offsets. Words, runs and hashes are found on that buffer with
numpy, a bounded slice of rows at a time, so no per-character Python runs.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows of a task are handled in slices of about this many text bytes (one longer text is a slice of its own).
SLICE_BYTES = 2_000_000

_RANDOM = np.random.default_rng(20240501)
_BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED_CODE = _BYTE_CODE.copy()
_FOLDED_CODE[65:91] = _BYTE_CODE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, min(1 << n.bit_length(), SLICE_BYTES + 1))
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def byte_class(pattern_bytes: bytes | range | list[int]) -> np.ndarray:
    """Lookup table: True for the bytes listed."""
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: Word bytes of the benchmark contract: digits, letters and everything from U+0080 up.
WORD_BYTES = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Everything but ASCII white space and controls that count as white space.
VISIBLE_BYTES = ~byte_class(b" \t\n\r\x0b\x0c")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows (null reads as empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of ``text`` (at least one row each)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = utf8(column)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of the bytes in ``table``; no run crosses a row."""
    inside = table[data]
    first = inside.copy()
    last = inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    rows = offsets[:-1][np.diff(offsets) > 0]
    first[rows] = inside[rows]
    last[rows[1:] - 1] = inside[rows[1:] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit polynomial hash of each byte span; with ``fold``, blind to the case of A-Z."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED_CODE if fold else _BYTE_CODE)[data] * up[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and products of hashes spread over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, positions, "right") - 1


def code_points(data: np.ndarray) -> np.ndarray:
    """``code_points(data)[i]``: code points that begin before byte i."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def spread(lo: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``lo[i], lo[i]+1, ...`` of ``counts[i]`` numbers each."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(lo - (ends - counts), counts) + np.arange(total)


def give_back() -> None:
    """Hand freed memory back to the system, which a long-lived process (the driver) would hold on to otherwise."""
    pa.default_memory_pool().release_unused()
    # the C library keeps freed pieces between used ones; only glibc has this call
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def annotate(
    docs: DataFrame,
    inputs: dict[str, tuple[str, object]],
    task: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]],
    result: StructType,
) -> DataFrame:
    """Rows of ``docs`` with the columns of ``result`` that ``task`` derives from ``inputs``.

    ``inputs`` maps a name to a column of ``docs`` and the type to cast it to.
    ``task`` gets batches with these columns (the first is the text) and yields, for each
    batch in turn, the result columns. The row itself travels in one struct
    column ``doc``, so columns of ``docs`` never clash with those added, whatever
    their names: the output is ``doc`` beside the result columns.
    """
    positions = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    names = [f"c{i}" for i in range(len(docs.columns))]
    by_name = {name.lower(): f"c{i}" for i, name in reversed(list(enumerate(docs.columns)))}
    wide = positions.select(
        F.struct(*names).alias("doc"),
        *[F.col(by_name[of.lower()]).cast(kind).alias(name) for name, (of, kind) in inputs.items()],
    )
    schema = StructType([wide.schema["doc"], *result.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Array] = []

        def tee() -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, next(iter(inputs))):
                kept.append(batch.column(0))
                yield batch

        for columns in task(tee()):
            yield pa.RecordBatch.from_arrays([kept.pop(0), *columns], names=schema.names)

    return wide.mapInArrow(run, schema)


def original(annotated: DataFrame, docs: DataFrame, replaced: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` back out of ``annotate``'s result, some of them replaced."""
    replaced = replaced or {}
    columns = []
    for i, field in enumerate(docs.schema.fields):
        value = replaced.get(field.name, F.col("doc")[f"c{i}"])
        columns.append(value.cast(field.dataType).alias(field.name))
    return annotated.select(*columns)


def struct_of(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each byte span, equal for equal spans only."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    packed = data[spread(starts, sizes)] if len(sizes) else data[:0]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)
