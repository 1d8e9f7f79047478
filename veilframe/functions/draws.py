"""Uniform draws for the random operators, keyed by a row or group key.

A keyed draw is cut from SHA-256 of the seed, a name and the key, so it depends
on nothing but its row: it is the same in every plan, on every partitioning and
after a lost task. One digest gives six independent draws of 40 bits (*lanes*),
so a row that needs several of them pays for one digest (``with_uniforms``). Name and key are
written unambiguously (lengths in front, NULL apart from the empty text), so
different names or keys never share a digest. Without a key a draw comes from
``rand``; it is bound once, so that expressions that use it several times see
one value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Draws of one digest, and bits of a draw.
LANES, BITS = 6, 40
_CHUNK = 15  # hex digits that fit a bigint: two chunks hold three draws


def named(parts: list[str] | tuple[str, ...]) -> str:
    """One name from several, with their lengths in front."""
    return "".join(f"{len(p)}:{p}" for p in parts)


def row_key(columns: list[str] | tuple[str, ...]) -> Column:
    """A text key from columns that tell the rows apart: each as length and text, NULL as a dash."""
    def part(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(*[part(c) for c in columns])


def _digest(key: Column, seed: int, name: str) -> Column:
    known = F.coalesce(F.concat(F.lit("+"), key.cast("string")), F.lit("-"))
    return F.sha2(F.concat(F.lit(f"{seed}|{named([name])}|"), known), 256)


def _chunk(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 1 + _CHUNK * i, _CHUNK), 16, 10).cast("bigint")


def _bits(first: Column, second: Column, place: int) -> Column:
    """One of the three draws of 40 bits in two chunks of 60."""
    if place == 0:
        return F.shiftright(first, 20)
    if place == 2:
        return second.bitwiseAND(F.lit(2 ** BITS - 1))
    return F.shiftleft(first.bitwiseAND(F.lit(2 ** 20 - 1)), 20).bitwiseOR(F.shiftright(second, BITS))


def _lane(key: Column, seed: int, name: str, lane: int) -> Column:
    """Draw ``lane`` (0 to 5) of the digest, as a bigint below 2^40."""
    digest = _digest(key, seed, name)
    pair, place = divmod(lane, 3)
    return _bits(_chunk(digest, 2 * pair), _chunk(digest, 2 * pair + 1), place)


def _uniform(bits: Column) -> Column:
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2 ** BITS))


def keyed_uniform(key: Column, seed: int, name: str, lane: int = 0) -> Column:
    """A double strictly between 0 and 1."""
    return _uniform(_lane(key, seed, name, lane))


def keyed_integer(key: Column, seed: int, name: str, n: int, lane: int = 0) -> Column:
    """An integer from 0 to n-1 (the bias is below n / 2^40)."""
    return F.pmod(_lane(key, seed, name, lane), F.lit(n)).cast("int")


def with_uniforms(df: DataFrame, key: Column, seed: int, name: str, lanes: int) -> tuple[DataFrame, list[str]]:
    """``df`` with the first draws (``keyed_uniform``) of one digest as columns, and their names.

    Digest, chunks and draws are projections of their own: Spark merges no projection whose costly
    columns are used more than once, so each is computed once a row.
    """
    digest, chunks = "__digest", [f"__chunk{i}" for i in range(2 * -(-lanes // 3))]
    names = [f"__u{i}" for i in range(lanes)]
    clash = [c for c in df.columns if c.lower() in (digest, *chunks, *names)]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    staged = df.withColumn(digest, _digest(key, seed, name))
    staged = staged.select(*df.columns, *[_chunk(F.col(digest), i).alias(c) for i, c in enumerate(chunks)])
    bits = [_bits(F.col(chunks[2 * (i // 3)]), F.col(chunks[2 * (i // 3) + 1]), i % 3) for i in range(lanes)]
    return staged.select(*df.columns, *[_uniform(b).alias(u) for b, u in zip(bits, names)]), names


def with_key(key: Column | None, seed: int, make: Callable[[Column], Column]) -> Column:
    """``make(key)``; without a key, with a fresh random key per row that is drawn once."""
    if key is not None:
        return make(key)
    return F.element_at(F.transform(F.array(F.rand(seed % 2 ** 62)), lambda u: make(u.cast("string"))), 1)
