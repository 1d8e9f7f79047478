"""SQL registration of the column transforms as SQL-bodied temporary functions.

``register_sql_functions(spark, ...)`` defines ``veil_mask``, ``veil_hash``,
``veil_round`` (Python's exact rounding), ``veil_hmac``, ``veil_age`` and
``veil_generalize_string`` for ``spark.sql``.
The bodies are plain SQL expressions, so Catalyst inlines them into the plan
exactly like the ``Column`` versions (no Python, no JVM UDF).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from .generalize import DEFAULT_AGE_BINS
from .masking import _hmac_pads


def _hex(b: bytes) -> str:
    return "X'" + b.hex().upper() + "'"


_SPLIT = "134217729.0"  # 2**27 + 1


def _two_product_err(a: str, b: str) -> str:
    """SQL text of the rounding error of a*b (Dekker), for double expressions a and b."""
    ta, tb = f"({a} * {_SPLIT})", f"({b} * {_SPLIT})"
    ah, bh = f"({ta} - ({ta} - {a}))", f"({tb} - ({tb} - {b}))"
    al, bl = f"({a} - {ah})", f"({b} - {bh})"
    return f"((({ah} * {bh} - ({a} * {b})) + {ah} * {bl} + {al} * {bh}) + {al} * {bl})"


def _half_even(hi: str, err: str, half: str) -> str:
    fl = f"CAST(floor({hi}) AS DOUBLE)"
    tie = f"({hi} = {fl} AND abs({err}) = {half})"
    return (f"(CASE WHEN {hi} - {fl} = 0.5 AND {err} > 0 THEN {fl} + 1.0 "
            f"WHEN {hi} - {fl} = 0.5 AND {err} < 0 THEN {fl} "
            f"WHEN {tie} AND pmod({hi}, 2.0) = 1.0 THEN {hi} + sign({err}) "
            f"WHEN {tie} THEN {hi} ELSE rint({hi}) END)")


def _round_body() -> str:
    """Python's exact ``round(x, p)`` for doubles, as SQL over parameters x and p."""
    f = "power(10.0, abs(p))"
    pos = f"({_half_even(f'(x * {f})', _two_product_err('x', f), '0.5')} / {f})"
    q = f"(x / {f})"
    rem = f"((x - {q} * {f}) - {_two_product_err(q, f)})"
    neg = f"({_half_even(q, rem, f'(0.5 * {f})')} * {f})"
    return (f"CASE WHEN isnan(x) OR abs(x * power(10.0, p)) >= 9007199254740992.0 OR abs(p) > 22 THEN x "
            f"WHEN p = 0 THEN rint(x) WHEN p > 0 THEN {pos} ELSE {neg} END")


def register_sql_functions(spark: SparkSession, hmac_key: bytes | None = None,
                           age_bins: Sequence[int] | None = None) -> list[str]:
    """Register the functions for this session; returns their names."""
    names = []

    def create(sql: str, name: str) -> None:
        spark.sql(sql)
        names.append(name)

    create("""CREATE OR REPLACE TEMPORARY FUNCTION veil_mask(s STRING, keep INT, ch STRING) RETURNS STRING
        RETURN CASE WHEN length(s) <= keep THEN repeat(ch, length(s))
                    ELSE concat(repeat(ch, length(s) - keep), CASE WHEN keep > 0 THEN right(s, keep) ELSE '' END) END""",
           "veil_mask")
    create("""CREATE OR REPLACE TEMPORARY FUNCTION veil_hash(s STRING, salt STRING) RETURNS STRING
        RETURN sha2(concat(salt, s), 256)""", "veil_hash")
    create(f"""CREATE OR REPLACE TEMPORARY FUNCTION veil_round(x DOUBLE, p INT) RETURNS DOUBLE
        RETURN {_round_body()}""", "veil_round")
    if hmac_key:
        ipad, opad = _hmac_pads(hmac_key)
        create(f"""CREATE OR REPLACE TEMPORARY FUNCTION veil_hmac(s STRING, n INT) RETURNS STRING
            RETURN replace(replace(replace(substring(base64(unhex(sha2(concat({_hex(opad)},
                   unhex(sha2(concat({_hex(ipad)}, cast(s AS BINARY)), 256))), 256))), 1, n),
                   '+', '-'), '/', '_'), '=', '')""", "veil_hmac")
    edges = [int(b) for b in (DEFAULT_AGE_BINS if age_bins is None else age_bins)]
    cases = " ".join(f"WHEN a < {hi} THEN '{lo}-{hi - 1}'" for lo, hi in zip(edges, edges[1:]))
    create(f"""CREATE OR REPLACE TEMPORARY FUNCTION veil_age(a BIGINT) RETURNS STRING
        RETURN CASE WHEN a IS NULL THEN NULL WHEN a < {edges[0]} THEN '<{edges[0]}' {cases}
                    ELSE '>={edges[-1]}' END""", "veil_age")
    create("""CREATE OR REPLACE TEMPORARY FUNCTION veil_generalize_string(s STRING, lvl INT) RETURNS STRING
        RETURN CASE WHEN lvl = 0 THEN s
                    ELSE concat(substring(s, 1, greatest(1, length(s) - lvl)),
                                repeat('*', length(s) - greatest(1, length(s) - lvl))) END""",
           "veil_generalize_string")
    return names
