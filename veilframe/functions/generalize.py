"""Generalisation expressions: age bins (T7), numeric precision (T8) and the
quasi-identifier generalisers used by the k-anonymity search (A2, A3, A3b).

``python_round`` reproduces Python's ``round(x, p)`` on doubles exactly: Python
rounds the *binary* value half-to-even, so 123.45 (stored as 123.4500000000000028)
becomes 123.5, while a decimal-based rounding gives 123.4. We get the exact
product ``x * 10**p`` as ``hi + lo`` with Dekker's error-free multiplication
(plain IEEE ``*``/``-``, no FMA needed), round ``hi`` half-to-even and use the
sign of ``lo`` to break exact ``.5`` ties. All of it is built-in arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DecimalType, DoubleType, FloatType, NumericType, StringType,
)

# Fixed default age bins of the generalize_age transform.
DEFAULT_AGE_BINS = (0, 18, 30, 45, 65, 120)

_SPLITTER = 134217729.0  # 2**27 + 1, Veltkamp splitting constant for doubles
_TWO52 = 4503599627370496.0  # 2**52: doubles at or above are integral
_TWO53 = 9007199254740992.0  # 2**53


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _split(a: Column) -> tuple[Column, Column]:
    t = a * F.lit(_SPLITTER)
    hi = t - (t - a)
    return hi, a - hi


def _two_product(a: Column, b: float) -> tuple[Column, Column]:
    """Error-free product: a*b == p + e exactly (b a Python float constant)."""
    p = a * F.lit(b)
    ah, al = _split(a)
    t = b * _SPLITTER
    bh = t - (t - b)
    bl = b - bh
    e = ((ah * F.lit(bh) - p) + ah * F.lit(bl) + al * F.lit(bh)) + al * F.lit(bl)
    return p, e


def _round_half_even_with_error(hi: Column, err: Column, half: float = 0.5) -> Column:
    """Round hi+err (exact) half-to-even, given hi is the double nearest to it.

    ``half`` is the value of ``err`` that means half a unit (0.5, or 0.5*f
    when ``err`` is a remainder in units of f). Two tie shapes: hi ends in .5
    (the sign of err decides), or hi is an integer of at least 2**52 and err
    is exactly half a unit (the even neighbour wins).
    """
    fl = F.floor(hi).cast(DoubleType())
    frac_tie = (hi - fl) == F.lit(0.5)
    int_tie = (hi == fl) & (F.abs(err) == F.lit(half))
    odd = F.pmod(hi, F.lit(2.0)) == F.lit(1.0)
    return (
        F.when(frac_tie & (err > 0), fl + 1.0)
        .when(frac_tie & (err < 0), fl)
        .when(int_tie & odd, hi + F.signum(err))
        .when(int_tie, hi)
        .otherwise(F.rint(hi))
    )


def python_round(c, ndigits: int) -> Column:
    """``round(x, ndigits)`` with Python's exact semantics for doubles."""
    x = _col(c).try_cast(DoubleType())
    if ndigits == 0:
        return F.rint(x)
    if ndigits > 0:
        if ndigits > 22:  # 10**p no longer exact; every double is already that precise
            return x
        f = float(10 ** ndigits)
        hi, lo = _two_product(x, f)
        n = _round_half_even_with_error(hi, lo)
        res = n / F.lit(f)
    else:
        if -ndigits > 22:
            return x * 0.0
        f = float(10 ** (-ndigits))
        q = x / F.lit(f)
        ph, pl = _two_product(q, f)
        rem = (x - ph) - pl  # x == q*f + rem exactly; sign(rem) = sign(true q - q)
        n = _round_half_even_with_error(q, rem, 0.5 * f)
        res = n * F.lit(f)
    # From |x * 10**p| >= 2**53 on, a step of 10**-p is below one ulp of x, so
    # the rounded decimal converts back to x itself.
    guard = F.isnan(x) | (F.abs(x * F.lit(10.0 ** ndigits)) >= F.lit(_TWO53))
    return F.when(guard, x).otherwise(res)


def _int_like(c, dtype: DataType | None) -> Column:
    """Python ``int(v)``: truncate numbers toward zero, parse integer strings."""
    col = _col(c)
    if dtype is None or isinstance(dtype, NumericType):
        if isinstance(dtype, (DoubleType, FloatType, DecimalType)) or dtype is None:
            d = col.try_cast(DoubleType())
            return F.when(F.isnan(d) | (F.abs(d) >= F.lit(9.2e18)), F.lit(None)).otherwise(d.cast("bigint"))
        return col.cast("bigint")
    s = F.trim(col.cast(StringType()))
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def generalize_age(c, bins: Sequence[int] | None = None, dtype: DataType | None = None,
                   bin_size: int | None = None, on_invalid: str = "null") -> Column:
    """Map an age to a half-open bin label ``lo-(hi-1)``; ``>=last`` at or above
    the last edge, ``<first`` below the first edge.

    ``bin_size`` gives fixed-width bins ``[i*w, (i+1)*w)`` instead of edges.
    Unparsable values become NULL, or their text with ``on_invalid='keep'``.
    """
    age = _int_like(c, dtype)
    if bin_size is not None:
        w = int(bin_size)
        if w <= 0:
            raise ValueError("bin_size must be positive")
        lo = F.floor(age / F.lit(w)).cast("bigint") * F.lit(w)
        label = F.concat(lo.cast("string"), F.lit("-"), (lo + F.lit(w - 1)).cast("string"))
    else:
        edges = [int(b) for b in (DEFAULT_AGE_BINS if bins is None else bins)]
        if len(edges) < 2 or any(b2 <= b1 for b1, b2 in zip(edges, edges[1:])):
            raise ValueError("bins must be at least two strictly increasing edges")
        label = F.when(age.isNull(), F.lit(None).cast(StringType()))
        label = label.when(age < F.lit(edges[0]), F.lit(f"<{edges[0]}"))
        for lo_e, hi_e in zip(edges, edges[1:]):
            label = label.when(age < F.lit(hi_e), F.lit(f"{lo_e}-{hi_e - 1}"))
        label = label.otherwise(F.lit(f">={edges[-1]}"))
    invalid = _col(c).isNotNull() & age.isNull()
    if on_invalid == "keep":
        return F.when(invalid, _col(c).cast(StringType())).otherwise(label)
    if on_invalid != "null":
        raise ValueError("on_invalid must be 'null' or 'keep'")
    return label


def generalize_numeric(c, precision: int = 0, bin_size: float | None = None, on_invalid: str = "null") -> Column:
    """Reduce numeric precision; the result is a double.

    precision 0 truncates toward zero (``float(int(x))``); otherwise Python's
    ``round(x, precision)``. ``bin_size`` floors to multiples of the bin width.
    Text that is no number becomes NULL, or with ``on_invalid='keep'`` stays as
    it is (the result is then text).
    """
    if on_invalid == "keep":
        number = generalize_numeric(c, precision, bin_size)
        unread = _col(c).isNotNull() & _col(c).try_cast(DoubleType()).isNull()
        return F.when(unread, _col(c).cast(StringType())).otherwise(number.cast(StringType()))
    if on_invalid != "null":
        raise ValueError("on_invalid must be 'null' or 'keep'")
    x = _col(c).try_cast(DoubleType())
    if bin_size is not None:
        w = float(bin_size)
        if w <= 0:
            raise ValueError("bin_size must be positive")
        return F.floor(x / F.lit(w)) * F.lit(w)
    if precision == 0:
        return F.when(F.isnan(x) | (F.abs(x) >= F.lit(_TWO52)), x).otherwise(x.cast("bigint").cast(DoubleType()))
    return python_round(x, precision)


# --- quasi-identifier generalisers used by the k-anonymity search -----------

def generalize_qi_numeric(c, level: int, dtype: DataType | None = None) -> Column:
    """A2: round to the nearest ``10**level`` (half-to-even), back to the source type."""
    x = _col(c).try_cast(DoubleType())
    f = float(10 ** level) if level >= 0 else 10.0 ** level
    # "+ 0.0" turns -0.0 into 0.0: Python's round() returns an int, so the
    # reference never yields a negative zero.
    out = F.rint(x / F.lit(f)) * F.lit(f) + F.lit(0.0)
    if dtype is None or isinstance(dtype, (DoubleType, FloatType)):
        return out if dtype is None else out.cast(dtype)
    # a value that rounds beyond the type's range is cut to the last multiple inside it
    # (TINYINT 127 at level 1 gives 120), so the job never fails on overflow
    return F.when(x.isNull(), F.lit(None).cast(dtype)).otherwise(
        F.coalesce(out.try_cast(dtype), (F.signum(x) * F.floor(F.abs(x) / F.lit(f)) * F.lit(f)).try_cast(dtype)))


def generalize_qi_string(c, level: int) -> Column:
    """A3: keep ``max(1, len-level)`` leading characters, pad with ``*`` to the same length."""
    s = _col(c).cast(StringType())
    if level == 0:
        return s
    n = F.length(s)
    g = F.greatest(F.lit(1), n - F.lit(level))
    return F.concat(F.substring(s, F.lit(1), g), F.repeat(F.lit("*"), n - g))


def generalize_qi(c, dtype: DataType, level: int) -> Column:
    """Numeric -> A2, string -> A3, any other type unchanged."""
    if isinstance(dtype, NumericType) and not isinstance(dtype, BooleanType):
        return generalize_qi_numeric(c, level, dtype)
    if isinstance(dtype, StringType):
        return generalize_qi_string(c, level)
    return _col(c)
