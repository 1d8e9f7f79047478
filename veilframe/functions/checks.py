"""Per-value checks and sanitisers as Column expressions.

Each ``check_*`` returns a violation code (string) or NULL when the value
passes, so a table job can count and group violations in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DataType, DoubleType, FloatType, IntegerType, LongType, NumericType, StringType,
)

from .patterns import (
    DANGEROUS_FIRST, DANGEROUS_PATTERNS, IDENTIFIER_PATTERN, SPACE_CLASS, SQL_INJECTION_FIRST,
    SQL_INJECTION_PATTERNS, USERNAME_PATTERN, XSS_FIRST, XSS_PATTERNS, any_of, to_java,
)

SQLI_ANY = to_java(any_of(SQL_INJECTION_PATTERNS, SQL_INJECTION_FIRST))
XSS_ANY = to_java(any_of(XSS_PATTERNS, XSS_FIRST))
DANGEROUS_ANY = to_java(any_of(DANGEROUS_PATTERNS, DANGEROUS_FIRST))
_STRIP = f"^{SPACE_CLASS}+|{SPACE_CLASS}+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), _STRIP, "")


def is_sql_injection(c) -> Column:
    """V1: any of the SQL-injection patterns occurs (case-insensitive)."""
    return _col(c).rlike(SQLI_ANY)


def is_xss(c) -> Column:
    """V2: any of the markup/XSS patterns occurs (case-insensitive)."""
    return _col(c).rlike(XSS_ANY)


def is_dangerous(c) -> Column:
    """V3: shell metacharacters, traversal, script, eval/exec, imports."""
    return _col(c).rlike(DANGEROUS_ANY)


def sanitize_sql(c) -> Column:
    """V4: drop NUL, double quotes ``'``, remove ``; -- /* */ xp_`` in order, strip."""
    s = _col(c).cast(StringType())
    for old, new in (("\x00", ""), ("'", "''"), (";", ""), ("--", ""), ("/*", ""), ("*/", ""), ("xp_", "")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return py_strip(s)


def html_escape(c) -> Column:
    """``html.escape(s, quote=True)``: & first, then < > \" '."""
    s = _col(c).cast(StringType())
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def sanitize_xss(c) -> Column:
    """V5: escape markup, then remove script blocks, ``javascript:`` and ``on...=``."""
    s = html_escape(c)
    s = F.regexp_replace(s, "(?isu)<script[^>]*>.*?</script>", "")
    s = F.regexp_replace(s, "(?iu)javascript:", "")
    s = F.regexp_replace(s, to_java(r"on\w+\s*="), "")
    return s


def check_string(c, max_length: int = 1000, allow_special: bool = False) -> Column:
    """V6: first failing rule of length, SQL injection, XSS, dangerous content."""
    s = py_strip(_col(c))
    rule = (
        F.when(_col(c).isNull(), F.lit("not_string"))
        .when(F.length(s) > F.lit(max_length), F.lit("too_long"))
        .when(is_sql_injection(s), F.lit("sql_injection"))
        .when(is_xss(s), F.lit("xss"))
    )
    if not allow_special:
        rule = rule.when(is_dangerous(s), F.lit("dangerous"))
    return rule


def check_username(c) -> Column:
    """V7: non-empty, 3-50 chars after strip, no SQL injection, ``[A-Za-z0-9._-]+``."""
    raw = _col(c)
    s = py_strip(raw)
    n = F.length(s)
    return (
        F.when(raw.isNull() | (raw == F.lit("")), F.lit("empty"))
        .when((n < 3) | (n > 50), F.lit("length"))
        .when(is_sql_injection(s), F.lit("sql_injection"))
        .when(~s.rlike("(?d)" + USERNAME_PATTERN), F.lit("charset"))
    )


def check_identifier(c) -> Column:
    """V8: column-name rule: 1-255 chars, no dangerous content, ``[A-Za-z0-9_-]+``."""
    raw = _col(c)
    s = py_strip(F.replace(raw, F.lit("\x00"), F.lit("")))
    return (
        F.when(raw.isNull() | (raw == F.lit("")), F.lit("empty"))
        .when(F.length(s) > 255, F.lit("too_long"))
        .when(is_dangerous(s), F.lit("dangerous"))
        .when(~s.rlike("(?d)" + IDENTIFIER_PATTERN), F.lit("charset"))
    )


def _as_int(c, dtype: DataType | None) -> Column:
    col = _col(c)
    if isinstance(dtype, (FloatType, DoubleType)) or (isinstance(dtype, NumericType) and not isinstance(dtype, (IntegerType, LongType))):
        d = col.cast(DoubleType())
        return F.when(F.isnan(d) | (F.abs(d) >= F.lit(9.2e18)), F.lit(None)).otherwise(d.cast("bigint"))
    if isinstance(dtype, (IntegerType, LongType)):
        return col.cast("bigint")
    s = py_strip(col.cast(StringType()))
    return F.when(s.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(s, F.lit("_"), F.lit("")).try_cast("bigint"))


def check_int_range(c, min_val: int | None = None, max_val: int | None = None,
                    dtype: DataType | None = None) -> Column:
    """V9: castable to an integer (Python ``int``), then within [min, max]."""
    v = _as_int(c, dtype)
    rule = F.when(_col(c).isNull() | v.isNull(), F.lit("not_integer"))
    if min_val is not None:
        rule = rule.when(v < F.lit(int(min_val)), F.lit("below_min"))
    if max_val is not None:
        rule = rule.when(v > F.lit(int(max_val)), F.lit("above_max"))
    return rule


def check_float_range(c, min_val: float | None = None, max_val: float | None = None) -> Column:
    """Castable to a double, then within [min, max] (NaN compares false, as in Python)."""
    v = _col(c).try_cast(DoubleType())
    rule = F.when(_col(c).isNull() | v.isNull(), F.lit("not_number"))
    if min_val is not None:
        rule = rule.when(~F.isnan(v) & (v < F.lit(float(min_val))), F.lit("below_min"))
    if max_val is not None:
        rule = rule.when(~F.isnan(v) & (v > F.lit(float(max_val))), F.lit("above_max"))
    return rule


def check_string_constraint(c, min_length: int = 0, max_length: int = 10000,
                            allowed_chars: str | None = None) -> Column:
    """NUL removed; length bounds; ``allowed_chars`` must match at the start."""
    raw = _col(c)
    s = F.replace(raw.cast(StringType()), F.lit("\x00"), F.lit(""))
    n = F.length(s)
    rule = (
        F.when(raw.isNull(), F.lit("not_string"))
        .when(n < F.lit(min_length), F.lit("too_short"))
        .when(n > F.lit(max_length), F.lit("too_long"))
    )
    if allowed_chars:
        java = to_java(allowed_chars, ignore_case=False)
        flags, body = java[: java.index(")") + 1], java[java.index(")") + 1:]
        rule = rule.when(~s.rlike(f"{flags}^(?:{body})"), F.lit("pattern"))
    return rule


def check_list(c, dtype: DataType, item_type: type | DataType | None = None,
               min_items: int = 0, max_items: int = 1000) -> Column:
    """Is a list, item count within bounds, every item of the expected type."""
    arr = _col(c)
    if not isinstance(dtype, ArrayType):
        return F.lit("not_list")
    n = F.size(arr)
    rule = (
        F.when(arr.isNull(), F.lit("not_list"))
        .when(n < F.lit(min_items), F.lit("too_few"))
        .when(n > F.lit(max_items), F.lit("too_many"))
    )
    if item_type is not None:
        type_ok = _element_type_matches(dtype.elementType, item_type)
        if not type_ok:
            rule = rule.when(n > 0, F.lit("item_type"))
        else:
            rule = rule.when(F.exists(arr, lambda x: x.isNull()), F.lit("item_type"))
    return rule


def _element_type_matches(elem: DataType, item_type) -> bool:
    if isinstance(item_type, DataType):
        return elem == item_type
    if item_type is float:
        return isinstance(elem, (FloatType, DoubleType))
    if item_type is int:
        return isinstance(elem, (IntegerType, LongType)) or elem.typeName() in ("short", "byte")
    if item_type is str:
        return isinstance(elem, StringType)
    if item_type is bool:
        return elem.typeName() == "boolean"
    return False
