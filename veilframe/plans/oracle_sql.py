"""SQL fragments (DuckDB dialect) for the independent oracle of each query.

The oracle restates each operator's semantics in plain SQL over the same
parquet tables. Helpers here build the repetitive pieces: HMAC pads as blob
literals, exact Python rounding, masks, bins, and the scan patterns rewritten
for RE2 (no look-around: word boundaries become explicit non-word characters).
"""

from __future__ import annotations

import hashlib

from ..functions.generalize import DEFAULT_AGE_BINS
from ..functions.masking import HMAC_BLOCK_SIZE, HMAC_IPAD_BYTE, HMAC_OPAD_BYTE

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
NWL = r"[^\p{L}\p{N}_\n]"  # a non-word character that '.' could also consume
S = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
D = r"\p{Nd}"


def _words(a: str, b: str) -> str:
    """RE2 for ``\\bA\\b.*\\bB\\b`` on one line."""
    return f"(^|{NW})({a}){NWL}(.*{NWL})?({b})({NW}|$)"


def _word(alts: str) -> str:
    return f"(^|{NW})({alts})({NW}|$)"


# The SQL-injection, markup and dangerous-content patterns in RE2 form, in
# the same order as the fixed Python patterns.
SQLI_RE2 = [
    f"'{S}*(OR|AND){S}*'?{D}*'?{S}*={S}*'?{D}*",
    r"(--|#|/\*|\*/)",
    _words("UNION", "SELECT"),
    _words("DROP", "TABLE"),
    _words("INSERT", "INTO"),
    _words("UPDATE", "SET"),
    _words("DELETE", "FROM"),
    _word("EXEC|EXECUTE"),
    _word("CAST|CONVERT"),
    _word("CONCAT"),
    r"(xp_|sp_)",
    f";(.*{NWL})?(DROP|CREATE|ALTER|TRUNCATE)({NW}|$)",
]
XSS_RE2 = [
    r"<script[^>]*>.*?</script>",
    f"on{W}+{S}*=",
    r"javascript:",
    r"<iframe",
    r"<object",
    r"<embed",
    r"<img[^>]+src[^>]*>",
]
DANGEROUS_RE2 = [
    r"[;&|`$]",
    r"\.\.",
    r"<script",
    r"javascript:",
    r"eval\(",
    r"exec\(",
    f"import{S}+os",
    r"__import__",
]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def any_match(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, {q(p)}, 'i')" for p in patterns) + ")"


def n_matches(expr: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({expr}, {q(p)}, 'i') AS INTEGER)" for p in patterns) + ")"


def blob(b: bytes) -> str:
    return "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"


def hmac_sql(expr: str, key: bytes, out_len: int) -> str:
    if len(key) > HMAC_BLOCK_SIZE:
        key = hashlib.sha256(key).digest()
    key = key.ljust(HMAC_BLOCK_SIZE, b"\x00")
    ipad = bytes(x ^ HMAC_IPAD_BYTE for x in key)
    opad = bytes(x ^ HMAC_OPAD_BYTE for x in key)
    inner = f"unhex(sha256({blob(ipad)} || encode(CAST({expr} AS VARCHAR))))"
    outer = f"unhex(sha256({blob(opad)} || {inner}))"
    return f"substr(translate(to_base64({outer}), '+/=', '-_'), 1, {out_len})"


def mask_sql(expr: str, keep: int = 4, ch: str = "*") -> str:
    s = f"CAST({expr} AS VARCHAR)"
    return (f"CASE WHEN length({s}) <= {keep} THEN repeat({q(ch)}, length({s})) "
            f"ELSE repeat({q(ch)}, length({s}) - {keep}) || right({s}, {keep}) END")


def age_sql(expr: str, bins=None) -> str:
    edges = list(DEFAULT_AGE_BINS if bins is None else bins)
    a = f"CAST(trunc(CAST({expr} AS DOUBLE)) AS BIGINT)"
    parts = [f"WHEN {a} IS NULL THEN NULL", f"WHEN {a} < {edges[0]} THEN '<{edges[0]}'"]
    for lo, hi in zip(edges, edges[1:]):
        parts.append(f"WHEN {a} < {hi} THEN '{lo}-{hi - 1}'")
    return "CASE " + " ".join(parts) + f" ELSE '>={edges[-1]}' END"


def age_width_sql(expr: str, w: int) -> str:
    a = f"CAST(trunc(CAST({expr} AS DOUBLE)) AS BIGINT)"
    lo = f"(CAST(floor({a} / {w}) AS BIGINT) * {w})"
    return f"CAST({lo} AS VARCHAR) || '-' || CAST({lo} + {w - 1} AS VARCHAR)"


_SPLIT = "134217729.0"


def _two_product_err(a: str, b: float) -> str:
    """Error term of Dekker's product a*b (b a constant)."""
    t = b * 134217729.0
    bh = t - (t - b)
    bl = b - bh
    p = f"({a} * {b!r})"
    ta = f"({a} * {_SPLIT})"
    ah = f"({ta} - ({ta} - {a}))"
    al = f"({a} - {ah})"
    return f"((({ah} * {bh!r} - {p}) + {ah} * {bl!r} + {al} * {bh!r}) + {al} * {bl!r})"


def python_round_sql(expr: str, p: int) -> str:
    """Python's exact ``round(x, p)`` on doubles, as in the Spark expression."""
    x = f"CAST({expr} AS DOUBLE)"
    if p == 0:
        return f"round_even({x}, 0)"
    f = float(10 ** abs(p))
    if p > 0:
        hi = f"({x} * {f!r})"
        err = _two_product_err(x, f)
        fin = "/"
    else:
        hi = f"({x} / {f!r})"
        err = f"(({x} - ({hi} * {f!r})) - {_two_product_err(hi, f)})"
        fin = "*"
    fl = f"floor({hi})"
    half = 0.5 if p > 0 else 0.5 * f
    int_tie = f"({hi} = {fl} AND abs({err}) = {half!r})"
    n = (f"(CASE WHEN {hi} - {fl} = 0.5 AND {err} > 0 THEN {fl} + 1.0 "
         f"WHEN {hi} - {fl} = 0.5 AND {err} < 0 THEN {fl} "
         f"WHEN {int_tie} AND abs(fmod({hi}, 2.0)) = 1.0 THEN {hi} + sign({err}) "
         f"WHEN {int_tie} THEN {hi} ELSE round_even({hi}, 0) END)")
    scale = 10.0 ** p
    guard = f"(isnan({x}) OR abs({x} * {scale!r}) >= 9007199254740992.0)"
    return f"(CASE WHEN {guard} THEN {x} ELSE {n} {fin} {f!r} END)"


def gen_numeric_sql(expr: str, precision: int) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    if precision == 0:
        return f"(CASE WHEN abs({x}) >= 4503599627370496.0 THEN {x} ELSE trunc({x}) END)"
    return python_round_sql(expr, precision)


def gen_qi_num_sql(expr: str, level: int, cast: str | None = None) -> str:
    f = float(10 ** level) if level >= 0 else 10.0 ** level
    out = f"(round_even(CAST({expr} AS DOUBLE) / {f!r}, 0) * {f!r} + 0.0)"
    return f"CAST({out} AS {cast})" if cast else out


def gen_qi_str_sql(expr: str, level: int) -> str:
    if level == 0:
        return expr
    g = f"greatest(1, length({expr}) - {level})"
    return f"(left({expr}, {g}) || repeat('*', length({expr}) - {g}))"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, {q('^' + S + '+|' + S + '+$')}, '', 'g')"


def r9(expr: str) -> str:
    return f"round({expr}, 9)"
