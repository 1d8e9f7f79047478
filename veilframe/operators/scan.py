"""Content scans and constraint checks as table jobs.

The reference validates one request string at a time; here every check runs
over a whole column: per-row flags or violation codes from built-in regex and
string expressions (map-only, no shuffle), and per-pattern / per-violation
counts from one aggregation.

JSON documents (V13) are parsed into Variant values and walked inside the row:
the nodes of a depth are one array, unrolled from ``map<string,variant>`` and
``array<variant>`` casts of the array above (to depth 11). No shuffle, cache or
key is needed, and nothing is parsed in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.patterns import (
    DANGEROUS_PATTERNS, SQL_INJECTION_PATTERNS, XSS_PATTERNS, required_literals, to_java,
)

PATTERN_SETS = {
    "sql_injection": SQL_INJECTION_PATTERNS,
    "xss": XSS_PATTERNS,
    "dangerous": DANGEROUS_PATTERNS,
}

JSON_MAX_BYTES = 1024 * 1024
JSON_MAX_DEPTH = 10


def scan(df: DataFrame, text_col: str, kind: str, keep: list[str] | None = None) -> DataFrame:
    """Per-row scan: ``hit`` (any pattern) and ``n_patterns`` (how many patterns occur).

    A pattern's regex runs only on texts that hold its required literals
    (``CASE WHEN`` evaluates lazily), so clean text is searched for plain
    strings, not matched.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    # positions as names: added columns can't clash
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    flags = _pattern_flags(rows.withColumn("folded", folded("text")), kind)
    n = sum((F.col(f"p{i}").cast("int") for i in range(len(PATTERN_SETS[kind]))), F.lit(0))
    counted = flags.withColumn("n", n)
    return counted.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], (F.col("n") > 0).alias("hit"), F.col("n").alias("n_patterns"))


def folded(text) -> Column:
    """Lower case, with the four other letters that case-fold onto i, s and k made these."""
    text = F.col(text) if isinstance(text, str) else text
    for letter, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def _pattern_flags(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` (text, folded) with a flag ``p<i>`` for each pattern that the text holds (False for NULL)."""
    flags = {}
    for i, pattern in enumerate(PATTERN_SETS[kind]):
        gate = F.lit(True)
        for group in required_literals(pattern):
            holds = [F.contains(F.col("folded"), F.lit(literal)) for literal in group]
            gate = gate & reduce(Column.__or__, holds)
        flags[f"p{i}"] = F.when(gate, F.coalesce(F.col("text").rlike(to_java(pattern)), F.lit(False))).otherwise(F.lit(False))
    return rows.withColumns(flags)


def pattern_counts(df: DataFrame, text_col: str, kind: str) -> DataFrame:
    """Rows matching each pattern: ``(pattern_id, pattern, n_rows)`` from one aggregation."""
    pats = PATTERN_SETS[kind]
    rows = df.select(F.col(text_col).alias("text")).withColumn("folded", folded("text"))
    row = _pattern_flags(rows, kind).agg(*[F.count_if(F.col(f"p{i}")).alias(f"p{i}") for i in range(len(pats))])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pattern_id"), F.lit(p).alias("pattern"), F.col(f"p{i}").alias("n_rows"))
        for i, p in enumerate(pats)
    ])))


def violation_counts(df: DataFrame, code_col: str = "violation") -> DataFrame:
    """``(violation, n_rows)`` over a frame with a violation-code column (NULL = passes)."""
    return df.groupBy(F.coalesce(F.col(code_col), F.lit("ok")).alias("violation")).agg(
        F.count(F.lit(1)).alias("n_rows"))


def check_json(df: DataFrame, json_col: str, keep: list[str] | None = None,
               max_bytes: int = JSON_MAX_BYTES, max_depth: int = JSON_MAX_DEPTH) -> DataFrame:
    """Size, parse, depth and content check of a JSON text column.

    A document passes when it is at most ``max_bytes`` UTF-8 bytes, parses,
    has no node deeper than ``max_depth`` (root = 0) and no object key or
    string value flagged by the SQL-injection or XSS scans. Output columns:
    ``too_large, invalid_json, too_deep, bad_key, bad_value, valid, reason``.
    ``reason`` is the first failing rule in that order. Objects with a
    repeated key keep the last value when ``spark.sql.variant.allowDuplicateKeys``
    is on (part of the job settings, as in Python); otherwise they count as
    invalid JSON.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != json_col]
    base = df.select(*keep, F.col(json_col).alias("_j"))
    base = base.withColumn("_too_large", F.coalesce(F.octet_length("_j") > F.lit(max_bytes), F.lit(False)))
    base = base.withColumn("_v", F.when(~F.col("_too_large"), F.try_parse_json("_j")))
    node = "struct<key:string,node:variant>"
    none = F.array().cast(f"array<{node}>")

    def bad(c):
        return F.coalesce(checks.is_sql_injection(c) | checks.is_xss(c), F.lit(False))

    def children(n):
        members = F.map_entries(n["node"].try_cast("map<string,variant>"))
        of_object = F.transform(members, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("node")))
        of_array = F.transform(n["node"].try_cast("array<variant>"),
                               lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("node")))
        return F.concat(F.coalesce(of_object, none), F.coalesce(of_array, none))

    def bad_text(n):
        is_text = F.schema_of_variant(n["node"]) == F.lit("STRING")
        return F.when(is_text, bad(F.try_variant_get(n["node"], "$", "string"))).otherwise(F.lit(False))

    # level d: the row's nodes at depth d with the key they sit under, as one array;
    # every level is its own projection, so each is computed once
    root = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("_v").alias("node")))
    out = base.withColumn("_l0", F.when(F.col("_v").isNull(), none).otherwise(root))
    levels = ["_l0"]
    for depth in range(1, max_depth + 2):
        out = out.withColumn(f"_l{depth}", F.flatten(F.transform(F.col(levels[-1]), children)))
        levels.append(f"_l{depth}")
    bkey = bval = F.lit(False)
    for level in levels:
        bkey = bkey | F.exists(level, lambda n: bad(n["key"]))
        bval = bval | F.exists(level, bad_text)
    out = out.select(*keep, "_too_large", (~F.col("_too_large") & F.col("_j").isNotNull() & F.col("_v").isNull()).alias("_invalid"),
                     (F.size(levels[-1]) > 0).alias("_deep"), bkey.alias("_bkey"), bval.alias("_bval"))
    names = {"too_large": "_too_large", "invalid_json": "_invalid", "too_deep": "_deep", "bad_key": "_bkey", "bad_value": "_bval"}
    reason = F.lit(None).cast("string")
    for name, flag in reversed(names.items()):
        reason = F.when(F.col(flag), F.lit(name)).otherwise(reason)
    return out.select(*keep, *[F.col(flag).alias(name) for name, flag in names.items()], reason.isNull().alias("valid"),
                      reason.alias("reason"))
