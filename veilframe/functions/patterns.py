"""Content-scan patterns (V1 SQL injection, V2 markup/XSS, V3 dangerous content).

The pattern lists are fixed values that must equal the reference's, written in
Python ``re`` syntax in their original order. The reference matches them with
Python's Unicode semantics (``\\w``/``\\b``/``\\s``/``\\d`` are Unicode, ``.``
stops only at ``\\n``, IGNORECASE folds Unicode). ``to_java`` rewrites the four
escapes into explicit Unicode classes and adds the flags that give Java's
matcher the same meaning, independently of the JDK's own ``\\b`` definition.
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------------------
# Fixed values (must match the reference exactly).
# ---------------------------------------------------------------------------
SQL_INJECTION_PATTERNS = [
    r"('\s*(OR|AND)\s*'?\d*'?\s*=\s*'?\d*)",
    r"(--|\#|\/\*|\*\/)",
    r"(\bUNION\b.*\bSELECT\b)",
    r"(\bDROP\b.*\bTABLE\b)",
    r"(\bINSERT\b.*\bINTO\b)",
    r"(\bUPDATE\b.*\bSET\b)",
    r"(\bDELETE\b.*\bFROM\b)",
    r"(\bEXEC\b|\bEXECUTE\b)",
    r"(\bCAST\b|\bCONVERT\b)",
    r"(\bCONCAT\b)",
    r"(xp_|sp_)",
    r"(;.*\b(DROP|CREATE|ALTER|TRUNCATE)\b)",
]

XSS_PATTERNS = [
    r"<script[^>]*>.*?</script>",
    r"on\w+\s*=",
    r"javascript:",
    r"<iframe",
    r"<object",
    r"<embed",
    r"<img[^>]+src[^>]*>",
]

DANGEROUS_PATTERNS = [
    r"[;&|`$]",
    r"\.\.",
    r"<script",
    r"javascript:",
    r"eval\(",
    r"exec\(",
    r"import\s+os",
    r"__import__",
]

USERNAME_PATTERN = r"^[a-zA-Z0-9._-]+$"
IDENTIFIER_PATTERN = r"^[a-zA-Z0-9_-]+$"
# ---------------------------------------------------------------------------

# Characters a match of each list can start with (read off the patterns
# above; İ, ı and ſ are the non-ASCII letters that case-fold onto i and s).
# Used only as a look-ahead in front of the combined pattern, so positions
# that cannot start any match are skipped after one class test.
SQL_INJECTION_FIRST = r"['\-#/*;uUdDiIeEcCxXsSİıſ]"
XSS_FIRST = r"[<oOjJ]"
DANGEROUS_FIRST = r"[;&|`$.<jJeEiI_İı]"

# Python's Unicode character classes spelled out for a Java regex.
WORD_CLASS = r"[\p{L}\p{N}_]"
SPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
DIGIT_CLASS = r"\p{Nd}"


def _is_word_char(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _boundaries(pattern: str) -> str:
    """Replace ``\\b`` by the cheapest look-around with the same meaning here.

    Before a literal word character ``c``: ``c(?<!W.)`` - the look-behind runs
    only after ``c`` matched, so the scan is led by a plain character test.
    Before a group: ``(?<!W)``. After a word character or group: ``(?!W)``.
    Anywhere else: the full two-sided definition.
    """
    w = WORD_CLASS
    out, i, n = [], 0, len(pattern)
    while i < n:
        if pattern.startswith(r"\b", i):
            nxt = pattern[i + 2] if i + 2 < n else ""
            prev = out[-1][-1] if out and out[-1] else ""
            if nxt and _is_word_char(nxt):
                out.append(f"{nxt}(?<!{w}.)")
                i += 3
                continue
            if nxt == "(":
                out.append(f"(?<!{w})")
            elif prev and (_is_word_char(prev) or prev == ")"):
                out.append(f"(?!{w})")
            else:
                out.append(f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))")
            i += 2
            continue
        if pattern[i] == "\\" and i + 1 < n:
            out.append(pattern[i:i + 2])
            i += 2
            continue
        out.append(pattern[i])
        i += 1
    return "".join(out)


def to_java(pattern: str, ignore_case: bool = True) -> str:
    """Rewrite a Python ``re`` pattern for ``rlike`` with the same meaning."""
    out = (
        _boundaries(pattern)
        .replace(r"\w", WORD_CLASS)
        .replace(r"\s", SPACE_CLASS)
        .replace(r"\d", DIGIT_CLASS)
        .replace(r"\#", "#")
    )
    # d: only \n ends a line for '.', as in Python; u: Unicode case folding.
    flags = "(?du" + ("i" if ignore_case else "") + ")"
    return flags + out


def any_of(patterns: list[str], first: str | None = None) -> str:
    """One alternation over all patterns (a single regex pass per value).

    ``first`` is a character class every match starts with; it becomes a
    look-ahead so Java's matcher rejects most positions with one test.
    """
    body = "|".join(f"(?:{p})" for p in patterns)
    return f"(?={first})(?:{body})" if first else body



def required_literals(pattern: str) -> list[tuple[str, ...]]:
    """Lower-case literals that every match of ``pattern`` holds: one of each tuple.

    Read off the parsed pattern: runs of plain characters, one run of each
    alternative, and what is repeated at least once. Anything else demands nothing.
    """
    return _required(re._parser.parse(pattern, re.IGNORECASE))


def _required(items) -> list[tuple[str, ...]]:
    found, run = [], ""
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(value).lower()
            continue
        if name == "AT":  # takes no characters, so the run goes on
            continue
        found, run = [*found, *([(run,)] if run else [])], ""
        if name == "SUBPATTERN":
            found += _required(value[-1])
        elif name == "MAX_REPEAT" and value[0] > 0:
            found += _required(value[2])
        elif name == "IN" and all(str(kind) == "LITERAL" for kind, _ in value):
            found.append(tuple(chr(c).lower() for _, c in value))
        elif name == "BRANCH":
            ways = [_required(way) for way in value[1]]
            if all(ways):
                # the rarest of each: its longest, by the shortest of its alternatives
                best = [max(way, key=lambda group: min(map(len, group))) for way in ways]
                found.append(tuple(literal for group in best for literal in group))
    return [*found, *([(run,)] if run else [])]
