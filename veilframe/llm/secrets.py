"""Secret scan: fixed patterns and a randomness test battery with false-discovery control (operator 1).

Three kinds come from fixed patterns: ``assign`` (a password-like name and its
value), ``access`` (access key ids) and ``hex`` (long hexadecimal runs). The
battery adds ``random``: runs of 20 or more token characters with letters and
digits, whose encoding is inferred as the smallest of hexadecimal, base 32, 36,
62 and 64 that has all their characters. Under "the symbols are uniform and
independent" the chi-squared test over the alphabet, the runs test about its
middle and the lag-1 serial correlation each give a two-sided p-value; Fisher's
method combines them. Random tokens have uniform p, structured ones p near 0.

Which p counts as random is decided per encoding and length class from the
histogram of p over the corpus's distinct tokens: the random tokens are estimated from the
flat upper half (Storey's estimator), and the smallest threshold is taken at
which the estimated share of structured tokens among those above it is at most
``fdr``. Short tokens, on which the tests have little power, so get a higher
threshold or none.

Nothing but that histogram (bounded: encodings x length classes x bins) and the tokens'
digests leave the tasks. Null and empty texts have no spans. Spans are code points, end
exclusive; a ``random`` span that overlaps a fixed one is left out. Repeated
rows count each, extra columns are carried as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import text as tx

# Fixed values of the base patterns.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32
BASE_KINDS = ("assign", "access", "hex")

TOKEN_MIN = 20
FDR = 0.05
BINS = 100

_HEX = tx.byte_class(b"0123456789abcdef")
_DIGIT = tx.byte_class(b"0123456789")
_LETTER = tx.byte_class([*range(65, 91), *range(97, 123)])
_TOKEN = _DIGIT | _LETTER | tx.byte_class(b"+/_-")


def _alphabet(symbols: bytes, also: bytes = b"") -> np.ndarray:
    """Value of each byte, -1 outside; ``also`` stands for the last symbols (base 64's two forms)."""
    table = np.full(256, -1, np.int64)
    table[list(symbols)] = range(len(symbols))
    if also:
        table[list(also)] = range(len(symbols) - len(also), len(symbols))
    return table


_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
#: Name, size and symbol values, smallest first.
ENCODINGS = [
    ("hex", 16, _alphabet(_DIGITS + b"abcdef")),
    ("hex_upper", 16, _alphabet(_DIGITS + b"ABCDEF")),
    ("base32", 32, _alphabet(_UPPER + b"234567")),
    ("base36", 36, _alphabet(_DIGITS + _LOWER)),
    ("base36_upper", 36, _alphabet(_DIGITS + _UPPER)),
    ("base62", 62, _alphabet(_UPPER + _LOWER + _DIGITS)),
    ("base64", 64, _alphabet(_UPPER + _LOWER + _DIGITS + b"+/")),
    ("base64_url", 64, _alphabet(_UPPER + _LOWER + _DIGITS + b"-_")),
    ("base64_mixed", 66, _alphabet(_UPPER + _LOWER + _DIGITS + b"+/-_")),
]

_SPAN = tx.struct_of(("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()))
RESULT = tx.struct_of(("spans", T.ArrayType(_SPAN, False)))
_ARROW_SPANS = pa.list_(pa.field("element", pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]), nullable=False))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_p(values: np.ndarray, size: int) -> float:
    """Two-sided p of the uniformity statistic, by the Wilson-Hilferty approximation."""
    n, df = len(values), size - 1
    statistic = size / n * float((np.bincount(values, minlength=size) ** 2).sum()) - n
    z = ((statistic / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return _two_sided(z)


def runs_p(values: np.ndarray, size: int) -> float:
    """Two-sided p of the number of runs of symbols below and from the alphabet's middle."""
    high = values >= size / 2
    n, up = len(values), int(high.sum())
    if up in (0, n):
        return 2.0 ** (1 - n) if n < 1000 else 0.0
    mean = 2 * up * (n - up) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    count = 1 + int((high[1:] != high[:-1]).sum())
    return _two_sided((count - mean) / math.sqrt(spread)) if spread > 0 else 1.0


def serial_p(values: np.ndarray) -> float:
    """Two-sided p of the lag-1 correlation."""
    x = values - values.mean()
    total = float((x * x).sum())
    if total == 0:
        return 0.0
    return _two_sided(float((x[1:] * x[:-1]).sum()) / total * math.sqrt(len(values)))


def battery_p(values: np.ndarray, size: int) -> float:
    """Fisher's combination of the three tests (6 degrees of freedom)."""
    half = -sum(math.log(max(p, 1e-300)) for p in (chi_squared_p(values, size), runs_p(values, size), serial_p(values)))
    return math.exp(-half) * (1 + half + half * half / 2)


def infer_encoding(token: np.ndarray) -> tuple[int, np.ndarray]:
    """Index of the smallest encoding that has all bytes of the token, and its symbol values."""
    for i, (_, _, table) in enumerate(ENCODINGS):
        values = table[token]
        if values.min() >= 0:
            return i, values
    raise ValueError("not a token")


def length_class(n: int) -> int:
    """Two classes per doubling of the length."""
    return int(2 * math.log2(n))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """Start, end, encoding, length class and p of each token with letters and digits."""
    starts, ends = tx.runs(data, offsets, _TOKEN)
    keep = ends - starts >= TOKEN_MIN
    starts, ends = starts[keep], ends[keep]
    for table in (_DIGIT, _LETTER):
        count = np.concatenate([[0], np.cumsum(table[data])])
        keep = count[ends] > count[starts]
        starts, ends = starts[keep], ends[keep]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        encoding, values = infer_encoding(data[a:b])
        yield a, b, encoding, length_class(b - a), battery_p(values, ENCODINGS[encoding][1])


def token_histogram(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct tokens of all documents by encoding, length class and bin of p."""
    schema = tx.struct_of(("encoding", T.IntegerType()), ("size", T.IntegerType()), ("bin", T.IntegerType()), ("token", T.BinaryType()))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text"):
            data, offsets = tx.utf8(batch.column("text"))
            rows = {hashlib.md5(data[a:b].tobytes()).digest(): (e, size, min(int(p * BINS), BINS - 1)) for a, b, e, size, p in _tokens(data, offsets)}
            columns = list(zip(*rows.values(), strict=True)) if rows else [[]] * 3
            arrays = [*(pa.array(c, pa.int32()) for c in columns), pa.array(list(rows), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    narrow = docs.select(F.col(text).cast("string").alias("text"))
    tokens = narrow.mapInArrow(collect, schema).distinct()
    return tokens.groupBy("encoding", "size", "bin").agg(F.count("*").alias("n"))


def thresholds(histogram: list[tuple[int, int, int, int]], fdr: float = FDR) -> dict[tuple[int, int], float]:
    """Per encoding and length class, the least p that counts as random; classes without one are absent."""
    strata: dict[tuple[int, int], np.ndarray] = {}
    for encoding, size, at, n in histogram:
        strata.setdefault((encoding, size), np.zeros(BINS))[at] += n
    out = {}
    for key, counts in strata.items():
        random = 2 * counts[BINS // 2 :].sum()
        for at in range(1, BINS):
            above = counts[at:].sum()
            if above and 1 - random * (1 - at / BINS) / above <= fdr:
                out[key] = at / BINS
                break
    return out


def _base(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row, start byte, kind number and end byte of the fixed patterns' spans."""
    raw = data.tobytes()
    low = raw.lower()
    for kind, words, source, pattern, group, least in ((0, KEYWORDS, low, ASSIGN, 2, ASSIGN_MIN), (1, (b"AKIA",), raw, ACCESS, 0, ACCESS_MIN)):
        places = sorted({at for word in words for at in _finds(source, word)})
        over = 0
        for at, row in zip(places, tx.row_of(np.array(places, np.int64), offsets).tolist(), strict=True):
            # a match can only begin at one of the words, and never inside the match before
            if at >= over and (m := pattern.match(raw, at, int(offsets[row + 1]))):
                over = m.end()
                if len(m[group]) >= least:
                    yield row, at, kind, over
    starts, ends = tx.runs(data, offsets, _HEX)
    keep = ends - starts >= HEX_MIN
    for row, a, b in zip(tx.row_of(starts[keep], offsets).tolist(), starts[keep].tolist(), ends[keep].tolist(), strict=True):
        yield row, a, 2, b


def _finds(haystack: bytes, word: bytes) -> Iterator[int]:
    at = haystack.find(word)
    while at >= 0:
        yield at
        at = haystack.find(word, at + 1)


def _task(limits: dict[tuple[int, int], float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            data, offsets = tx.utf8(batch.column("text"))
            found = list(_base(data, offsets))
            taken = sorted((a, b) for _, a, _, b in found)
            begins = np.array([a for a, _ in taken], np.int64)
            reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else begins
            for a, b, encoding, size, p in _tokens(data, offsets):
                if p >= limits.get((encoding, size), 2):
                    before = int(np.searchsorted(begins, b)) - 1
                    if before < 0 or reach[before] <= a:
                        found.append((int(tx.row_of(np.array([a]), offsets)[0]), a, 3, b))
            cp = tx.code_points(data)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, a, kind, b in sorted(found):
                base = cp[offsets[row]]
                spans[row].append({"kind": (*BASE_KINDS, "random")[kind], "start": int(cp[a] - base), "end": int(cp[b] - base)})
            yield [pa.array(spans, _ARROW_SPANS)]

    return run


def scan_secrets(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """``doc`` (the row) and its ``spans``, ordered by start and then kind."""
    limits = thresholds([tuple(r) for r in token_histogram(docs, text).collect()], fdr)
    return tx.annotate(docs, {"text": (text, "string")}, _task(limits), RESULT)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the union of ``spans`` (ordered by start) replaced by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, span: Column) -> Column:
        piece = F.substring(text, acc["at"].cast("int") + 1, (span["start"] - acc["at"]).cast("int"))
        fresh = span["start"] >= acc["at"]
        inside = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], span["end"]).alias("at"))
        return F.when(fresh, F.struct(F.concat(acc["out"], piece, F.lit(mark)).alias("out"), span["end"].alias("at"))).otherwise(inside)

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = None, fdr: float = FDR) -> DataFrame:
    """``docs`` in their own columns with every secret replaced by a mark; ``length`` (a column) follows."""
    found = scan_secrets(docs, text, fdr)
    place = [c.lower() for c in docs.columns].index(text.lower())
    out = tx.original(found, docs, {docs.columns[place]: redact(F.col("doc")[f"c{place}"], F.col("spans"))})
    if length is not None:
        out = out.withColumn(length, F.when(F.col(text).isNotNull(), F.length(text).cast(docs.schema[length].dataType)))
    return out
