"""Personal data: fixed patterns and a linear-chain conditional random field (operator 4).

Four kinds come from fixed patterns: ``email``, ``ip``, ``card`` (checked by
Luhn) and ``phone`` (international form). The random field adds spans of the
same kinds that the patterns miss, such as national phone numbers. Its tokens
are runs between ASCII white space without closing punctuation; its features are
word shapes, counts of digits, marks the token holds and the words before it.
Only tokens with a digit or an @ can be inside a span; by this rule the chain
falls apart into runs of such tokens, which are decoded exactly by Viterbi, many
runs at a time. The field is trained in numpy from the small labelled table
below by maximum likelihood (forward and backward sums).

Everything runs inside the tasks on whole texts; nothing is shuffled. Null and
empty texts have no spans. Spans are code points, end exclusive; a span of the
field that overlaps one of the patterns is left out. Repeated rows count each,
extra columns are carried as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilframe.llm import gru
from veilframe.llm import text as tx

KINDS = ("email", "ip", "card", "phone")
# Fixed values of the base patterns. Possessive digits change no match, only the time long runs take.
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

#: The labelled table: [kind:text] marks a span, everything else is outside.
TABLE = """
call me at [phone:(555) 123-4567] after lunch
phone: [phone:555-867-5309] or write to [email:ann.lee@example.org]
tel. [phone:020 7946 0958] ask for the manager
Tel: [phone:0171 234 5678], open from 9 to 17
Telefon [phone:030 901820] oder Mail an [email:info@beispiel.de]
fax [phone:212-555-0187] phone [phone:212-555-0188]
you can reach us on [phone:1-800-555-0199] every day
mobile [phone:07700 900123] please text only
his number is [phone:(415) 555 2671] he said
call [phone:415.555.2671] for details
contact [email:sales@shop.example.com] or [phone:(020) 7946-0011]
téléphone [phone:01 23 45 67 89] le matin
tél. [phone:06 12 34 56 78] merci
appelez le [phone:04 91 55 66 77] pour réserver
teléfono [phone:91 123 45 67] por la tarde
llame al [phone:612 345 678] hoy
phone number [phone:+44 20 7946 0018] in London
dial [phone:+1 415 555 2671] now
card [card:4111 1111 1111 1111] expires 12/27
visa [card:4111-1111-1111-1111] cvv 123
card number: [card:5500005555555559] name on card
credit card [card:3782 822463 10005] was charged 45.90
paid with [card:6011 1111 1111 1117] on 2021-05-06
Karte [card:5105 1051 0510 5100] gültig bis 2026
server [ip:192.168.10.24] is down
from [ip:10.0.0.1] to [ip:10.0.0.254] on port 8080
ip [ip:172.16.254.1] logged in at 10:22:31
host [ip:203.0.113.77] replied in 34 ms
mail [email:bob_smith@mail.example.net] today
email: [email:j.doe+news@example.com] is mine
write to [email:press@example.co.uk] before 2020
user [email:root@example.com] from [ip:198.51.100.7]
chapter 12 page 345 of 1200
the year 1999 and the year 2004
in 1914 1918 and 1939 1945 there were wars
it costs 1,299.00 or 1.299,00 in stores
version 2.0.1 was released on 2020-01-15
released on 12/05/2019 at 10:45
from 1995-2005 the value rose 35.5 percent
order 48213 was sent with invoice 2021-0042
see section 4.2.1 and table 7
isbn 978-3-16-148410-0 second edition
rows 100 200 300 400 500 600
scores 3-2 1-0 2-2 in the final
10 20 30 40 50 60 70 80 90
the 3 of 12 members voted 7 to 5
follow @someone and @another on the site
ratio 16:9 resolution 1920x1080 at 60hz
born 05.11.1987 in room 401
article 25 paragraph 3 no. 17
serial a1b2c3d4 build 20210412 rev 7
population 1 234 567 in 2011
distance 384 400 km or 238 855 miles
temperature 21.5 to 23.0 degrees
account 12345678 balance 250.00
hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff size 4096
licence version 3 and version 2.0
0.5 0.25 0.125 0.0625
id 1000234 id 1000235 id 1000236
2019 2020 2021 2022 2023
"""

LABELS = ["O", *(f"{part}-{kind}" for kind in KINDS for part in "BI")]
N_LABELS = len(LABELS)
#: Words that may tell what follows; any other word is word 0.
CUES = ("phone", "tel", "telefon", "téléphone", "tél", "teléfono", "call", "fax", "mobile", "dial", "number", "reach", "appelez", "llame", "contact", "card", "visa", "credit", "karte", "paid", "server", "ip", "host", "from", "mail", "email", "write", "user", "isbn", "order", "id", "version", "page", "year", "in", "serial", "account", "hash", "invoice", "population", "distance")
_MARKS = (b"@", b"+", b"(", b")", b"-", b".", b",", b"/", b":", b"_")
N_SHAPES, N_DIGITS = 512, 21
_FEATURES = {"shape": N_SHAPES, "digits": N_DIGITS, "marks": 2 * len(_MARKS), "letters": 2, "cue1": len(CUES) + 1, "cue2": len(CUES) + 1, "before": N_DIGITS, "after": N_DIGITS}
_SIZES = np.array([*_FEATURES.values()])
_BASE = dict(zip(_FEATURES, np.cumsum(_SIZES) - _SIZES, strict=True))
N_FEATURES = int(_SIZES.sum())

_DIGIT = tx.byte_class(b"0123456789")
_LETTER = tx.byte_class([*range(65, 91), *range(97, 123), *range(128, 256)])
_CLOSING = tx.byte_class(b".,:;!?\"'")
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_LETTER] = ord("x")
_SHAPE[_DIGIT] = ord("d")


class Tokens:
    """Tokens of a slice of texts, and the features of the active ones (with a digit or @)."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = tx.utf8(texts)
        data = self.data
        starts, ends = tx.runs(data, self.offsets, tx.VISIBLE_BYTES)
        for _ in range(3):
            closing = (ends - starts > 1) & _CLOSING[data[ends - 1]] if len(starts) else np.zeros(0, bool)
            ends = ends - closing
        self.starts, self.ends = starts, ends
        self.row = tx.row_of(starts, self.offsets)
        digits = _counts(_DIGIT[data], starts, ends)
        self.active = np.flatnonzero((digits > 0) | (_counts(data == ord("@"), starts, ends) > 0))
        self.digits = digits
        self.features = self._features(np.minimum(digits, N_DIGITS - 1))
        at = self.active
        follows = (np.diff(at) == 1) & (np.diff(self.row[at]) == 0) if len(at) else np.zeros(0, bool)
        #: Places in ``active`` where runs begin, and the number of tokens of each.
        self.run = np.flatnonzero(np.concatenate([[True], ~follows])) if len(at) else at
        self.length = np.diff(np.concatenate([self.run, [len(at)]]))

    def _features(self, digits: np.ndarray) -> np.ndarray:
        data, at = self.data, self.active
        starts, ends = self.starts[at], self.ends[at]
        # the shape: letters collapse to one x, digits stay one by one
        place = tx.spread(starts, ends - starts)
        shape = _SHAPE[data[place]]
        owner = np.repeat(np.arange(len(at)), ends - starts)
        keep = np.ones(len(shape), bool)
        keep[1:] = (shape[1:] != shape[:-1]) | (shape[1:] == ord("d")) | (owner[1:] != owner[:-1])
        sizes = np.bincount(owner[keep], minlength=len(at))
        shape_ends = np.cumsum(sizes)
        hashes = tx.mix(tx.span_hashes(shape[keep], shape_ends - sizes, shape_ends)) % np.uint64(N_SHAPES)
        columns = [_BASE["shape"] + hashes.astype(np.int64), _BASE["digits"] + digits[at]]
        for k, mark in enumerate(_MARKS):
            columns.append(_BASE["marks"] + 2 * k + (_counts(data == mark[0], starts, ends) > 0))
        columns.append(_BASE["letters"] + (_counts(_LETTER[data], starts, ends) > 0))
        cue = self._cues()
        for name, back in (("cue1", 1), ("cue2", 2)):
            before = at - back
            same = (before >= 0) & (self.row[np.maximum(before, 0)] == self.row[at])
            columns.append(_BASE[name] + np.where(same, cue[np.maximum(before, 0)], 0))
            if back == 1:
                columns.append(_BASE["before"] + np.where(same, digits[np.maximum(before, 0)], 0))
        after = np.minimum(at + 1, len(self.starts) - 1)
        same = (after > at) & (self.row[after] == self.row[at])
        columns.append(_BASE["after"] + np.where(same, digits[after], 0))
        return np.stack(columns, 1) if len(at) else np.zeros((0, len(columns)), np.int64)

    def _cues(self) -> np.ndarray:
        """Number of the cue word that each token before an active one is, else 0."""
        hashes, numbers = _cue_hashes()
        out = np.zeros(len(self.starts), np.int64)
        wanted = np.unique(np.concatenate([self.active - 1, self.active - 2]))
        wanted = wanted[wanted >= 0]
        found = tx.span_hashes(self.data, self.starts[wanted], self.ends[wanted])
        place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        out[wanted] = np.where(hashes[place] == found, numbers[place], 0)
        return out


def _counts(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[ends] - sums[starts]


@cache
def _cue_hashes() -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tx.utf8(pa.array(CUES))
    hashes = tx.span_hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(hashes)
    return hashes[order], order + 1


def _allowed() -> np.ndarray:
    """0 for label pairs that may follow each other, a large negative number otherwise."""
    out = np.zeros((N_LABELS, N_LABELS))
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            out[[i for i in range(N_LABELS) if LABELS[i][2:] != name[2:]], j] = -1e6
    return out


class Field:
    """Weights of features by label and of label pairs; spans begin and end at outside tokens."""

    def __init__(self):
        self.p = {"w": np.zeros((N_FEATURES, N_LABELS)), "t": np.zeros((N_LABELS, N_LABELS))}
        self.allowed = _allowed()

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.p["w"][features].sum(1) if len(features) else np.zeros((0, N_LABELS))

    def viterbi(self, emissions: np.ndarray, run: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best label of every token; all runs advance together, longest first."""
        labels = np.zeros(len(emissions), np.int64)
        if not len(run):
            return labels
        order = np.argsort(-length, kind="stable")
        run, length = run[order], length[order]
        pairs = self.p["t"] + self.allowed
        back = np.zeros((len(emissions), N_LABELS), np.int8)
        score = pairs[0] + emissions[run]
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t, "left"))
            options = score[:live, :, None] + pairs
            best = options.argmax(1)
            back[run[:live] + t] = best
            score[:live] = np.take_along_axis(options, best[:, None, :], 1)[:, 0] + emissions[run[:live] + t]
        state = (score + pairs[:, 0]).argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, "left"))
            labels[run[:live] + t] = state[:live]
            if t:
                state[:live] = back[run[:live] + t, state[:live]]
        return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _table() -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """The labelled table as texts and (start, end, kind) spans in bytes."""
    texts, spans = [], []
    for line in TABLE.strip().splitlines():
        text, found = "", []
        for part in re.split(r"(\[\w+:[^\]]+\])", line):
            if m := re.fullmatch(r"\[(\w+):([^\]]+)\]", part):
                start = len(text.encode())
                text += m[2]
                found.append((start, len(text.encode()), m[1]))
            else:
                text += part
        texts.append(text)
        spans.append(found)
    return texts, spans


def train(steps: int = 150, rate: float = 0.1, l2: float = 0.02) -> Field:
    """Maximum likelihood on the labelled table, with a quadratic penalty."""
    texts, spans = _table()
    tokens = Tokens(pa.array(texts))
    gold = np.zeros(len(tokens.active), np.int64)
    for k, at in enumerate(tokens.active):
        row = int(tokens.row[at])
        begin = int(tokens.starts[at] - tokens.offsets[row])
        for start, end, kind in spans[row]:
            if start <= begin < end:
                gold[k] = LABELS.index(("B-" if begin == start else "I-") + kind)
    field, n = Field(), len(texts)
    adam = gru.Adam(field.p, rate)
    for _ in range(steps):
        emissions = field.emissions(tokens.features)
        pairs = field.p["t"] + field.allowed
        d_e, d_t = np.zeros_like(emissions), l2 * field.p["t"]
        for a, size in zip(tokens.run.tolist(), tokens.length.tolist(), strict=True):
            e, y = emissions[a : a + size], gold[a : a + size]
            alpha, beta = np.empty_like(e), np.empty_like(e)
            alpha[0] = pairs[0] + e[0]
            for t in range(1, size):
                alpha[t] = _log_sum(alpha[t - 1][:, None] + pairs, 0) + e[t]
            beta[-1] = pairs[:, 0]
            for t in range(size - 2, -1, -1):
                beta[t] = _log_sum(pairs + (e[t + 1] + beta[t + 1])[None, :], 1)
            total = _log_sum(alpha[-1] + beta[-1], 0)
            d_e[a : a + size] += np.exp(alpha + beta - total)
            d_e[np.arange(a, a + size), y] -= 1
            for t in range(1, size):
                d_t += np.exp(alpha[t - 1][:, None] + pairs + (e[t] + beta[t])[None, :] - total) / n
                d_t[y[t - 1], y[t]] -= 1 / n
            d_t[0] += (np.exp(alpha[0] + beta[0] - total)) / n
            d_t[0, y[0]] -= 1 / n
            d_t[:, 0] += (np.exp(alpha[-1] + beta[-1] - total)) / n
            d_t[y[-1], 0] -= 1 / n
        d_w = l2 * field.p["w"] / n
        np.add.at(d_w, tokens.features, (d_e / n)[:, None, :])
        adam.step({"w": d_w, "t": d_t})
    return field


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(span: bytes) -> bytes:
    return re.sub(rb"[^0-9]", b"", span)


def _base(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row, start byte, kind number and end byte of the fixed patterns' spans."""
    raw = data.tobytes()
    over = before = -1
    places = np.flatnonzero(data == ord("@"))
    for at, row in zip(places.tolist(), tx.row_of(places, offsets).tolist(), strict=True):
        low = max(over, before + 1, int(offsets[row]))
        before = at
        if low < at:
            start = low + len(raw[low:at].rstrip(LOCAL))
            if start < at and (m := DOMAIN.match(raw, at + 1, int(offsets[row + 1]))):
                over = m.end()
                yield row, start, 0, over
    with_digits = np.unique(tx.row_of(np.flatnonzero(_DIGIT[data]), offsets))
    for row in with_digits.tolist():
        first = int(offsets[row])
        text = raw[first : int(offsets[row + 1])]
        for m in IP.finditer(text) if b"." in text else ():
            parts = [p.lstrip(b"0") for p in m[0].split(b".")]
            if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
                yield row, first + m.start(), 1, first + m.end()
        for m in CARD.finditer(text):
            if 14 <= len(m[0]) <= 19 * 2 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                yield row, first + m.start(), 2, first + m.end()
        for m in PHONE.finditer(text) if b"+" in text else ():
            if 10 <= len(_digits(m[0])) <= 15:
                yield row, first + m.start(), 3, first + m.end()


#: What a span of the field must hold, by kind: a kind of mark and the digits allowed.
def _plausible(kind: int, span: bytes) -> bool:
    n = len(_digits(span))
    if kind == 0:
        return b"@" in span.strip(b"@")
    if kind == 1:
        return span.count(b".") == 3 and n >= 4
    if kind == 2:
        return 14 <= n <= 19 and luhn(_digits(span))
    return 7 <= n <= 15


def _field_spans(tokens: Tokens, labels: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row, start byte, kind and end byte of the label runs that are plausible."""
    inside = np.flatnonzero(labels)
    raw = None
    k = 0
    while k < len(inside):
        first = last = int(inside[k])
        kind = (int(labels[first]) - 1) // 2
        k += 1
        while k < len(inside) and inside[k] == last + 1 and labels[inside[k]] == 2 * kind + 2 and tokens.active[last + 1] == tokens.active[last] + 1:
            last += 1
            k += 1
        raw = tokens.data.tobytes() if raw is None else raw
        a, b = int(tokens.starts[tokens.active[first]]), int(tokens.ends[tokens.active[last]])
        if _plausible(kind, raw[a:b]):
            yield int(tokens.row[tokens.active[first]]), a, kind, b


_SPAN = tx.struct_of(("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()))
RESULT = tx.struct_of(("spans", T.ArrayType(_SPAN, False)))
_ARROW_SPANS = pa.list_(pa.field("element", pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]), nullable=False))


def _task(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            tokens = Tokens(batch.column("text"))
            data, offsets = tokens.data, tokens.offsets
            found = list(_base(data, offsets))
            taken = sorted((a, b) for _, a, _, b in found)
            begins = np.array([a for a, _ in taken], np.int64)
            reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else begins
            labels = field.viterbi(field.emissions(tokens.features), tokens.run, tokens.length)
            for row, a, kind, b in _field_spans(tokens, labels):
                before = int(np.searchsorted(begins, b)) - 1
                if before < 0 or reach[before] <= a:
                    found.append((row, a, len(KINDS) + kind, b))
            cp = tx.code_points(data)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, a, kind, b in sorted(found):
                base = cp[offsets[row]]
                spans[row].append({"kind": (*KINDS, *(f"crf_{k}" for k in KINDS))[kind], "start": int(cp[a] - base), "end": int(cp[b] - base)})
            yield [pa.array(spans, _ARROW_SPANS)]

    return run


def scan_personal(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``doc`` (the row) and its ``spans``, ordered by start and then kind (those of the field as crf_<kind>)."""
    return tx.annotate(docs, {"text": (text, "string")}, _task(field or train()), RESULT)
