"""Runs of repeating words, found on a grammar of the word sequence (operator 13).

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)`` long,
that no neighbouring word extends. Texts are handled in slices of bounded size:

1. Only words inside a repeated five-gram of their text are looked at. A run of
   period 1 has five equal words at two places, and in one of period q >= 2 each
   of at least 4 q - 4 five-grams comes back q words later or earlier, so every
   run lies inside one stretch of such words; the stretches of a slice are one
   sequence of word ids, with separators of their own between them.
2. Re-Pair: rounds that replace every pair of symbols that wins over the pairs
   overlapping it (more occurrences first, then by number; of a repeated symbol
   every other place) by a nonterminal, while a pair is replaced at least twice.
   What is left of each stretch is paired up level by level to one symbol.
3. A nonterminal X = Y Z gets the runs within X that cross from Y to Z, once, at
   its first place. Such a run has two periods on one side of the boundary, so
   its period is the distance to the next (or last) place of a power-of-two
   block at the boundary; of three or more places at equal distances p, only
   the two at which the p-periodic stretch can break alike are tried. Blocks are
   named by prefix doubling, which makes every comparison exact.
4. The derivation is unfolded from the top and each nonterminal's runs are put
   at all its places; intervals of one period that overlap by a period are one.
   A run crosses the boundary of the lowest nonterminal that holds it whole, so
   each is found in full; stretches cut off by a nonterminal's end merge into it.

No shuffle is needed; a task holds one slice (2 MB of text, or one longer text),
about 200 bytes a word of the stretches. Defined results: a null or empty text
has no words and no runs; the key, null or not, only labels the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import text as tx

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_GRAM = LEAST_WORDS - 1


class Blocks:
    """Names of all blocks of 1, 2, 4, ... symbols of a sequence: equal names, equal blocks (none past the end)."""

    def __init__(self, symbols: np.ndarray, longest: int):
        n = len(symbols)
        self.n = n
        _, first = np.unique(symbols, return_inverse=True)
        self.names = [first.astype(np.int64)]
        size = 1
        while 2 * size <= min(longest, n):
            last = self.names[-1]
            pair = last[: n - 2 * size + 1] * (n + 1) + last[size : n - size + 1]
            _, name = np.unique(pair, return_inverse=True)
            self.names.append(name.astype(np.int64))
            size *= 2

    def forward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal symbols from i and j on, up to ``limit`` (which must keep both inside)."""
        i, j, left = i.copy(), j.copy(), limit.copy()
        for k in range(len(self.names) - 1, -1, -1):
            size = 1 << k
            while True:
                fits = np.flatnonzero(left >= size)
                same = fits[self.names[k][i[fits]] == self.names[k][j[fits]]]
                if not len(same):
                    break
                i[same] += size
                j[same] += size
                left[same] -= size
                if k < len(self.names) - 1:
                    break
        return limit - left

    def backward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal symbols that end just before i and j, up to ``limit``."""
        i, j, left = i.copy(), j.copy(), limit.copy()
        for k in range(len(self.names) - 1, -1, -1):
            size = 1 << k
            while True:
                fits = np.flatnonzero(left >= size)
                same = fits[self.names[k][i[fits] - size] == self.names[k][j[fits] - size]]
                if not len(same):
                    break
                i[same] -= size
                j[same] -= size
                left[same] -= size
                if k < len(self.names) - 1:
                    break
        return limit - left


@dataclass
class Grammar:
    """Rules by nonterminal number, and the top: one symbol a stretch with its place."""

    #: Symbols below ``words`` are words; nonterminal ``words + r`` derives ``left[r] right[r]``.
    words: int
    left: np.ndarray
    right: np.ndarray
    #: Words that each symbol derives, and the first place of each nonterminal in the sequence.
    size: np.ndarray
    place: np.ndarray
    top: np.ndarray
    top_place: np.ndarray
    #: Where each round's rules begin; they use words and rules of earlier rounds.
    rounds: list[int]


def _chosen(pair: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Places whose pair is replaced this round; no two of them overlap, and each pair has two at least."""
    names, of, counts = np.unique(pair[valid], return_inverse=True, return_counts=True)
    rank = np.full(len(pair), -1, np.int64)
    strength = np.argsort(np.lexsort((-names, counts)))
    rank[valid] = np.where(counts[of] > 1, strength[of], -1)
    # places of one repeated symbol form chains of equal rank: every other one, from the start
    at = np.arange(len(pair))
    chain = np.r_[False, rank[1:] == rank[:-1]]
    start = np.maximum.accumulate(np.where(chain, 0, at))
    even = (at - start) % 2 == 0
    before, after = np.r_[-1, rank[:-1]], np.r_[rank[1:], -1]
    wins = (rank >= 0) & even & ((before < rank) | chain) & (after <= rank)
    # the last of a chain may lose to what follows it, the first to what precedes it; both only shorten it
    taken = np.flatnonzero(wins)
    _, of, counts = np.unique(pair[taken], return_inverse=True, return_counts=True)
    return taken[counts[of] > 1]


def repair(symbols: np.ndarray, stretch: np.ndarray) -> Grammar:
    """The grammar of a sequence whose stretches (numbered in order) are apart."""
    words = int(symbols.max(initial=-1)) + 1
    size, place = [np.ones(words, np.int64)], []
    left, right, rounds = [], [], []
    sequence, at, of = symbols.astype(np.int64), np.arange(len(symbols)), stretch
    total = words
    repeated = True
    while len(sequence) > 1:
        together = of[1:] == of[:-1]
        if not together.any():
            break
        pair = sequence[:-1] * (total + 1) + sequence[1:]
        if repeated:
            taken = _chosen(pair, together)
            if not len(taken):
                repeated = False
                continue
        else:
            # no pair repeats any more: pair up what is left of each stretch
            number = np.arange(len(sequence))
            first = np.maximum.accumulate(np.where(np.r_[True, ~together], number, 0))
            taken = np.flatnonzero(together & ((number - first)[:-1] % 2 == 0))
        _, first, name = np.unique(pair[taken], return_index=True, return_inverse=True)
        sizes = np.concatenate(size)
        size = [sizes]
        one, two = sequence[taken[first]], sequence[taken[first] + 1]
        left.append(one)
        right.append(two)
        place.append(at[taken[first]])
        rounds.append(total - words)
        size.append(sizes[one] + sizes[two])
        sequence = sequence.copy()
        sequence[taken] = total + name
        keep = np.ones(len(sequence), bool)
        keep[taken + 1] = False
        sequence, at, of = sequence[keep], at[keep], of[keep]
        total += len(first)
    none = [np.zeros(0, np.int64)]
    return Grammar(words, np.concatenate(left or none), np.concatenate(right or none), np.concatenate(size), np.concatenate(place or none), sequence, at, rounds)


def _candidates(blocks: Blocks, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, period) of squares that may start at ``at`` and end by ``high``, or (``low``) end at ``at`` and start from ``low``.

    ``high`` where the square is to the right, ``low`` where it is to the left: the other is -1.
    """
    numbers, periods = [], []
    right = bool((high >= 0).all()) if len(high) else True
    room = (high - at) if right else (at - low)
    for k, names in enumerate(blocks.names):
        size = 1 << k
        live = np.flatnonzero(room >= 2 * size)
        if not len(live):
            break
        n = len(names)
        order = np.argsort(names, kind="stable")
        keyed = names[order] * (blocks.n + 1) + order
        if right:
            mine = at[live]
            name = names[mine] * (blocks.n + 1)
            lo = np.searchsorted(keyed, name + mine + size)
            most = np.minimum(2 * size - 1, room[live] // 2)
            hi = np.searchsorted(keyed, name + mine + most, "right")
            found = hi > lo
            live, mine, lo, hi = live[found], mine[found], lo[found], hi[found]
            if not len(live):
                continue
            q1, q2 = order[lo] - mine, order[np.minimum(lo + 1, n - 1)] - mine
        else:
            mine = at[live] - size
            name = names[mine] * (blocks.n + 1)
            most = np.minimum(2 * size - 1, room[live] // 2)
            lo = np.searchsorted(keyed, name + mine - most)
            hi = np.searchsorted(keyed, name + mine - size, "right")
            found = hi > lo
            live, mine, lo, hi = live[found], mine[found], lo[found], hi[found]
            if not len(live):
                continue
            q1, q2 = mine - order[hi - 1], mine - order[np.maximum(hi - 2, 0)]
        count = hi - lo
        numbers.append(live)
        periods.append(q1)
        two = count == 2
        numbers.append(live[two])
        periods.append(q2[two])
        many = np.flatnonzero(count > 2)
        if len(many):
            who, a, first, p, c = live[many], at[live[many]], q1[many], (q2 - q1)[many], count[many]
            if right:
                end = high[who]
                e1 = p + blocks.forward(a, a + p, end - a - p)
                e2 = p + blocks.forward(a + first, a + first + p, end - a - first - p)
            else:
                end = low[who]
                e1 = p + blocks.backward(a, a - p, a - p - end)
                e2 = p + blocks.backward(a - first, a - first - p, a - first - p - end)
            for aim in (e2 - e1, e1 - first):
                step = aim // p
                fine = (aim % p == 0) & (step >= 0) & (step < c)
                numbers.append(who[fine])
                periods.append((first + step * p)[fine])
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(numbers), np.concatenate(periods)]), axis=1)
    return both[0], both[1]


def _smallest_factor(limit: int) -> np.ndarray:
    factor = np.zeros(limit + 1, np.int64)
    for p in range(2, int(limit**0.5) + 1):
        if not factor[p]:
            view = factor[p * p :: p]
            view[view == 0] = p
    own = factor == 0
    factor[own] = np.arange(limit + 1)[own]
    return factor


def crossing(grammar: Grammar, blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nonterminal, start in it, length, period) of the runs that cross the boundary inside each nonterminal."""
    rules = np.flatnonzero(grammar.size[grammar.words :] >= LEAST_WORDS)
    begin = grammar.place[rules]
    middle = begin + grammar.size[grammar.left[rules]]
    end = begin + grammar.size[grammar.words + rules]
    none = np.full(len(rules), -1, np.int64)
    rule_r, period_r = _candidates(blocks, middle, none, end)
    rule_l, period_l = _candidates(blocks, middle, begin, none)
    # each stretch around the boundary, from the side that holds its square
    m, a, b, q = middle[rule_r], begin[rule_r], end[rule_r], period_r
    start_r = m - blocks.backward(m, m + q, m - a)
    stop_r = m + q + blocks.forward(m, m + q, b - m - q)
    m, a, b, q = middle[rule_l], begin[rule_l], end[rule_l], period_l
    start_l = m - q - blocks.backward(m - q, m, m - q - a)
    stop_l = m + blocks.forward(m - q, m, b - m)
    found = [(rule_r, rule_l), (start_r, start_l), (stop_r, stop_l), (period_r, period_l)]
    rule, start, stop, q = np.unique(np.stack([np.concatenate(both) for both in found]), axis=1)
    m = middle[rule]
    length = stop - start
    real = np.flatnonzero((length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)) & (start < m) & (stop > m))
    rule, q, start, length = rule[real], q[real], start[real], length[real]
    # drop those whose smallest period is a divisor of q
    if len(q):
        factor = _smallest_factor(int(q.max()))
        rest, primitive = q.copy(), np.ones(len(q), bool)
        while (rest > 1).any():
            live = np.flatnonzero(rest > 1)
            prime = factor[rest[live]]
            part = q[live] // prime
            need = length[live] - part
            primitive[live] &= blocks.forward(start[live], start[live] + part, need) < need
            rest[live] //= prime
        rule, q, start, length = rule[primitive], q[primitive], start[primitive], length[primitive]
    return rules[rule], start - begin[rule], length, q


def unfolded(grammar: Grammar, rule: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the rules' runs at all places of the derivation, each nonterminal unfolded from the top."""
    n_rules = len(grammar.left)
    order = np.argsort(rule, kind="stable")
    start, length, period = start[order], length[order], period[order]
    count = np.bincount(rule, minlength=n_rules)
    first = np.concatenate([[0], np.cumsum(count)])[:-1] if n_rules else np.zeros(0, np.int64)
    symbol, place = grammar.top, grammar.top_place
    # subtrees without any run need no unfolding
    useful = np.zeros(len(grammar.size), bool)
    useful[grammar.words :] = count > 0
    for a, b in zip(grammar.rounds, [*grammar.rounds[1:], n_rules], strict=False):
        useful[grammar.words + a : grammar.words + b] |= useful[grammar.left[a:b]] | useful[grammar.right[a:b]]
    starts, ends, periods = [], [], []
    while len(symbol):
        live = (symbol >= grammar.words) & useful[symbol]
        of, place = symbol[live] - grammar.words, place[live]
        rows = tx.spread(first[of], count[of])
        base = np.repeat(place, count[of])
        starts.append(base + start[rows])
        ends.append(base + start[rows] + length[rows])
        periods.append(period[rows])
        one = grammar.left[of]
        symbol, place = np.concatenate([one, grammar.right[of]]), np.concatenate([place, place + grammar.size[one]])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(ends or none), np.concatenate(periods or none)


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that overlap by a period or more as one, by start and period."""
    if not len(start):
        return start, end, period
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    _, group = np.unique(period, return_inverse=True)
    far = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + far)
    fresh = np.r_[True, (start[1:] + far[1:] > reach[:-1] - period[1:])]
    heads = np.flatnonzero(fresh)
    start, end, period = start[heads], np.maximum.reduceat(end, heads), period[heads]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of a sequence of word ids; none crosses from one ``text`` to the next."""
    none = np.zeros(0, np.int64)
    n = len(words)
    if n < LEAST_WORDS:
        return none, none, none
    grams = np.zeros(n - _GRAM + 1, np.int64)
    for d in range(_GRAM):
        _, grams = np.unique(grams * (int(words.max()) + 1) + words[d : n - _GRAM + 1 + d], return_inverse=True)
    inside = text[: n - _GRAM + 1] == text[_GRAM - 1 :]
    _, of, counts = np.unique(grams * (int(text.max()) + 1) + text[: len(grams)], return_inverse=True, return_counts=True)
    again = inside & (counts[of] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + _GRAM, -1)
    looked = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    if not len(looked):
        return none, none, none
    apart = np.r_[True, (np.diff(looked) > 1) | (np.diff(text[looked]) != 0)]
    stretch = np.cumsum(apart) - 1
    # a separator before each stretch, so that no block name spans two
    spot = np.arange(len(looked)) + stretch + 1
    _, ids = np.unique(words[looked], return_inverse=True)
    sequence = int(ids.max()) + 1 + np.arange(len(looked) + stretch[-1] + 1)
    sequence[spot] = ids
    grammar = repair(ids, stretch)
    grammar.place, grammar.top_place = spot[grammar.place], spot[grammar.top_place]
    blocks = Blocks(sequence, int(np.bincount(stretch).max()))
    start, end, period = merged(*unfolded(grammar, *crossing(grammar, blocks)))
    back = np.full(len(sequence) + 1, -1, np.int64)
    back[spot] = looked
    return back[start], end - start, period


def rewritten(n: int, h: int) -> np.ndarray:
    """Which original word stands at each place of a text of n words with hash h (see the query's contract)."""
    at = np.arange(n)
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


FOUND = tx.struct_of(
    ("n_runs", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("period", T.LongType()), ("exponent_milli", T.LongType()),
    ("runs", T.StringType()), ("collapsed", T.StringType()),
)


def _slice(batch: pa.RecordBatch, digest: bool) -> list[pa.Array]:
    data, offsets = tx.utf8(batch.column(batch.schema.get_field_index("text")))
    hashes = batch.column(batch.schema.get_field_index("h")).to_pylist()
    rows = batch.num_rows
    starts, ends = tx.runs(data, offsets, tx.VISIBLE_BYTES)
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    order = np.arange(len(starts))
    for row in range(rows):
        if hashes[row] is not None and hashes[row] % 10 == 0 and counts[row]:
            order[first[row] : first[row + 1]] = first[row] + rewritten(int(counts[row]), hashes[row])
    starts, ends = starts[order], ends[order]
    words = tx.word_ids(data, starts, ends)
    text = np.repeat(np.arange(rows), counts)
    begin, length, period = find_runs(words, text)
    owner = text[begin] if len(begin) else begin
    at = begin - first[owner]
    # a word is dropped if a run holds it after its first period
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, begin + period, 1)
    np.add.at(dropped, begin + length, -1)
    kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
    sizes = ends[kept] - starts[kept] + 1
    joined = data[np.minimum(tx.spread(starts[kept], sizes), max(len(data) - 1, 0))] if len(kept) else data[:0].copy()
    cut = np.cumsum(sizes)
    joined[cut - 1] = 32
    cut = np.concatenate([[0], cut])[np.searchsorted(kept, first)]
    best: list[tuple | None] = [None] * rows
    listed: list[list[str]] = [[] for _ in range(rows)]
    for row, s, size, q in zip(owner.tolist(), at.tolist(), length.tolist(), period.tolist(), strict=True):
        listed[row].append(f"{s},{size},{q}\n")
        if best[row] is None or (-size, s, q) < best[row]:
            best[row] = (-size, s, q)
    body = joined.tobytes()
    collapsed = [body[cut[r] : max(cut[r], cut[r + 1] - 1)] for r in range(rows)]
    runs = ["".join(lines).encode() for lines in listed]
    if digest:
        runs, collapsed = ([hashlib.sha256(x).hexdigest() for x in of] for of in (runs, collapsed))
    else:
        runs, collapsed = ([x.decode() for x in of] for of in (runs, collapsed))
    columns = [
        [len(lines) for lines in listed],
        [b and b[1] for b in best],
        [b and -b[0] for b in best],
        [b and b[2] for b in best],
        [b and 1000 * -b[0] // b[2] for b in best],
    ]
    return [*(pa.array(c, pa.int64()) for c in columns), pa.array(runs, pa.string()), pa.array(collapsed, pa.string())]


def collapse_runs(docs: DataFrame, text: str = "text", rewrite: Column | None = None, digest: bool = False) -> DataFrame:
    """The rows of ``docs`` (struct ``doc``) with their runs and their text without the repeats.

    ``n_runs``; ``start``, ``length``, ``period`` and ``exponent_milli`` of the longest run (ties: smallest start,
    then period; null without a run); ``runs``, a line ``start,length,period`` for each by start and period; and
    ``collapsed``, the words that no run holds after its first period, joined by spaces. With ``digest``, the last
    two are SHA-256 in hex. ``rewrite`` is a hash by which texts are rewritten to periodic ones first (``rewritten``).
    """
    h = rewrite if rewrite is not None else F.lit(None)
    position = "h__"
    while position in [c.lower() for c in docs.columns]:
        position += "_"
    hashed = docs.withColumn(position, h.cast("bigint"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            yield _slice(batch, digest)

    return tx.annotate(hashed, {"text": (text, "string"), "h": (position, "bigint")}, task, FOUND)
