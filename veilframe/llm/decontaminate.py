"""Benchmark decontamination with suffix arrays over the training text (operator 8).

Words are maximal runs of digits, letters and characters from U+0080 up, with
A-Z lower-cased. Each task cuts its documents into shards of a few megabytes,
builds the suffix array of a shard and binary-searches every suffix of every
benchmark item in it. A word outside the benchmark's vocabulary can be part of
no match, so it is written as 0 and suffixes that begin with it need no place in
the array. The search gives, for each test suffix, the range of training
suffixes that begin with its window (10 words; a shorter item is one window)
and its longest verbatim match with the place of it.

Nothing is shuffled: a document's result depends on that document and the
benchmark alone. The benchmark reaches the tasks in blocks of bounded size; if
it is larger than one block, the documents go through one pass per block.

Null and empty texts have no words and are clean. Items with null or wordless
texts have no window; items without an id mark words but are not listed.
Repeated items count once. Columns of the documents may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import text as tx

WINDOW = 10
#: Text bytes of a benchmark block that is sent to the tasks.
BLOCK_BYTES = 8_000_000

RESULT = tx.struct_of(
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("items", T.ArrayType(T.StringType(), False)),
    ("hits", T.ArrayType(tx.struct_of(("start", T.LongType()), ("end", T.LongType())), False)),
    ("spans", T.ArrayType(tx.struct_of(("start", T.LongType()), ("end", T.LongType())), False)),
    ("longest_run", T.LongType()),
)
_RANGES = pa.list_(pa.field("element", pa.struct([("start", pa.int64()), ("end", pa.int64())]), nullable=False))
MATCH = tx.struct_of(
    ("item_id", T.StringType()),
    ("item_word", T.LongType()),
    ("doc_id", T.StringType()),
    ("doc_word", T.LongType()),
    ("length", T.LongType()),
)


def _word_list(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = tx.utf8(texts)
    starts, ends = tx.runs(data, offsets, tx.WORD_BYTES)
    return data, offsets, starts, ends, tx.span_hashes(data, starts, ends)


class TestSuffixes:
    """The words of a benchmark block as ranks of its vocabulary, and its suffixes."""

    def __init__(self, rows: list[tuple[object, str | None]], window: int = WINDOW):
        rows = sorted({(None if i is None else str(i), t or "") for i, t in rows}, key=lambda r: (r[0] is None, r))
        data, offsets, starts, ends, hashes = _word_list(pa.array([t for _, t in rows], pa.string()))
        self.item_ids = [i for i, _ in rows]
        self.vocabulary, first, ranks = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes().lower()
        self.words = [raw[starts[k] : ends[k]] for k in first]
        self.item = tx.row_of(starts, offsets)
        self.word = ranks.astype(np.int64) + 1
        counts = np.bincount(self.item, minlength=len(rows))
        begin = np.concatenate([[0], np.cumsum(counts)])
        index = np.arange(len(starts))
        self.place = index - begin[self.item]
        self.left = begin[self.item + 1] - index
        size = counts[self.item]
        self.window = np.where(size >= window, np.where(self.left >= window, window, 0), np.where(self.place == 0, size, 0))
        self.depth = int(self.left.max(initial=0))

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary rank from 1 of each word, 0 for words of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def suffix_array(words: np.ndarray, n_ranks: int, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``words`` that begin with a rank over 0, in order of their first ``depth`` words.

    A 0 ends a suffix: what follows it can't take part in a match. The order
    comes from sorting several words packed into one integer and then doubling
    the compared length, each time only among suffixes that are still equal.
    """
    begin = np.flatnonzero(words)
    if not len(begin):
        return begin
    bits = max(1, int(n_ranks).bit_length())
    per = min(max(1, 62 // bits), depth)
    padded = np.concatenate([words, np.zeros(per, words.dtype)])
    key = np.zeros(len(begin), np.int64)
    alive = np.ones(len(begin), bool)
    for j in range(per):
        w = padded[begin + j]
        alive &= w > 0
        key = (key << bits) | np.where(alive, w, 0)
    order = np.argsort(key)
    array, key, alive = begin[order], key[order], alive[order]
    rank = np.zeros(len(words) + 1, np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(len(array)), 0))
    rank[array] = group + 1
    length = per
    tied = alive & ~(new & np.concatenate([new[1:], [True]]))
    while length < depth and tied.any():
        at = np.flatnonzero(tied)
        members = array[at]
        after = rank[np.minimum(members + length, len(words))]
        order = np.lexsort((after, group[at]))
        members, after, own = members[order], after[order], group[at]
        array[at] = members
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        group[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank[members] = group[at] + 1
        still = (after > 0) & ~(new & np.concatenate([new[1:], [True]]))
        tied = np.zeros(len(array), bool)
        tied[at] = still
        length *= 2
    return array


def search(words: np.ndarray, array: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of all test suffixes in a shard's suffix array, one word deeper at a time.

    Returns for each test suffix the range of array places whose suffixes begin
    with its window, then the length of its longest match and that range's bounds.
    """
    padded = np.concatenate([words, np.zeros(1, words.dtype)])
    n = len(tests.word)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(array), np.int64)
    win_lo, win_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    length = np.zeros(n, np.int64)
    active = np.arange(n)
    for depth in range(tests.depth):
        active = active[tests.left[active] > depth]
        if not len(active):
            break
        wanted = tests.word[active + depth]
        low = _bound(padded, array, lo[active], hi[active], depth, wanted)
        high = _bound(padded, array, low, hi[active], depth, wanted + 1)
        found = low < high
        active = active[found]
        lo[active], hi[active] = low[found], high[found]
        length[active] = depth + 1
        full = active[tests.window[active] == depth + 1]
        win_lo[full], win_hi[full] = lo[full], hi[full]
    return win_lo, win_hi, length, lo, hi


def _bound(words: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, wanted: np.ndarray) -> np.ndarray:
    """First place in [lo, hi) whose word at ``depth`` is not below ``wanted``."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        below = words[np.minimum(array[mid] + depth, len(words) - 1)] < wanted[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


class Shard:
    """The words of a slice of documents, a 0 after each document, and their suffix array."""

    def __init__(self, texts: pa.Array, tests: TestSuffixes):
        self.data, self.offsets, self.starts, self.ends, hashes = _word_list(texts)
        self.n_rows = len(texts)
        self.row = tx.row_of(self.starts, self.offsets)
        self.n_words = np.bincount(self.row, minlength=self.n_rows)
        self.first_word = np.concatenate([[0], np.cumsum(self.n_words)])
        ranks = tests.ranks(hashes)
        self._check_words(ranks, tests)
        self.words = np.zeros(len(ranks) + self.n_rows, np.int64)
        self.words[np.arange(len(ranks)) + self.row] = ranks
        self.array = suffix_array(self.words, len(tests.vocabulary), tests.depth)

    def _check_words(self, ranks: np.ndarray, tests: TestSuffixes) -> None:
        """Words of equal hash but another length than the vocabulary's are no match."""
        sizes = np.array([-1, *map(len, tests.words)])
        known = np.flatnonzero(ranks)
        ranks[known[sizes[ranks[known]] != (self.ends - self.starts)[known]]] = 0

    def word_index(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and index among all words of places in ``words``."""
        row = np.searchsorted(self.first_word + np.arange(self.n_rows + 1), places, "right") - 1
        return row, places - row

    def windows(self, tests: TestSuffixes, win_lo: np.ndarray, win_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence of a window: a test suffix that has it, and the place in ``words``."""
        some = np.flatnonzero(win_hi > win_lo)
        _, one = np.unique(np.stack([win_lo[some], tests.window[some]], 1), axis=0, return_index=True)
        some = some[one]
        counts = win_hi[some] - win_lo[some]
        return np.repeat(some, counts), self.array[tx.spread(win_lo[some], counts)]


def _annotate_shard(texts: pa.Array, tests: TestSuffixes) -> tuple:
    shard = Shard(texts, tests)
    win_lo, win_hi, _, _, _ = search(shard.words, shard.array, tests)
    suffix, place = shard.windows(tests, win_lo, win_hi)
    hit = np.zeros(len(shard.words) + 1, np.int64)
    np.add.at(hit, place, 1)
    np.add.at(hit, place + tests.window[suffix], -1)
    hit = np.cumsum(hit[:-1]) > 0
    _, hit_word = shard.word_index(np.flatnonzero(hit))
    row = shard.word_index(place)[0]
    # the items of each distinct window, then the distinct (row, item) pairs
    by_window: dict[tuple[int, int], np.ndarray] = {}
    listed = np.flatnonzero(win_hi > win_lo)
    keys = list(zip(win_lo[listed].tolist(), tests.window[listed].tolist(), strict=True))
    for key, item in zip(keys, tests.item[listed].tolist(), strict=True):
        by_window.setdefault(key, []).append(item)
    pairs: set[tuple[int, int]] = set()
    for s, r in set(zip(suffix.tolist(), row.tolist(), strict=True)):
        pairs.update((r, i) for i in by_window[win_lo[s].item(), tests.window[s].item()])
    items: list[list[str]] = [[] for _ in range(shard.n_rows)]
    for r, i in sorted(pairs):
        if tests.item_ids[i] is not None:
            items[r].append(tests.item_ids[i])
    return shard, hit_word, items


def _task(tests: TestSuffixes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            shard, hit_word, items = _annotate_shard(batch.column("text"), tests)
            if "hits" in batch.schema.names:  # what the passes over earlier blocks found
                for r, (hits, found) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    items[r] = [*items[r], *found]
                    at = shard.first_word[r]
                    hit_word = np.concatenate([hit_word, *(np.arange(at + x["start"], at + x["end"]) for x in hits)])
                hit_word = np.unique(hit_word)
            hits, spans = _ranges(shard, hit_word)
            yield [
                pa.array(shard.n_words),
                pa.array(np.bincount(shard.row[hit_word], minlength=shard.n_rows)),
                pa.array([sorted(set(x)) for x in items], pa.list_(pa.field("element", pa.string(), False))),
                pa.array(hits, _RANGES),
                pa.array(spans, _RANGES),
                pa.array([max((x["end"] - x["start"] for x in h), default=0) for h in hits], pa.int64()),
            ]

    return run


def _ranges(shard: Shard, hit_word: np.ndarray) -> tuple[list[list[dict]], list[list[dict]]]:
    """Runs of hit words per row, as word ranges and as code point spans."""
    hits: list[list[dict]] = [[] for _ in range(shard.n_rows)]
    spans: list[list[dict]] = [[] for _ in range(shard.n_rows)]
    if len(hit_word):
        row = shard.row[hit_word]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(hit_word) != 1) | (np.diff(row) != 0)]))
        last = np.concatenate([new[1:], [len(hit_word)]]) - 1
        row, first, last = row[new], hit_word[new], hit_word[last]
        cp = tx.code_points(shard.data)
        base = cp[shard.offsets[row]]
        columns = (row, first - shard.first_word[row], last + 1 - shard.first_word[row], cp[shard.starts[first]] - base, cp[shard.ends[last]] - base)
        for r, b, e, cb, ce in zip(*(c.tolist() for c in columns), strict=True):
            hits[r].append({"start": b, "end": e})
            spans[r].append({"start": cb, "end": ce})
    return hits, spans


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[TestSuffixes]:
    """The benchmark in blocks of about ``block_bytes`` of text, dealt out by a hash of each row."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = -(-total // block_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for b in range(max(1, n)):
        yield TestSuffixes([(r.item_id, r.text) for r in rows.where(block == b).collect()], window)


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc`` (the row) with its number of words and hit words, items, hit word ranges, spans and the longest of these runs (which several items may make up).

    ``hits`` are ranges of word numbers and ``spans`` of code points, ends
    exclusive. Beyond one block of the benchmark, each pass hands its hits on.
    """
    out = None
    for tests in benchmark_blocks(benchmark, window, block_bytes):
        if out is None:
            out = tx.annotate(docs, {"text": (text, "string")}, _task(tests), RESULT)
            place = [c.lower() for c in docs.columns].index(text.lower())
            continue
        inputs = {"text": ("text", "string"), "hits": ("hits", RESULT["hits"].dataType), "items": ("items", RESULT["items"].dataType)}
        again = tx.annotate(out.withColumn("text", F.col("doc")[f"c{place}"]), inputs, _task(tests), RESULT)
        out = again.withColumn("doc", F.col("doc")["c0"])
    return out


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each test suffix with a match of a window or more: its longest verbatim match and where it is.

    One row per (item_id, item_word): the length in words, and the smallest
    (doc_id as text, doc_word) that has it. Map-side maxima keep the shuffle to
    at most one row per suffix and shard.
    """
    def matches(tests: TestSuffixes):
        names = np.array(["" if i is None else i for i in tests.item_ids], object)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tx.slices(batches, "text"):
                shard = Shard(batch.column("text"), tests)
                _, _, length, lo, hi = search(shard.words, shard.array, tests)
                some = np.flatnonzero((length >= np.maximum(tests.window, 1)) & (tests.window > 0))
                places = [np.min(shard.array[lo[s] : hi[s]]) for s in some]
                row, word = shard.word_index(np.array(places, np.int64))
                ids = batch.column("doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[tests.item[some]], pa.string()), pa.array(tests.place[some]), ids, pa.array(word - shard.first_word[row]), pa.array(length[some])],
                    names=MATCH.names,
                )

        return run

    narrow = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = None
    for tests in benchmark_blocks(benchmark, window, block_bytes):
        part = narrow.mapInArrow(matches(tests), MATCH)
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct((-F.col("length")).alias("n"), "doc_id", "doc_word")).alias("best")
    return found.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", "best.doc_id", "best.doc_word", (-F.col("best.n")).alias("length"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, in their own columns, that hold no window of any benchmark item."""
    return tx.original(mark_contamination(docs, benchmark, text, window).where("n_hit = 0"), docs)
