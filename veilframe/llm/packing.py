"""Hierarchical multi-length packing of tokenised documents (operator 7).

Documents are routed by length to context-size tiers (256 to 2048 tokens). Whole
windows of the longest tier are cut off first; the remainders are packed longest
tier first: each opens a window of the smallest tier that holds it, and the gap
is filled from the shorter ones, best fit first and then by cutting a piece to
the gap. Every window ends up full; what is left at a block's end is cut into
powers of two, so that sequences need no padding. Sequences are then dealt to
step groups of about equal token counts, longest first to the lightest group.

A task packs its rows in blocks of bounded token count, so no shuffle is needed
and memory doesn't grow with the partition. Sequence ids carry the partition
number; a recomputed task gives the same rows from the same input rows.

A null text counts as empty: its only id is the end-of-document id. Repeated
rows are packed each on its own; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import text as tx

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: A block is packed when it has so many tokens.
BLOCK_TOKENS = 2_000_000
#: Tokens of a step group.
STEP_TOKENS = 64 * 2048
#: Words whose ids a worker remembers before it starts afresh, and their ids (24 and 4 bytes each).
CACHE_WORDS, CACHE_IDS = 2_000_000, 16_000_000


class WordTokenizer:
    """Ids of whole texts through a tokenizer that drops white space between words.

    Words between ASCII white space are encoded once per worker and looked up
    afterwards by a 64-bit hash (a false match among the words kept has a chance
    under one in a million). That is exact for tokenizers whose pre-tokenizer
    drops white space and whose normaliser doesn't compose characters across it.
    """

    #: A word of its own between the words of one call; its id marks where each ends.
    MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids([self.MARK])[0]
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn, and how many each has."""
        counts = np.zeros(len(words), np.int64)
        plain = np.array([self.MARK not in w for w in words])
        parts: list[np.ndarray] = []
        if len(self.mark) != 1 or not plain.all():
            parts = self._ids(words)
            counts[:] = [len(p) for p in parts]
            return np.concatenate(parts), counts
        glue = f" {self.MARK} "
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            ids = self._ids([glue.join(part) + glue])[0]
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) != len(part):
                single = self._ids(part)
                counts[i : i + len(part)] = [len(p) for p in single]
                parts += single
                continue
            counts[i : i + len(part)] = np.diff(ends, prepend=-1) - 1
            parts.append(ids[ids != self.mark[0]])
        return np.concatenate(parts), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in turn and the offsets of the rows."""
        data, offsets = tx.utf8(texts)
        starts, ends = tx.runs(data, offsets, tx.VISIBLE_BYTES)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        distinct, first, which = np.unique(tx.span_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS or len(self.pool) > CACHE_IDS:
            self._reset()
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if new.any():
            raw = data.tobytes()
            ids, counts = self._encode_words([raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct[new])
            self.hashes = np.insert(self.hashes, at, distinct[new])
            self.begin = np.insert(self.begin, at, len(self.pool) + np.cumsum(counts) - counts)
            self.counts = np.insert(self.counts, at, counts)
            self.pool = np.concatenate([self.pool, ids])
        place = np.searchsorted(self.hashes, distinct)[which]
        counts = self.counts[place]
        sizes = np.bincount(tx.row_of(starts, offsets), weights=counts, minlength=len(texts)).astype(np.int64)
        return self.pool[tx.spread(self.begin[place], counts)], np.concatenate([[0], np.cumsum(sizes)])


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for ``path``; what it has encoded serves later tasks too."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, length), for documents of these token counts."""
    longest = tiers[-1]
    sequences, pool = [], []
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        sequences += [[(doc, at, longest)] for at in range(0, whole, longest)]
        if n > whole:
            pool.append((n - whole, doc, whole))
    pool.sort()
    while pool:
        n, doc, at = pool.pop()
        size = next(t for t in tiers if t >= n)
        window, gap = [(doc, at, n)], size - n
        while gap and pool:
            fit = bisect.bisect_right(pool, (gap, len(lengths), 0)) - 1
            if fit >= 0:
                n, doc, at = pool.pop(fit)
                window.append((doc, at, n))
                gap -= n
            else:  # every piece is longer than the gap: cut the longest
                n, doc, at = pool.pop()
                window.append((doc, at, gap))
                bisect.insort(pool, (n - gap, doc, at + gap))
                gap = 0
        sequences += [window] if not gap else _powers(window)
    return sequences


def _powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window that can't be filled, cut into sequences whose lengths are powers of two."""
    total, out, parts = sum(n for _, _, n in window), [], window[::-1]
    for power in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
        sequence, left = [], power
        while left:
            doc, at, n = parts.pop()
            take = min(n, left)
            sequence.append((doc, at, take))
            left -= take
            if n > take:
                parts.append((doc, at + take, n - take))
        out.append(sequence)
    return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each sequence: longest first, to the group with the fewest tokens so far."""
    heap = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    groups = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tokens, g = heapq.heappop(heap)
        groups[i] = g
        heapq.heappush(heap, (tokens + sizes[i], g))
    return groups


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: where it comes from, its sequence and place there, its tier and step group.

    ``with_ids`` adds the token ids themselves. ``tokenizer_path`` must name a
    tokenizer file that every executor can open.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    numbers = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("tier", T.LongType()), ("step_group", T.LongType())]
    ids_field = [("ids", T.ArrayType(T.LongType(), False))] if with_ids else []
    schema = T.StructType([narrow.schema["doc_id"], *tx.struct_of(*numbers, *ids_field).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 36
        made, steps = 0, 0
        keys, ids, sizes, total = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal made, steps
            flat, lengths = np.concatenate(ids), np.concatenate(sizes)
            begin = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            raw = flat.astype("<u4").tobytes()
            sequences = pack_lengths(lengths.tolist(), tiers)
            totals = [sum(n for _, _, n in s) for s in sequences]
            groups = step_groups(totals)
            rows = []
            for i, (sequence, size, group) in enumerate(zip(sequences, totals, groups, strict=True)):
                offset = 0
                for doc, at, n in sequence:
                    a = begin[doc] + at
                    rows.append((doc, at, n, zlib.crc32(raw[4 * a : 4 * (a + n)]), begin[doc + 1] - begin[doc], base + made + i, offset, size, base + steps + group, a))
                    offset += n
            made += len(sequences)
            steps += max(groups) + 1
            columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
            arrays = [pa.concat_arrays(keys).take(pa.array(columns[0])), *map(pa.array, columns[1:9])]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(columns[2])])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[tx.spread(columns[9], columns[2])].astype(np.int64))))
            return pa.RecordBatch.from_arrays([x.cast(f) for x, f in zip(arrays, kinds(keys[0].type), strict=True)], names=schema.names)

        def kinds(of_key: pa.DataType) -> list[pa.DataType]:
            return [of_key, *[pa.int64()] * len(numbers), *[pa.list_(pa.field("element", pa.int64(), False))] * with_ids]

        for batch in tx.slices(batches, "text"):
            found, offsets = tokenizer.encode(batch.column("text"))
            keys.append(batch.column("doc_id"))
            ids.append(np.insert(found, offsets[1:], END_ID))
            sizes.append(np.diff(offsets) + 1)
            total += len(ids[-1])
            if total >= block_tokens:
                yield block()
                keys, ids, sizes, total = [], [], [], 0
        if total:
            yield block()

    return narrow.mapInArrow(run, schema)
