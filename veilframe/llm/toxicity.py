"""Toxicity scores from a bidirectional gated recurrent network with attention pooling (operator 9).

A word's input is the sum of a word vector (hashed) and the mean of its character
n-gram vectors (3 and 5 bytes with word ends, hashed), projected to the gates of a
bidirectional network over windows of 32 words, each half overlapping the next.
Attention weights pool the window's states into one logit; a document's score is
the logistic of its highest window logit, calibrated on the training documents.
The network is trained in numpy: first on all windows under their document's
label, then on each document's highest windows, by backpropagation through time.

It is fitted on a sample of labelled rows: about ``sample`` rows of each class
chosen by a hash of the id, of texts up to ``max_chars`` (these bounds are for
fitting only; every whole text is scored, all its windows). Rows without a label
take no part in fitting. Null and empty texts score as one window of padding.
Repeated rows score alike; extra columns are carried as they are. Without
labels of both classes every text gets the score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import gru
from veilframe.llm import text as tx

STEPS, STRIDE = 32, 16
HIDDEN, WIDTH = 8, 16
WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 14
GRAMS = (3, 5)
SAMPLE, MAX_CHARS = 1500, 20_000
SEED = 9
RESULT = tx.struct_of(("score", T.DoubleType()))
#: Windows scored at a time.
CHUNK = 4096
#: Bytes of text whose words are found at a time.
PART_BYTES = 500_000


class Words:
    """The words of some texts: distinct ones with their n-grams, and the windows over them.

    Bytes are read ``PART_BYTES`` at a time, so that many texts take little more than their words.
    """

    def __init__(self, texts: pa.Array):
        known = np.zeros(0, np.uint64)
        hashes, counts = [known], [np.zeros(0, np.int64)]
        new, gram_rows, gram_counts = [known], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for part in tx.slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", PART_BYTES):
            data, offsets = tx.utf8(part.column("text"))
            starts, ends = tx.runs(data, offsets, tx.WORD_BYTES)
            hashes.append(tx.span_hashes(data, starts, ends))
            counts.append(np.bincount(tx.row_of(starts, offsets), minlength=part.num_rows))
            distinct, first = np.unique(hashes[-1], return_index=True)
            unseen = ~np.isin(distinct, known, assume_unique=True)
            new.append(distinct[unseen])
            known = np.union1d(known, new[-1])
            starts, ends = starts[first[unseen]], ends[first[unseen]]
            # n-grams of each word met first here, word by word, some thousand words at a time
            for a in range(0, len(starts), 10_000):
                rows, sizes = _gram_rows(data, starts[a : a + 10_000], ends[a : a + 10_000])
                gram_rows.append(rows)
                gram_counts.append(sizes)
        self.hashes = known
        self._in_order(np.concatenate(new), np.concatenate(gram_rows), np.concatenate(gram_counts))
        counts = np.concatenate(counts)
        begin = np.concatenate([[0], np.cumsum(counts)])
        windows = np.maximum(1, -(-np.maximum(counts - STEPS, 0) // STRIDE) + 1)
        self.row = np.repeat(np.arange(len(texts)), windows)
        self.first_window = np.concatenate([[0], np.cumsum(windows)])
        at = begin[self.row] + (np.arange(len(self.row)) - self.first_window[self.row]) * STRIDE
        # distinct word number of each window place; the number after the last is padding
        which = np.concatenate([*[np.searchsorted(known, x) for x in hashes], [len(known)]]).astype(np.int32)
        self.windows = np.empty((len(at), STEPS), np.int32)
        for a in range(0, len(at), CHUNK):
            place = at[a : a + CHUNK, None] + np.arange(STEPS)
            inside = place < begin[self.row[a : a + CHUNK] + 1][:, None]
            self.windows[a : a + CHUNK] = which[np.where(inside, place, len(which) - 1)]

    def _in_order(self, words: np.ndarray, gram_rows: np.ndarray, gram_counts: np.ndarray) -> None:
        """Table rows of the distinct words and of their n-grams, in the order of ``hashes``."""
        order = np.argsort(words)
        begins = np.cumsum(gram_counts) - gram_counts
        self.gram_row = gram_rows[tx.spread(begins[order], gram_counts[order])]
        self.n_grams = gram_counts[order].astype(np.float32)
        self.word_row = (tx.mix(self.hashes) % np.uint64(WORD_ROWS)).astype(np.int64)


def _gram_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the n-grams of some words between spaces, in the words' order, and each word's number of them."""
    sizes = ends - starts
    marked = np.full(int(sizes.sum()) + 2 * len(sizes), 32, np.uint8)
    begin = np.cumsum(sizes + 2) - (sizes + 2)
    marked[tx.spread(begin + 1, sizes)] = data[tx.spread(starts, sizes)]
    word, row = [], []
    for n in GRAMS:
        counts = np.maximum(sizes + 2 - n + 1, 1)
        at = tx.spread(begin, counts)
        owner = np.repeat(np.arange(len(sizes)), counts)
        stop = np.minimum(at + n, (begin + sizes + 2)[owner])
        word.append(owner)
        row.append((tx.mix(tx.span_hashes(marked, at, stop) + np.uint64(n)) % np.uint64(GRAM_ROWS)).astype(np.int32))
    word, row = np.concatenate(word), np.concatenate(row)
    return row[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))


class Model:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            **gru.init_cell(rng, HIDDEN),
            "words": rng.normal(0, 0.1, (WORD_ROWS, WIDTH)).astype(f),
            "grams": rng.normal(0, 0.1, (GRAM_ROWS, WIDTH)).astype(f),
            "pad": np.zeros((1, WIDTH), f),
            "W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 6 * HIDDEN)).astype(f),
            "b": np.zeros(6 * HIDDEN, f),
            "v": np.zeros(2 * HIDDEN, f),
            "w": rng.normal(0, 0.3, 2 * HIDDEN).astype(f),
            "c": np.zeros(1, f),
        }
        self.scale, self.shift = 1.0, 0.0

    def vectors(self, words: Words) -> np.ndarray:
        """Input vectors of the distinct words, then that of padding."""
        out = np.empty((len(words.hashes) + 1, WIDTH), np.float32)
        out[-1] = self.p["pad"][0]
        if len(words.hashes):
            ends = np.cumsum(words.n_grams).astype(np.int64)
            begins = ends - words.n_grams.astype(np.int64)
            for a in range(0, len(ends), 20_000):
                b = min(a + 20_000, len(ends))
                rows = words.gram_row[begins[a] : ends[b - 1]]
                sums = np.add.reduceat(self.p["grams"][rows], begins[a:b] - begins[a], axis=0)
                out[a:b] = self.p["words"][words.word_row[a:b]] + sums / words.n_grams[a:b, None] * 3
        return out

    def _halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gate terms (distinct, 3 * hidden) of each direction."""
        terms, size = vectors @ self.p["W"] + self.p["b"], 3 * HIDDEN
        return np.ascontiguousarray(terms[:, :size]), np.ascontiguousarray(terms[:, size:])

    def _inputs(self, halves: tuple[np.ndarray, np.ndarray], windows: np.ndarray):
        """Gate terms of both directions, step by step."""
        size = 3 * HIDDEN
        columns = np.ascontiguousarray(windows.T)

        def at(t: int) -> np.ndarray:
            out = np.empty((2, len(windows), size), np.float32)
            np.take(halves[0], columns[t], axis=0, out=out[0], mode="clip")
            np.take(halves[1], columns[STEPS - 1 - t], axis=0, out=out[1], mode="clip")
            return out

        return at

    def _pool(self, states: np.ndarray, windows: np.ndarray, pad: int):
        """Attention weights over places with words, pooled states and logits."""
        both = np.concatenate([states[0], states[1, ::-1]], axis=-1)
        weights = both @ self.p["v"] + np.where(windows.T == pad, np.float32(-1e4), np.float32(0))
        weights = gru.softmax(weights.T).T
        pooled = np.einsum("tn,tnh->nh", weights, both)
        return both, weights, pooled, pooled @ self.p["w"] + self.p["c"][0]

    def logits(self, words: Words) -> np.ndarray:
        halves = self._halves(self.vectors(words))
        out = np.empty(len(words.windows), np.float32)
        for a in range(0, len(out), CHUNK):
            part = words.windows[a : a + CHUNK]
            states = gru.forward(self._inputs(halves, part), STEPS, self.p["U"])
            out[a : a + CHUNK] = self._pool(states, part, len(words.hashes))[3]
        return out

    def document_logits(self, words: Words) -> np.ndarray:
        return np.maximum.reduceat(self.logits(words), words.first_window[:-1])

    def scores(self, words: Words) -> np.ndarray:
        z = self.document_logits(words).astype(np.float64) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, words: Words, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss of some windows."""
        pad = len(words.hashes)
        used, places = np.unique(windows, return_inverse=True)
        places = places.reshape(windows.shape)
        vectors, grams, owner = self._some_vectors(words, used)
        states, tape = gru.forward(self._inputs(self._halves(vectors), places), STEPS, self.p["U"], keep=True)
        both, attention, pooled, logit = self._pool(states, windows, pad)
        d_logit = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * weights / weights.sum()).astype(np.float32)
        d_pooled = d_logit[:, None] * self.p["w"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, both)
        d_score = attention * (d_weight - (attention * d_weight).sum(0))
        d_both = attention[:, :, None] * d_pooled + d_score[:, :, None] * self.p["v"]
        d_states = np.stack([d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]])
        d_inputs, d_U = gru.backward(tape, self.p["U"], d_states)
        # back to the distinct words: both directions' terms, in order of place
        by_place = np.concatenate([d_inputs[0], d_inputs[1, ::-1]], axis=-1).reshape(-1, 6 * HIDDEN)
        flat = places.T.reshape(-1)
        order = np.argsort(flat, kind="stable")
        d_terms = np.add.reduceat(by_place[order], np.searchsorted(flat[order], np.arange(len(used))), axis=0)
        d_vectors = d_terms @ self.p["W"].T
        out = {"U": d_U, "W": vectors.T @ d_terms, "b": d_terms.sum(0), "w": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True), "v": np.einsum("tn,tnh->h", d_score, both)}
        real = used < pad
        out["pad"] = d_vectors[~real].sum(0, keepdims=True)
        out["words"] = _scatter(words.word_row[used[real]], d_vectors[real], WORD_ROWS)
        share = (d_vectors[real] / words.n_grams[used[real], None] * 3)[owner]
        out["grams"] = _scatter(grams, share, GRAM_ROWS)
        return out

    def _some_vectors(self, words: Words, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        real = used[used < len(words.hashes)]
        out = np.empty((len(used), WIDTH), np.float32)
        out[len(real) :] = self.p["pad"][0]
        counts = words.n_grams[real].astype(np.int64)
        begins = (np.cumsum(words.n_grams) - words.n_grams).astype(np.int64)[real]
        grams = words.gram_row[tx.spread(begins, counts)]
        owner = np.repeat(np.arange(len(real)), counts)
        if len(real):
            sums = np.add.reduceat(self.p["grams"][grams], np.cumsum(counts) - counts, axis=0)
            out[: len(real)] = self.p["words"][words.word_row[real]] + sums / counts[:, None] * 3
        return out, grams, owner


def _scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    columns = [np.bincount(rows, values[:, j], size) for j in range(values.shape[1])]
    return np.stack(columns, 1).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = SEED, steps: tuple[int, int] = (160, 200), batch: int = 256) -> Model:
    """Fit on whole texts: windows under document labels first, then the highest windows."""
    model, rng = Model(seed), np.random.default_rng(seed)
    words = Words(pa.array(texts, pa.string()))
    y = np.array(labels, np.float32)
    adam = gru.Adam(model.p, 0.01)
    positive, negative = np.flatnonzero(y[words.row] == 1), np.flatnonzero(y[words.row] == 0)

    def update(chosen: np.ndarray, rate: float) -> None:
        grads = model.gradients(words, words.windows[chosen], y[words.row[chosen]], np.ones(len(chosen), np.float32))
        for name in ("words", "grams"):
            grads[name] += 1e-5 * model.p[name]
        adam.step(grads, rate)

    for step in range(steps[0]):
        update(np.concatenate([rng.choice(positive, batch // 2), rng.choice(negative, batch // 2)]), 0.01 * (1 - 0.5 * step / steps[0]))
    rounds = 5
    for turn in range(rounds):
        z = model.logits(words)
        order = np.lexsort((-z, words.row))
        rank = np.arange(len(order)) - words.first_window[words.row[order]]
        top_positive = order[(rank < 2) & (y[words.row[order]] == 1)]
        top_negative = order[(rank < 4) & (y[words.row[order]] == 0)]
        for _ in range(steps[1] // rounds):
            update(np.concatenate([rng.choice(top_positive, batch // 2), rng.choice(top_negative, batch // 4), rng.choice(negative, batch // 4)]), 0.004 * (1 - turn / rounds) + 0.0005)
    model.scale, model.shift = _calibrate(model.document_logits(words).astype(np.float64), y)
    return model


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit of balanced classes, by Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(w * (p - y) * z).sum() + (a - 1), (w * (p - y)).sum() + 0.1 * b])
        q = w * p * (1 - p)
        h = np.array([[(q * z * z).sum() + 1, (q * z).sum()], [(q * z).sum(), q.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = max(0.05, a - step[0]), b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves no remainder by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """About ``sample`` distinct labelled texts of each class, none of them held out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return []
    parts = 1 << 20
    chance = F.when(F.col("y") == 1, F.lit(min(1.0, sample / sizes[1]) * parts)).otherwise(F.lit(min(1.0, sample / sizes[0]) * parts))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(parts)) < chance).groupBy("id").agg(F.max("y").alias("y"))
    # at most a few thousand ids, by the sampling above
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("text").agg(F.max("y").alias("y")).collect()
    return sorted((r.text, r.y) for r in rows)


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model | None:
    rows = training_rows(docs, labels, **options)
    if len({y for _, y in rows}) < 2:
        return None
    model = train([t for t, _ in rows], [y for _, y in rows])
    rows.clear()
    tx.give_back()
    return model


def _task(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            scores = np.zeros(batch.num_rows) if model is None else model.scores(Words(batch.column("text")))
            yield [pa.array(scores)]

    return run


def score_toxicity(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``doc`` (the row) and its ``score`` from 0 to 1."""
    return tx.annotate(docs, {"text": (text, "string")}, _task(model), RESULT)


def remove_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents, in their own columns, that score under ``limit``."""
    model = fit(docs, labels, doc_id=doc_id, text=text)
    return tx.original(score_toxicity(docs, model, text).where(F.col("score") < limit), docs)
