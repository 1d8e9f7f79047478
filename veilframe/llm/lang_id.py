"""Language identification by a bidirectional gated recurrent network over bytes (operator 2).

Texts are read as UTF-8 bytes in chunks of 64. The network labels every byte
position with language probabilities from its left and right context in the
chunk; a document's probability is the mean over all its positions. It is
trained in numpy by backpropagation through time with the document's language as
the label of each position.

It is fitted on a sample of rows with a language: about ``sample`` rows, evenly
over the languages and at least one of each, chosen by a hash of the id among texts up to ``max_chars``
(bounds for fitting only; every whole text is labelled). Null texts and texts
without a letter are ``und`` with score 0, and so is every text if there is
nothing to learn from. Repeated rows get equal results, extra columns are
carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import gru
from veilframe.llm import text as tx

STEPS, HIDDEN = 64, 8
SAMPLE, MAX_CHARS = 2400, 20_000
SEED = 2
UNKNOWN = "und"
PAD = 256
#: Chunks labelled at a time.
CHUNK = 2048
RESULT = tx.struct_of(("lang_pred", T.StringType()), ("score", T.DoubleType()))
_LETTER = regex.compile(r"\p{L}")


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte chunks (n, STEPS), ends filled with PAD, and the row of each."""
    data, offsets = tx.utf8(texts)
    sizes = np.diff(offsets)
    counts = -(-sizes // STEPS)
    row = np.repeat(np.arange(len(sizes)), counts)
    at = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEPS
    out = np.full((len(row), STEPS), PAD, np.int32)
    place = at[:, None] + np.arange(STEPS)
    inside = place < offsets[row + 1][:, None]
    out[inside] = data[place[inside]]
    return out, row


class Model:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.languages = languages
        self.p = {
            **gru.init_cell(rng, HIDDEN),
            "bytes": rng.normal(0, 0.3, (2, PAD + 1, 3 * HIDDEN)).astype(f),
            "W": rng.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(f),
            "b": np.zeros(len(languages), f),
        }

    def _inputs(self, batch: np.ndarray):
        columns = np.ascontiguousarray(batch.T)
        table = self.p["bytes"]

        def at(t: int) -> np.ndarray:
            out = np.empty((2, batch.shape[0], 3 * HIDDEN), np.float32)
            np.take(table[0], columns[t], axis=0, out=out[0], mode="clip")
            np.take(table[1], columns[STEPS - 1 - t], axis=0, out=out[1], mode="clip")
            return out

        return at

    def _label(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both directions' states by position (STEPS, n, 2 * hidden) and the language probabilities there."""
        both = np.concatenate([states[0], states[1, ::-1]], axis=-1)
        return both, gru.softmax(both @ self.p["W"] + self.p["b"])

    def positions(self, batch: np.ndarray) -> np.ndarray:
        """Probabilities (STEPS, n, languages) of every position."""
        return self._label(gru.forward(self._inputs(batch), STEPS, self.p["U"]))[1]

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """Mean probabilities over each row's positions (zeros for empty rows)."""
        batch, row = chunks(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(batch), CHUNK):
            part = batch[a : a + CHUNK]
            inside = (part.T != PAD)[:, :, None]
            np.add.at(sums, row[a : a + CHUNK], (self.positions(part) * inside).sum(0, dtype=np.float64))
        return sums / np.maximum(sums.sum(1, keepdims=True), 1e-12)

    def gradients(self, batch: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy over all positions that hold a byte."""
        states, tape = gru.forward(self._inputs(batch), STEPS, self.p["U"], keep=True)
        both, d = self._label(states)
        inside = (batch.T != PAD)[:, :, None].astype(np.float32)
        d[:, np.arange(len(y)), y] -= 1
        d *= inside / inside.sum()
        d_both = d @ self.p["W"].T
        d_states = np.stack([d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]])
        d_inputs, d_U = gru.backward(tape, self.p["U"], d_states)
        d_bytes = np.zeros_like(self.p["bytes"])
        columns = batch.T
        for direction, order in ((0, columns), (1, columns[::-1])):
            flat = order.reshape(-1)
            by = np.argsort(flat, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], np.diff(flat[by]) != 0]))
            d_bytes[direction][flat[by][new]] = np.add.reduceat(d_inputs[direction].reshape(-1, 3 * HIDDEN)[by], new, axis=0)
        width = both.shape[-1]
        return {"U": d_U, "bytes": d_bytes, "W": both.reshape(-1, width).T @ d.reshape(-1, d.shape[-1]), "b": d.sum((0, 1))}


def train(texts: list[str], languages: list[str], seed: int = SEED, steps: int = 300, batch: int = 256) -> Model:
    """Fit on all chunks of the texts, drawing languages evenly."""
    names = sorted(set(languages))
    model, rng = Model(names, seed), np.random.default_rng(seed)
    data, row = chunks(pa.array(texts, pa.string()))
    y = np.array([names.index(x) for x in languages])[row]
    members = [np.flatnonzero(y == k) for k in range(len(names))]
    members = [m for m in members if len(m)]
    adam = gru.Adam(model.p, 0.02)
    for step in range(steps):
        chosen = np.concatenate([rng.choice(m, max(1, batch // len(members))) for m in members])
        adam.step(model.gradients(data[chosen], y[chosen]), 0.02 * (1 - 0.9 * step / steps))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves no remainder by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> list[tuple[str, str]]:
    """About ``sample`` distinct texts with a language, evenly over the languages, none of them held out."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    each, parts, finer = sample / len(sizes), 1 << 20, 1 << 32
    limit = F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1.0, each / n) * parts)])
    h = F.xxhash64("id", F.lit(SEED))
    short = rows.where(F.length("text") <= max_chars)
    chosen = short.where(F.pmod(h, F.lit(parts)) + F.pmod(F.shiftrightunsigned(h, 20), F.lit(finer)) / finer < limit[F.col("lang")])
    # one row of each language at least, however few the limit leaves
    least = short.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg(F.min(F.struct(h.alias("h"), "text")).alias("least"))
    chosen = chosen.select("text", "lang").unionAll(least.select("least.text", "lang"))
    found = chosen.groupBy("text").agg(F.min("lang").alias("lang")).collect()
    return sorted((r.text, r.lang) for r in found if _LETTER.search(r.text))


def fit(docs: DataFrame, **options) -> Model | None:
    rows = training_rows(docs, **options)
    return train([t for t, _ in rows], [x for _, x in rows]) if rows else None


def _task(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            texts = batch.column("text")
            if model is None:
                yield [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts)))]
                continue
            pooled = model.pooled(texts)
            best = pooled.argmax(1)
            known = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)
            names = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
            yield [pa.array(names, pa.string()), pa.array(np.where(known, pooled[np.arange(len(best)), best], 0.0))]

    return run


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``doc`` (the row) with ``lang_pred`` and the ``score`` of that language."""
    return tx.annotate(docs, {"text": (text, "string")}, _task(model), RESULT)
