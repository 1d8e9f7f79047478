import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.util import edge_rows, frame
from veilframe.llm import toxicity as x

INSULTS = ["glarb", "snorkfest", "vilebit"]


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "ti", "vu", "za", "pel")]
    texts, labels = [], []
    for i in range(n):
        w = rng.choices(plain, k=rng.randrange(5, 200))
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(INSULTS) + rng.choice(["", "s", "ed"])
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return x.train(*corpus(300, 1), steps=(60, 60))


def test_held_out_accuracy(model):
    texts, labels = corpus(300, 2)
    scores = model.scores(x.Words(pa.array(texts)))
    assert np.mean((scores >= 0.5) == np.array(labels)) > 0.9


def test_gradients_are_those_of_the_loss():
    model = x.Model(3)
    rng = np.random.default_rng(0)
    for name in ("v", "w"):
        model.p[name] = rng.normal(0, 0.5, model.p[name].shape).astype(np.float32)
    words = x.Words(pa.array(["ab cd efg " * 15, "cd zz ab"]))
    windows, y = words.windows, np.zeros(len(words.windows))
    y[0] = 1
    weights = np.ones(len(y))

    def loss():
        z = model.logits(words).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads = model.gradients(words, windows, y, weights)
    for name, index in (("U", (0, 1, 2)), ("U", (1, 3, 20)), ("W", (2, 5)), ("v", (3,)), ("w", (1,)), ("b", (30,)), ("words", (int(words.word_row[0]), 1)), ("grams", (int(words.gram_row[0]), 2)), ("pad", (0, 3))):
        old = model.p[name][index]
        model.p[name][index] = old + 1e-2
        up = loss()
        model.p[name][index] = old - 1e-2
        down = loss()
        model.p[name][index] = old
        assert abs((up - down) / 2e-2 - grads[name][index]) < 2e-3


def test_words_do_not_depend_on_the_parts(monkeypatch):
    texts = pa.array([*corpus(40, 5)[0], None, "", "... !!!", "Kana " * 300, "é" * 700, "kana"])
    monkeypatch.setattr(x, "PART_BYTES", 1 << 30)
    whole = x.Words(texts)
    for size in (1, 500, 5000):
        monkeypatch.setattr(x, "PART_BYTES", size)
        parts = x.Words(texts)
        for name, value in vars(whole).items():
            got = getattr(parts, name)
            assert got.dtype == value.dtype and np.array_equal(got, value), name
    assert len(x.Words(pa.array(["... !!!", None])).hashes) == 0


def test_words_of_many_texts_take_little_memory(monkeypatch):
    """Training holds all its texts' words in the driver: some bytes for each byte of text, not dozens."""
    texts = pa.array([" ".join(f"w{(7 * i + j) % 5000}" for j in range(1500)) for i in range(700)])
    monkeypatch.setitem(x.tx._powers, "up", np.ones(1, np.uint64))
    monkeypatch.setitem(x.tx._powers, "down", np.ones(1, np.uint64))
    tracemalloc.start()
    words = x.Words(texts)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(words.hashes) == 5000
    assert peak < 16 * texts.nbytes and kept < 8 * texts.nbytes


def test_edge_cases_and_all_windows(spark, model):
    clean = " ".join(["kana loso mivu"] * 2000)
    rows = [*edge_rows("kana teza"), (8, clean + " glarb glarb"), (9, clean)]
    docs = frame(spark, rows)
    out = x.score_toxicity(docs, model).select(F.col("doc.c0"), "score").collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r[0]: r.score for r in out}
    assert by[1] == by[2] and by[8] > 0.5 > by[9]
    assert x.score_toxicity(frame(spark, []), model).count() == 0


def test_removal_and_labels(spark):
    texts, y = corpus(120, 4)
    docs = frame(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(None, 1), (0, None), (1, 0)], "doc_id long, toxic int")
    rows = x.training_rows(docs, labels)
    held = {r[0] for r in docs.where(x.held_out(F.col("doc_id"))).select("text").collect()}
    assert rows and not held & {t for t, _ in rows}
    assert dict(rows) == {t: v for t, v in zip(texts, y, strict=True) if t not in held}
    left = x.remove_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert left.columns == docs.columns and left.count() == 120  # nothing to learn from: nothing goes
