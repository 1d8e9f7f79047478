import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.util import SF001, edge_rows, frame
from veilframe.llm import periodic_runs as x
from veilframe.llm import queries

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(words):
    """(start, length, period) of all runs: every period tried at every place."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    text = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *facts, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        kind, n, a = rng.random(), rng.randint(1, 150), rng.randint(1, 4)
        if kind < 0.3:
            yield [rng.randrange(a) for _ in range(n)]
        elif kind < 0.55:
            out = []
            while len(out) < n:
                out += [rng.randrange(a) for _ in range(rng.randint(1, 25))] * rng.randint(1, 9)
                out = out[: len(out) - rng.randint(0, 3)]
            yield out
        elif kind < 0.75:
            x, y = [0], [0, 1]
            while len(y) < n:
                x, y = y, y + x
            yield y[:n] * rng.randint(1, 5)
        else:
            out = []
            for _ in range(rng.randint(1, 4)):
                out += [rng.randrange(3) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
            yield out * rng.randint(1, 6) + [rng.randrange(3) for _ in range(rng.randint(0, 9))]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    """Random, repetitive, Fibonacci and nested periodic sequences, many to a slice."""
    docs = list(sequences(seed, 150))
    sizes = [len(d) for d in docs]
    first = np.cumsum([0, *sizes])
    owner = np.repeat(np.arange(len(docs)), sizes)
    begin, length, period = x.find_runs(np.array([c for d in docs for c in d]), owner)
    got = [[] for _ in docs]
    for s, size, q in zip(begin.tolist(), length.tolist(), period.tolist(), strict=True):
        got[owner[s]].append((s - int(first[owner[s]]), size, q))
    assert [sorted(g) for g in got] == [brute(d) for d in docs]


def test_grammar_derives_the_sequence():
    words = np.array(list(sequences(7, 40))[3] * 3)
    grammar = x.repair(words, np.zeros(len(words), np.int64))

    def derive(symbol):
        if symbol < grammar.words:
            return [int(symbol)]
        return derive(grammar.left[symbol - grammar.words]) + derive(grammar.right[symbol - grammar.words])

    assert [w for s in grammar.top for w in derive(s)] == words.tolist()
    for rule, (place, size) in enumerate(zip(grammar.place, grammar.size[grammar.words :], strict=True)):
        assert derive(grammar.words + rule) == words[place : place + size].tolist()


def test_long_periods_and_long_texts():
    unit = np.random.default_rng(0).integers(0, 3000, 20000)
    words = np.concatenate([[5000], np.tile(unit, 4), unit[:77], [5001]])
    found = x.find_runs(words, np.zeros(len(words), np.int64))
    assert [int(f[0]) for f in found] == [1, 80077, 20000]
    same = x.find_runs(np.zeros(100000, np.int64), np.zeros(100000, np.int64))
    assert [f.tolist() for f in same] == [[0], [100000], [1]]


def run(spark, rows):
    from pyspark.sql import functions as F

    found = x.collapse_runs(frame(spark, rows), rewrite=F.crc32(F.col("doc_id").cast("string")), digest=True)
    return sorted((tuple(r) for r in found.select("doc.c0", *[f.name for f in x.FOUND]).collect()), key=repr)


def test_edge_cases(spark):
    """Null, empty and very long texts, a null id, repeated rows, ties, other white space, clashing columns."""
    sample = "a b a b a b a b\tx x x x x x x\ny y y y y y"
    rows = [*edge_rows(sample), *[(100 + i, sample + " end one two three four" * i) for i in range(40)], (-4, "z " * 50)]
    assert run(spark, rows) == sorted((expected(i, t) for i, t in rows), key=repr)
    assert run(spark, []) == []


def test_texts_and_runs_in_full(spark):
    found = x.collapse_runs(frame(spark, [(1, "go on on on on on on stop")])).select("runs", "collapsed").first()
    assert tuple(found) == ("1,6,1\n", "go on stop")


def test_query_equals_brute_force(spark):
    mine = queries.op13_periodic_runs(spark, SF001).collect()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 8000}
    assert len(mine) == len(docs) and any(r.n_runs for r in mine)
    assert sorted(tuple(r) for r in mine if r.doc_id in short) == sorted(expected(i, t) for i, t in short.items())
