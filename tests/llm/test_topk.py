import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import topk as x

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def quantise(v):
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [math.floor(64 * float(np.float32(c))) for c in v]


def brute(rows, k, every):
    vectors = [(i, q) for i, v in rows if i is not None and (q := quantise(v)) is not None]
    out = []
    for i, q in vectors:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in vectors if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k=20, every=20, **options):
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in x.top_k(frame, F.col("vec_id") % every == 0, k=k, **options).collect())


def vectors(n, size, seed, levels=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(levels)) if levels else (lambda: rng.gauss(0, 0.2))
    return [(i, [draw() for _ in range(size)]) for i in range(n)]


@pytest.mark.parametrize("rows, k, every", [(vectors(900, 64, 1), 20, 20), (vectors(300, 40, 2, [0.0, 0.5, -0.5]), 7, 10), (vectors(12, 5, 3), 20, 3)])
def test_equals_brute_force(spark, rows, k, every):
    assert run(spark, rows, k, every) == brute(rows, k, every)


def test_edge_cases(spark):
    rows = [*vectors(60, 20, 4), (60, None), (80, []), (100, [1.0, None]), (120, [float("nan")] * 20), (140, [float("inf")] * 20), (None, [1.0] * 20), (160, [1.0] * 20), (161, [1.0] * 20), (162, [1.0] * 20), (180, [0.5] * 8), (200, [1e7] * 20)]
    assert run(spark, rows) == brute(rows, 20, 20)
    assert run(spark, []) == [] and run(spark, [(20, [1.0])]) == []


def test_large_components_are_exact_or_named(spark):
    """Sums near 2^63 and components near 2^31 and 2^62: exact while the score fits, else a message."""
    rows = [(20, [3.3e7, 0.0]), (1, [3.3e7, 0.0]), (2, [-3.3e7, 0.0]), (3, [4.6e7, 0.0]), (40, [0.0, 7e16]), (4, [4.0, 0.0]), (5, [0.0, 0.015625])]
    assert run(spark, rows) == brute(rows, 20, 20)
    with pytest.raises(Exception, match="does not fit 64 bits"):
        run(spark, [(20, [3e16]), (1, [3e16])])
    with pytest.raises(Exception, match="too large"):
        run(spark, [(20, [1e30]), (1, [1.0])])


def test_blocks_of_queries_give_the_same(spark):
    rows = vectors(400, 32, 5)
    assert run(spark, rows, block=3) == brute(rows, 20, 20)


def test_bounds_drop_candidates():
    """The search returns far fewer candidates than there are, and none of the best is missing."""
    rng = np.random.default_rng(0)
    data = rng.integers(-20, 20, (64, 5000))
    query = rng.integers(-20, 20, 64)
    ids, scores = x.Columns(np.arange(5000), data).search(query, -1, 10, None)
    exact = query @ data
    assert set(np.argsort(-exact, kind="stable")[:10]) <= set(ids) and len(ids) < 1500 and (exact[ids] == scores).all()
