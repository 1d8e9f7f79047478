from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import edge_rows, frame
from veilframe.llm import sharding as s


def brute(shards, size):
    """The turn-taking fill, written out with each shard's whole order of preference."""
    names = sorted(shards)
    orders = [[(s._hash(n, "offset") + j * (s._hash(n, "step") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    table, taken = [None] * size, 0
    while taken < size:
        for name, order in zip(names, orders, strict=True):
            if taken == size:
                break
            slot = next(x for x in order if table[x] is None)
            table[slot] = name
            taken += 1
    return table


def test_table_equals_brute_force():
    shards = ("c", "a", "b", "d")
    assert [shards[k] for k in s.lookup_table(shards, 101)] == brute(shards, 101)


def test_even_and_stable():
    names = s.SHARDS
    counts = np.bincount(s.lookup_table(names))
    assert counts.max() - counts.min() <= 1
    assert s.moved_share(names, names[:-1]) < 3 / len(names)
    assert s.moved_share(names, tuple(reversed(names))) == 0


@pytest.mark.parametrize("shards, size", [((), 7), (("a", "a"), 7), (("a",), 8)])
def test_wrong_parameters(shards, size):
    with pytest.raises(ValueError):
        s.lookup_table(shards, size)


def test_placement(spark):
    rows = [*edge_rows("text"), *[(i, "t") for i in range(100, 3000)]]
    docs = frame(spark, rows)
    out = s.place(docs)
    got = out.select(F.col("doc.c0").alias("id"), "slot", "shard").collect()
    assert len(got) == len(rows)
    table = s.lookup_table(s.SHARDS)
    assert all(s.SHARDS[table[r.slot]] == r.shard for r in got)
    assert len({r.shard for r in got if r.id == 3}) == 1
    loads = Counter(r.shard for r in got)
    assert {r.shard: r.rows for r in s.load_by_shard(out).collect()} == dict(loads) and max(loads.values()) < 3 * len(rows) / 64
    assert s.place(frame(spark, [])).count() == 0
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
