import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import queries
from veilframe.llm import vector_codes as x

SCHEMA = "vec_id long, embedding array<float>, label int, entry string, position string, error string"


def floored(v):
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [math.floor(4096 * float(np.float32(c))) for c in v]


def brute(rows, parts, entries, rounds):
    """Codes and errors by id, and the entries, in plain Python."""
    kept = [(i, q) for i, v, _ in rows if (q := floored(v)) is not None]
    width = -(-max((len(q) for _, q in kept), default=0) // parts)
    kept = [(i, q + [0] * (parts * width - len(q))) for i, q in kept]
    cut = [[q[p * width : (p + 1) * width] for p in range(parts)] for _, q in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            at = [nearest(p, c[p])[1] for c in cut]
            of = [[c[p] for c, a in zip(cut, at, strict=True) if a == e] for e in range(len(first))]
            moved.append([[sum(d) // len(m) for d in zip(*m, strict=True)] if m else books[p][e] for e, m in enumerate(of)])
        books = moved
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    rows = sorted((i if i is not None else -1, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found, strict=True))
    return rows, books


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], SCHEMA).repartition(3)
    books = x.fit(frame, **options)
    if books is None:
        return [], None
    got = x.encode(frame, books).select("row.c0", "code", "error").collect()
    return sorted((r.c0 if r.c0 is not None else -1, r.code, r.error) for r in got), books.entries.tolist()


def vectors(n, size, seed, spread=0.3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(size)], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("n, size, parts, entries, rounds", [(300, 16, 4, 8, 3), (10, 8, 8, 16, 2), (60, 7, 3, 4, 1)])
def test_equals_plain_lloyd(spark, n, size, parts, entries, rounds):
    rows = vectors(n, size, n)
    options = {"parts": parts, "entries": entries, "rounds": rounds}
    assert run(spark, rows, **options) == brute(rows, **options)


def test_edge_cases(spark):
    """Nulls, non-finite components, an empty and a short vector, repeated rows and copies, ties and a null id."""
    rows = vectors(40, 8, 5)
    rows += [(40, None, 1), (41, [None] * 8, 1), (42, [float("nan")] * 8, 1), (43, [float("inf")] + [0.0] * 7, 1), (44, [], None), (45, [0.5] * 3, 0)]
    rows += [(7, rows[7][1], 1)] * 3 + [(100 + i, [0.25] * 8, 1) for i in range(60)] + [(None, [0.1] * 8, 2), (200, [1e6] * 8, 2)]
    options = {"parts": 4, "entries": 5, "rounds": 3}
    assert run(spark, rows, **options) == brute(rows, **options)
    assert run(spark, []) == ([], None) and run(spark, [(1, None, 0)]) == ([], None)


def test_large_components_are_exact_or_named(spark):
    rows = [(1, [3e11, 0.0], 0), (2, [3e11, 1.0], 0), (3, [3e11, 900.0], 0)]
    options = {"parts": 1, "entries": 2, "rounds": 2}
    assert run(spark, rows, **options) == brute(rows, **options)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30], 0)])
    with pytest.raises(Exception, match="does not fit 64 bits"):
        run(spark, [(1, [1e12, 0.0], 0), (2, [-1e12, 0.0], 0)], parts=1, entries=1, rounds=1)


def test_only_parts_that_change_entry_move(spark):
    """Members that keep their nearest entry are not in the shuffled side."""
    books = x.Codebooks(np.array([[[0], [100]]]))
    members = spark.createDataFrame([(0, 0, 0, [3]), (0, 0, 1, [90]), (0, 1, 0, [80]), (0, 1, 0, [20])], "position int, entry int, salt int, part array<bigint>")
    stay, move = x.settled(members, books, 4)
    assert sorted((r.entry, r.part[0]) for r in stay.collect()) == [(0, 3), (1, 80)]
    assert sorted((r.entry, r.part[0]) for r in move.collect()) == [(0, 20), (1, 90)]
    plan = stay._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_label_error_counts_nulls_together(spark):
    rows = vectors(50, 8, 9)
    frame = spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], SCHEMA)
    books = x.fit(frame)
    found = x.with_label_error(x.encode(frame, books), F.col("row.c2")).select("row.c2", "error", "label_error").collect()
    sums = {}
    for r in found:
        sums[r.c2] = sums.get(r.c2, 0) + r.error
    assert len(found) == 50 and all(r.label_error == sums[r.c2] for r in found)
    text = ",".join(str(c) for p in books.entries.tolist() for e in p for c in e)
    assert books.sha256() == hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op11_vector_codes"])
    names = [d[0] for d in cursor.description]
    mine = queries.op11_vector_codes(spark, folder).select(*names).collect()
    assert sorted(tuple(r) for r in mine) == sorted(cursor.fetchall())
