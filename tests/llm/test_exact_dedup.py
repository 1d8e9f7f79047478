import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import CLASH, edge_rows, frame
from veilframe.llm import exact_dedup as x


def brute(rows):
    """(key, keep key, size, sha) of every row, and how many rows stay."""
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault(re.sub("[\\x20\\x09-\\x0D]", "", t), []).append((-len(t), i is None, i or 0))
    out = []
    for text, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(None if none else i, keep, len(members), sha) for _, none, i in members]
    return sorted(out, key=repr), len(groups)


def run(spark, rows, **options):
    found = x.exact_duplicates(frame(spark, rows).repartition(3), **options).select("doc.c0", "keep_id", "group_size", "text_sha256", "kept").collect()
    return sorted((tuple(r)[:4] for r in found), key=repr), sum(r.kept for r in found)


def copies(seed, n=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab \t\né") for _ in range(rng.randint(0, 6))) for _ in range(n)]
    return [(i, rng.choice(base)) for i in range(n)] + [(1000 + i, "hot copy" + " " * (i % 3)) for i in range(300)]


@pytest.mark.parametrize("options", [{}, {"wave_rows": 100}])
def test_equals_brute_force(spark, options):
    rows = copies(1)
    assert run(spark, rows, **options) == brute(rows)


def test_edge_cases(spark):
    """Null, empty, blank and very long texts, a null key, rows repeated in full, other white space, clashing columns."""
    rows = [*edge_rows("some words"), (8, " \t\r\n\x0b\x0c"), (9, "some words"), (10, "somewords"), (11, "s o m e words"), (None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == ([], 0) and run(spark, [(1, None)]) == brute([(1, None)])


def test_one_row_of_each_group_stays_with_all_columns(spark):
    rows = [*edge_rows("some words"), *copies(2, 50)]
    docs = frame(spark, rows)
    kept = x.keep_one(docs)
    assert kept.columns == ["doc_id", "text", *CLASH] and kept.count() == brute(rows)[1]
    assert kept.where(F.col("doc_id").isNotNull() & (F.col("row") != F.concat(F.lit("x"), F.col("doc_id")))).count() == 0


def test_filter_misses_no_repeat_and_lets_most_singles_through(spark):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(2**63), 2**63, 30000))
    repeated = keys[:3000]
    both = np.concatenate([keys, repeated])
    rows = spark.createDataFrame([(0, int(k)) for k in both], "wave int, key long").repartition(5)
    bits = x.slot_bits(len(both))
    found = next(x.build_filters(rows, bits, 1))
    assert found.may_repeat(repeated).all()
    assert found.may_repeat(keys[3000:]).mean() < 0.03


def test_only_possible_repeats_shuffle(spark):
    """The rows that pass the filter are read and returned without an exchange."""
    plan = x.exact_duplicates(frame(spark, copies(4))).select("keep_id", "kept")._jdf.queryExecution().executedPlan().toString()
    straight = plan.split("Union")[1].split("\n:-")[1] if "\n:-" in plan else plan.split("Union")[1]
    assert "Exchange" not in straight.split("+- ")[0]
