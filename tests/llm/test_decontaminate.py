import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import SF001, edge_rows, frame, words
from veilframe.llm import decontaminate as d

ITEM = "the quick brown fox jumps over the lazy dog and then it sleeps until noon"


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if x := windows.get(tuple(w[p : p + size])):
                    found |= {str(k) for k in x if k is not None}
                    hit.update(range(p, p + size))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, rows, items, **options):
    bench = frame(spark, items, key="item_id")
    found = d.mark_contamination(frame(spark, rows), bench, **options)
    got = found.select(F.col("doc.c0"), "n_words", "n_hit", "items").collect()
    return sorted([(r[0], r[1], r[2], list(r[3])) for r in got], key=repr)


ITEMS = [(10, ITEM), (11, "One two three."), (12, ""), (13, None), (11, "One two three."), (None, "alpha beta"), (14, ITEM.upper() + " again")]
ROWS = [
    *edge_rows(f"He said: {ITEM}. ONE, two three! alpha beta"),
    (20, ITEM[: len(ITEM) // 2]),
    (21, "one two"),
    (22, f"{ITEM} {ITEM}"),
    (23, "one two three one two three"),
]


def test_equals_brute_force_with_edge_cases(spark):
    assert run(spark, ROWS, ITEMS) == brute(ROWS, ITEMS)


def test_blocks_of_the_benchmark_give_the_same(spark):
    assert run(spark, ROWS, ITEMS, block_bytes=60) == brute(ROWS, ITEMS)


def test_documents_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text")
    rows, items = [tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()]
    assert run(spark, rows, items) == brute(rows, items)
    assert any(n for _, _, n, _ in brute(rows, items))


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, [(1, ITEM)], []) == [(1, 15, 0, [])]


def test_spans_cover_the_passage_and_removal_keeps_columns(spark):
    docs = frame(spark, [(1, f"ééé {ITEM} end"), (2, "clean text")])
    bench = frame(spark, [(10, ITEM)], key="item_id")
    row = d.mark_contamination(docs, bench).where("n_hit > 0").first()
    assert [(s.start, s.end) for s in row.spans] == [(4, 4 + len(ITEM))] and row.longest_run == 15
    left = d.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]


def test_longest_matches(spark):
    w = ITEM.split()
    docs = frame(spark, [(1, "x " + " ".join(w[:11])), (2, "y y " + " ".join(w[1:14]))])
    got = d.longest_matches(docs, frame(spark, [(10, ITEM)], key="item_id")).collect()
    best = {r.item_word: (r.doc_id, r.doc_word, r.length) for r in got}
    assert best == {0: ("1", 1, 11), 1: ("2", 2, 13), 2: ("2", 3, 12), 3: ("2", 4, 11), 4: ("2", 5, 10)}


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_is_sorted(seed):
    rng = np.random.default_rng(seed)
    w = rng.integers(0, 4, 300)
    array = d.suffix_array(w, 3, 40)

    def key(at):
        tail = w[at : at + 40].tolist()
        return tail[: tail.index(0)] if 0 in tail else tail

    keys = [key(a) for a in array]
    assert sorted(array.tolist()) == np.flatnonzero(w).tolist() and keys == sorted(keys)
