import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import SF001, edge_rows, frame
from veilframe.llm import packing as p
from veilframe.llm.queries import tokenizer_path


def ids_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(pieces, rows):
    """Each document's pieces give its ids back; sequences are gapless and need little padding."""
    want = sorted(tuple(x) for x in ids_of([t for _, t in rows]))
    sequences = defaultdict(list)
    for r in pieces:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        sequences[r.sequence_id].append(r)
    assert sum(r.length for r in pieces) == sum(map(len, want))
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # a power of two needs no padding
    return want


def test_round_trip_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    pieces = p.pack_documents(docs, tokenizer_path(), with_ids=True, block_tokens=30_000).collect()
    check(pieces, rows)
    by_doc = defaultdict(list)
    for r in sorted(pieces, key=lambda r: r.start):
        assert r.start == len(by_doc[r.doc_id])
        by_doc[r.doc_id] += r.ids
    for (i, _), ids in zip(rows, ids_of([t for _, t in rows]), strict=True):
        assert by_doc[i] == ids
    assert all(r.doc_tokens == len(by_doc[r.doc_id]) for r in pieces)


def test_edge_cases(spark):
    rows = [*edge_rows("He said <|endoftext|> it's J̌ and ǰ \x01 a b"), (8, "x" * 3000), (9, "\x01 \x01\x01")]
    pieces = p.pack_documents(frame(spark, rows), tokenizer_path(), with_ids=True).collect()
    check(pieces, rows)
    single = {r.doc_id: r for r in pieces if r.doc_id in (1, 2)}
    assert all(r.doc_tokens == 1 and r.ids == [1] for r in single.values())
    assert p.pack_documents(frame(spark, []), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pack_lengths_uses_every_token_once(seed):
    lengths = np.random.default_rng(seed).integers(1, 6000, 200).tolist()
    sequences = p.pack_lengths(lengths)
    used = sorted((d, a, n) for s in sequences for d, a, n in s)
    for doc, n in enumerate(lengths):
        at = 0
        for _, a, size in (u for u in used if u[0] == doc):
            assert a == at
            at += size
        assert at == n
    assert all((t := sum(n for *_, n in s)) & (t - 1) == 0 and t <= 2048 for s in sequences)
    assert len(used) < 3 * len(lengths) + sum(n // 2048 for n in lengths)


def test_step_groups_are_balanced():
    sizes = [2048] * 500 + [512] * 300 + [256] * 37
    groups = p.step_groups(sizes, 64 * 2048)
    totals = np.bincount(groups, weights=sizes)
    assert totals.max() - totals.min() <= 2048


def test_packing_shuffles_nothing(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = p.pack_documents(docs, tokenizer_path())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "mapInArrow" in plan.lower().replace("mapinarrow", "mapInArrow")
    assert p.pack_documents(docs.select(F.col("doc_id"), "text"), tokenizer_path()).count() > 0
