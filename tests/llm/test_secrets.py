import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import SF001, edge_rows, frame
from veilframe.llm import secrets as s

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(s.BASE_KINDS[k], a, b) for a, k, b in sorted(spans)]


def scan(spark, rows, **options):
    out = s.scan_secrets(frame(spark, rows), **options).select(F.col("doc.c0"), F.col("doc.c1"), "spans").collect()
    return [(r[0], r[1], [tuple(x) for x in r[2]]) for r in out]


SAMPLE = "é Password = 'hunter2secret' token: token: abcdefgh AKIAABCDEFGHIJKL x api_key:aaaa toſen=abcdefgh1 secret=" + "0a" * 20


def test_base_spans_equal_the_patterns(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    for _, text, spans in scan(spark, [*docs, *edge_rows(SAMPLE)]):
        assert [x for x in spans if x[0] != "random"] == brute(text)


def test_empty_table(spark):
    assert scan(spark, []) == []


def test_random_tokens_are_found_and_structured_ones_are_not(spark):
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    tokens = ["".join(rng.choices(letters, k=40)) for _ in range(200)]
    names = [f"some-long-identifier-of-a-page-number-{i % 10}{i // 10}" for i in range(200)]
    found = scan(spark, [(i, f"a {t} b {n}") for i, (t, n) in enumerate(zip(tokens, names, strict=True))])
    hits = sum(("random", 2, 42) in spans for *_, spans in found)
    others = sum(len(spans) - (("random", 2, 42) in spans) for *_, spans in found)
    assert hits >= 185 and others <= 10


def test_random_spans_never_overlap_base_ones(spark):
    for _, text, spans in scan(spark, [(i, f"token={random.Random(i).randbytes(30).hex()}") for i in range(60)]):
        assert not [x for x in spans if x[0] == "random"] and spans


def test_p_values_are_uniform_for_random_tokens():
    rng = np.random.default_rng(0)
    p = np.array([s.battery_p(rng.integers(0, 16, 64), 16) for _ in range(2000)])
    assert abs(p.mean() - 0.5) < 0.04 and abs((p < 0.1).mean() - 0.1) < 0.04
    assert s.battery_p(np.arange(64) % 16, 16) < 1e-6


@pytest.mark.parametrize("text", ["token = abcdefgh1 rest", "é password: 0123456789abcdef0123456789abcdef0123 end", "none", None, ""])
def test_redaction_removes_every_span(spark, text):
    docs = frame(spark, [(1, text)], extra=["n_chars", "spans"])
    row = s.redact_secrets(docs, length=None).first()
    assert row.doc_id == 1 and row.spans == "x1"
    want = text
    for _, a, b in sorted(brute(text), key=lambda x: -x[1])[-1:] if brute(text) else []:
        want = text[:a] + "[SECRET]" + text[max(e for _, _, e in brute(text)) :]
    assert row.text == want
