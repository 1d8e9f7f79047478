import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.util import SF001, edge_rows, frame
from veilframe.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


@pytest.fixture(scope="module")
def field():
    return pii.train()


def scan(field, texts):
    return [[(x["kind"], x["start"], x["end"]) for x in row] for c in pii._task(field)(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])])) for row in c[0].to_pylist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("a.@1 2+-%_0(é4\n", max_size=60), min_size=1, max_size=4))
def test_base_spans_equal_the_patterns(texts):
    field = pii.Field()
    assert [[x for x in r if x[0] in pii.KINDS] for r in scan(field, texts)] == [brute(t) for t in texts]


def test_documents_and_edge_cases(spark, field):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    rows = [*docs, *edge_rows("é a.b@c.de 10.0.0.255 4111 1111 1111 1111, +1 (415) 555-2671 999.1.1.1")]
    got = pii.scan_personal(frame(spark, rows), field=field).select(F.col("doc.c1"), "spans").collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(x) for x in r[1] if x[0] in pii.KINDS] == brute(r[0])
    assert pii.scan_personal(frame(spark, []), field=field).count() == 0


def test_the_field_adds_national_numbers_and_leaves_clean_text(field):
    found = scan(field, ["call me on (212) 555-0143 tonight", "phone: 555-123-4567.", "in 1999 and 2004 pages 12 13 14", "version 3.2.1 of 2020-05-06", "rows 1 2 3 4 5 6 7 8 9"])
    assert found[0] == [("crf_phone", 11, 25)] and found[1] == [("crf_phone", 7, 19)]
    assert found[2:] == [[], [], []]


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    field = pii.Field()
    field.p["t"] = rng.normal(0, 1, field.p["t"].shape)
    length = np.array([1, 4, 2, 3])
    run = np.cumsum(length) - length
    e = rng.normal(0, 1, (10, pii.N_LABELS))
    labels = field.viterbi(e, run, length)
    pairs = field.p["t"] + field.allowed
    for a, n in zip(run, length, strict=True):
        best = max(np.ndindex(*[pii.N_LABELS] * n), key=lambda y: pairs[0, y[0]] + sum(e[a + i, y[i]] for i in range(n)) + sum(pairs[y[i], y[i + 1]] for i in range(n - 1)) + pairs[y[-1], 0])
        assert tuple(labels[a : a + n]) == best


def test_field_learns_its_table(field):
    texts, spans = pii._table()
    tokens = pii.Tokens(pa.array(texts))
    labels = field.viterbi(field.emissions(tokens.features), tokens.run, tokens.length)
    got = {(r, a - int(tokens.offsets[r]), b - int(tokens.offsets[r]), pii.KINDS[k]) for r, a, k, b in pii._field_spans(tokens, labels)}
    want = {(r, a, b, k) for r, row in enumerate(spans) for a, b, k in row}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 2
