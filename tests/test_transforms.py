import base64
import hashlib
import hmac
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions.generalize import generalize_age, generalize_numeric, python_round
from veilframe.functions.masking import hmac_pseudonym, mask, null_out, salted_hash
from veilframe.functions.noise import add_gaussian, add_laplace, gaussian_sigma
from veilframe.functions.substitute import substitute
from veilframe.functions.permute import Permutation
from veilframe.operators.shuffle import dense_index, shuffle_column, shuffle_columns


def one(spark, value, ddl, expr):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("r")).first()["r"]


def test_mask_keeps_suffix_and_length(spark):
    r = one(spark, "john.doe@email.com", "v string", mask("v"))
    assert r.endswith(".com") and "*" in r and len(r) == len("john.doe@email.com")
    r = one(spark, "john.doe@email.com", "v string", mask("v", mask_char="#"))
    assert r.endswith(".com") and "#" in r
    assert one(spark, "", "v string", mask("v")) == ""
    assert one(spark, "abc", "v string", mask("v")) == "***"
    assert one(spark, "secret", "v string", mask("v", 0)) == "******"  # keep_last=0 masks all
    assert one(spark, None, "v string", mask("v")) is None


def test_null_keeps_type(spark):
    df = spark.createDataFrame([(1.5,)], "v double").select(null_out("v", spark.createDataFrame([(1.5,)], "v double").schema["v"].dataType).alias("r"))
    assert df.schema["r"].dataType.typeName() == "double"
    assert df.first()["r"] is None


def test_hash_and_hmac_match_python(spark):
    key = b"secret_key"
    vals = ["123-45-6789", "value1", "value2", "héllo", ""]
    df = spark.createDataFrame([(v,) for v in vals], "v string").select(
        "v", salted_hash("v", "test_salt").alias("h"), hmac_pseudonym("v", key).alias("p"),
        hmac_pseudonym("v", key, 20).alias("p20"))
    for r in df.collect():
        assert r.h == hashlib.sha256(("test_salt" + r.v).encode()).hexdigest()
        tag = hmac.new(key, r.v.encode(), hashlib.sha256).digest()
        full = base64.urlsafe_b64encode(tag).decode().rstrip("=")
        assert r.p == full[:12] and r.p20 == full[:20]
    rows = {r.v: r for r in df.collect()}
    assert rows["value1"].h != rows["value2"].h


def test_hmac_long_output_drops_padding(spark):
    key = b"secret_key"
    vals = ["a", "b+/", "x" * 100]
    df = spark.createDataFrame([(v,) for v in vals], "v string").select("v", hmac_pseudonym("v", key, 60).alias("p"))
    for r in df.collect():
        full = base64.urlsafe_b64encode(hmac.new(key, r.v.encode(), hashlib.sha256).digest()).decode().rstrip("=")
        assert r.p == full[:60] and "=" not in r.p and len(r.p) == 43


def test_hmac_of_integers_uses_their_text(spark):
    key = b"k"
    r = one(spark, 29, "v int", hmac_pseudonym("v", key))
    assert r == base64.urlsafe_b64encode(hmac.new(key, b"29", hashlib.sha256).digest()).decode().rstrip("=")[:12]


def test_generalize_age_reference_cases(spark):
    bins = [0, 20, 30, 40, 50, 120]
    df = spark.createDataFrame([(25,), (45,), (8,), (-1,), (120,), (None,)], "a int")
    out = [r["g"] for r in df.select(generalize_age("a", bins).alias("g")).collect()]
    assert out == ["20-29", "40-49", "0-19", "<0", ">=120", None]
    default = [r["g"] for r in df.select(generalize_age("a").alias("g")).collect()]
    assert default == ["18-29", "45-64", "0-17", "<0", ">=120", None]


def test_generalize_age_strings_and_floats(spark):
    df = spark.createDataFrame([("25",), ("abc",), (" 31 ",)], "a string")
    out = [r["g"] for r in df.select(generalize_age("a", dtype=df.schema["a"].dataType).alias("g")).collect()]
    assert out == ["18-29", None, "30-44"]
    keep = [r["g"] for r in df.select(generalize_age("a", dtype=df.schema["a"].dataType, on_invalid="keep").alias("g")).collect()]
    assert keep[1] == "abc"
    f = spark.createDataFrame([(29.9,), (-0.5,)], "a double")
    assert [r["g"] for r in f.select(generalize_age("a").alias("g")).collect()] == ["18-29", "0-17"]


def test_generalize_numeric_reference_cases(spark):
    r = spark.createDataFrame([(55555.55,)], "x double").select(
        generalize_numeric("x", 0).alias("a"), generalize_numeric("x", 1).alias("b"),
        generalize_numeric("x", 2).alias("c")).first()
    assert (r.a, r.b, r.c) == (55555.0, 55555.6, 55555.55)
    assert one(spark, -2.7, "x double", generalize_numeric("x", 0)) == -2.0  # toward zero
    assert one(spark, 2.675, "x double", generalize_numeric("x", 2)) == round(2.675, 2)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e12, max_value=1e12), min_size=1, max_size=40),
       st.integers(min_value=-3, max_value=6))
def test_python_round_matches_python(spark, xs, p):
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", python_round("x", p).alias("r"))
    for row in df.collect():
        exp = round(row.x, p)
        assert row.r == exp or (row.r == 0 and exp == 0), (row.x, p, row.r, exp)


def test_substitute_shapes(spark):
    df = spark.createDataFrame([("John Smith",), ("x",), (None,)], "v string")
    types = ["name", "email", "phone", "address", "company", "ssn", "credit_card", "date", "city", "country",
             "zipcode", "url", "ip", "text", "unknown"]
    out = df.select(*[substitute("v", t, "random", 7).alias(t) for t in types]).collect()
    for r in out[:2]:
        assert r["name"] != "John Smith" and " " in r["name"]
        assert "@" in r["email"]
        assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", r["ssn"])
        assert re.fullmatch(r"\d{5}", r["zipcode"])
        assert re.fullmatch(r"\d{4}-\d{2}-\d{2}", r["date"])
        assert r["url"].startswith("https://") and r["url"].endswith("/")
        assert all(0 <= int(p) <= 255 for p in r["ip"].split("."))
        digits = [int(c) for c in r["credit_card"]]
        assert len(digits) == 16
        total = sum(d if i % 2 == 0 else (d * 2 - 9 if d * 2 > 9 else d * 2) for i, d in enumerate(reversed(digits)))
        assert total % 10 == 0  # Luhn
        assert r["text"].endswith(".") and r["unknown"]
    assert all(out[2][t] is None for t in types)


def test_substitute_consistent_is_deterministic(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "v string").select(substitute("v", "name", "consistent", 1).alias("s"))
    r = [x.s for x in df.collect()]
    assert r[0] == r[1]


def test_laplace_moments(spark):
    b = 2.0
    df = spark.range(200_000).select(add_laplace(F.lit(0.0), epsilon=1.0, sensitivity=b, seed=11).alias("n"))
    m = df.agg(F.avg("n").alias("mean"), F.stddev("n").alias("sd"), F.min("n").alias("lo")).first()
    assert abs(m.mean) < 0.05
    assert abs(m.sd - math.sqrt(2) * b) < 0.05
    assert m.lo != 0.0


def test_laplace_noise_is_nonzero_and_nulls_stay(spark):
    df = spark.createDataFrame([(50000.0,), (60000.0,), (70000.0,), (None,)], "v double")
    out = df.select("v", add_laplace("v", 1.0, 1.0, seed=3).alias("n")).collect()
    assert all(r.n != r.v for r in out[:3])
    assert out[3].n is None


def test_gaussian_sigma_and_moments(spark):
    sigma = gaussian_sigma(1.0, 1e-5, 1.0)
    assert abs(sigma - math.sqrt(2 * math.log(1.25 / 1e-5))) < 1e-12
    df = spark.range(100_000).select(add_gaussian(F.lit(0.0), 1.0, 1e-5, 1.0, seed=5).alias("n"))
    sd = df.agg(F.stddev("n")).first()[0]
    assert abs(sd - sigma) / sigma < 0.02


def test_shuffle_preserves_multiset_and_rows(spark):
    rows = [(i, f"name{i}", float(i * 10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, name string, v double").repartition(7)
    out = shuffle_column(df, "v", seed=9).collect()
    assert len(out) == 2000
    assert sorted(r.v for r in out) == sorted(r[2] for r in rows)
    assert sorted((r.id, r.name) for r in out) == sorted((r[0], r[1]) for r in rows)
    moved = sum(1 for r in out if r.v != r.id * 10.0)
    assert moved > 1900


def test_shuffle_small_and_empty(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)], "id int, v int")
    out = shuffle_columns(df, ["v"], seed=1).collect()
    assert sorted(r.v for r in out) == [1, 2, 3, 4, 5]
    empty = spark.createDataFrame([], "id int, v int")
    assert shuffle_column(empty, "v", seed=1).count() == 0


def test_shuffle_with_a_key_follows_the_permutations(spark):
    """Each column moves by its own bijection of the places in key order, whatever the partitioning; NULL values move too."""
    rows = [(i * 3, f"k{i % 2}", float(i) if i % 5 else None, f"t{i}") for i in range(701)]
    df = spark.createDataFrame(rows, "a int, b string, v double, w string")
    got = {(r.a, r.b): (r.v, r.w) for r in shuffle_columns(df.repartition(7), ["v", "w"], 5, ["a", "b"]).collect()}
    again = {(r.a, r.b): (r.v, r.w) for r in shuffle_columns(df.repartition(2), ["v", "w"], 5, ["a", "b"]).collect()}
    expected = {}
    for column, at in (("v", 2), ("w", 3)):
        permutation = Permutation(len(rows), 5, column)
        for i, row in enumerate(rows):
            expected.setdefault(permutation.apply(i), {})[column] = row[at]
    assert got == again == {rows[p][:2]: (x["v"], x["w"]) for p, x in expected.items()}
    assert sum(v[1] != r[3] for v, r in zip((got[r[:2]] for r in rows), rows)) > 600


def test_shuffle_refuses_a_key_that_does_not_tell_rows_apart(spark):
    for rows in ([(1, 1), (1, 2)], [(None, 1), (2, 2)]):
        with pytest.raises(ValueError, match="unique"):
            shuffle_columns(spark.createDataFrame(rows, "k int, v int"), ["v"], 1, ["k"])
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError, match="key column"):
        shuffle_columns(df, ["k"], 1, ["k"])
    with pytest.raises(ValueError, match="not found"):
        shuffle_columns(df, ["x"], 1)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 10, 97, 100, 101, 1000, 4099])
def test_permutation_is_a_bijection(spark, n):
    permutation = Permutation(n, 3, "c")
    assert sorted(permutation.apply(i) for i in range(n)) == list(range(n))
    if n in (5, 101, 4099):
        got = permutation.place(spark.range(n), "id", "p").collect()
        assert {r.id: r.p for r in got} == {i: permutation.apply(i) for i in range(n)}


def test_permutations_are_spread_evenly():
    """Over seeds, a place is as likely to get a number from one tenth as from another, and columns differ."""
    tenths = [0] * 10
    for seed in range(400):
        tenths[Permutation(1000, seed, "c").apply(123) // 100] += 1
    assert min(tenths) > 20 and max(tenths) < 62
    assert [Permutation(50, 1, "a").apply(i) for i in range(50)] != [Permutation(50, 1, "b").apply(i) for i in range(50)]


def test_dense_index_is_dense(spark):
    df = spark.range(0, 1234, numPartitions=5)
    out, n = dense_index(df)
    idx = sorted(r._idx for r in out.collect())
    assert n == 1234 and idx == list(range(1234))


def test_random_transforms_change_values_per_cell(spark):
    random.seed(0)
    df = spark.createDataFrame([("same",)] * 50, "v string").select(substitute("v", "name", "random", 3).alias("s"))
    assert len({r.s for r in df.collect()}) > 5


def test_text_inputs_do_not_fail_under_ansi(spark):
    df = spark.createDataFrame([("12.55",), ("abc",), ("99999999999999999999",)], "v string")
    r = df.select(generalize_numeric("v", 1).alias("n"), add_laplace("v", 1.0, 1.0, 1).alias("l"),
                  generalize_age("v", dtype=df.schema["v"].dataType).alias("a")).collect()
    assert r[0].n == 12.6 and r[1].n is None and r[1].l is None
    assert [x.a for x in r] == [None, None, None]
