import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.util import SF001, edge_rows, frame
from veilframe.llm import lang_id as x


@pytest.fixture(scope="module")
def model():
    en = ["the cat and the dog are in the house of the man", "this is what they said when it was there"] * 20
    de = ["die katze und der hund sind in dem haus des mannes", "das ist was sie sagten als es dort war"] * 20
    return x.train(en + de, ["en"] * 40 + ["de"] * 40, steps=80)


def test_held_out_accuracy_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = x.identify(docs, x.fit(docs)).select(x.held_out(F.col("doc.c0")).alias("h"), (F.col("doc.c2") == F.col("lang_pred")).alias("ok"), F.col("doc.c2").alias("lang")).where("lang is not null").collect()
    held = [r.ok for r in out if r.h]
    assert len(held) > 20 and np.mean(held) > 0.9


def test_gradients_are_those_of_the_loss():
    model = x.Model(["a", "b", "c"], 1)
    batch, _ = x.chunks(pa.array(["some bytes here", "ü" * 70]))
    y = np.array([0, 2, 1, 1])

    def loss():
        p = model.positions(batch)
        inside = batch.T != x.PAD
        return float(-np.log(p[:, np.arange(4), y][inside].astype(np.float64)).mean())

    grads = model.gradients(batch, y)
    for name, index in (("U", (0, 2, 5)), ("U", (1, 1, 17)), ("bytes", (0, ord("e"), 3)), ("bytes", (1, x.PAD, 9)), ("W", (4, 1)), ("b", (2,))):
        old = model.p[name][index]
        model.p[name][index] = old + 1e-2
        up = loss()
        model.p[name][index] = old - 1e-2
        down = loss()
        model.p[name][index] = old
        assert abs((up - down) / 2e-2 - grads[name][index]) < 2e-3


def test_edge_cases(spark, model):
    rows = [*edge_rows("the cat and the dog"), (8, "12 34 ²"), (9, "und die katze")]
    out = x.identify(frame(spark, rows), model).select(F.col("doc.c0").alias("id"), "lang_pred", "score").collect()
    by = {r.id: r for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 4, 8))
    assert by[3].lang_pred == "en" and by[5].lang_pred == "en" and by[9].lang_pred == "de"
    assert x.identify(frame(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "text"), (2, None)], extra=["lang"]).withColumn("lang", F.lit(None).cast("string"))
    assert x.fit(docs) is None
    assert {r.lang_pred for r in x.identify(docs, None).collect()} == {"und"}


def test_every_position_is_pooled(model):
    """A text's result is the mean over all its bytes, not over its beginning."""
    texts = ["the cat and the dog are in the house " * 20 + "die katze und der hund sind in dem haus " * 60]
    whole = model.pooled(pa.array(texts))[0]
    assert whole[model.languages.index("de")] > 0.55


def test_a_sample_far_below_the_rows_leaves_no_language_out(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 40).alias("lang"))
    assert {lang for _, lang in x.training_rows(docs, sample=4)} == {f"l{i}" for i in range(40)}
    hot = spark.range(1_500_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    assert 0 < len(x.training_rows(hot, sample=1)) < 10
