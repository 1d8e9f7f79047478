from veilframe.functions.generalize import generalize_age, generalize_qi_string
from veilframe.functions.masking import hmac_pseudonym, mask, salted_hash
from veilframe.functions.sql import register_sql_functions


def test_sql_functions_match_column_versions(spark):
    key = b"sql-key"
    names = register_sql_functions(spark, hmac_key=key)
    assert set(names) == {"veil_mask", "veil_hash", "veil_round", "veil_hmac", "veil_age", "veil_generalize_string"}
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    df.createOrReplaceTempView("cust")
    got = spark.sql("""SELECT c_custkey, veil_mask(c_name, 4, '*') AS m, veil_mask(c_name, 0, '#') AS m0,
                              veil_hash(c_name, 's') AS h, veil_hmac(c_name, 12) AS p,
                              veil_age(c_nationkey) AS a, veil_generalize_string(c_mktsegment, 2) AS g FROM cust""")
    exp = df.select("c_custkey", mask("c_name").alias("m"), mask("c_name", 0, "#").alias("m0"),
                    salted_hash("c_name", "s").alias("h"), hmac_pseudonym("c_name", key).alias("p"),
                    generalize_age("c_nationkey", dtype=df.schema["c_nationkey"].dataType).alias("a"),
                    generalize_qi_string("c_mktsegment", 2).alias("g"))
    assert sorted(got.collect()) == sorted(exp.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_sql_round_matches_python(spark):
    import random
    register_sql_functions(spark)
    rnd = random.Random(3)
    vals = [123.45, 2.675, 0.125, 1.005, 55555.55, -2.5, 450359962737.46875, float("nan")]
    vals += [round(rnd.uniform(-1e5, 1e5), rnd.randint(0, 4)) for _ in range(400)]
    vals += [((rnd.randint(2**52, 2**53 - 1) + 0.5) / 10 ** p) for p in (1, 3) for _ in range(50)]
    spark.createDataFrame([(v,) for v in vals], "x double").createOrReplaceTempView("nums")
    ps = [-2, 0, 1, 2, 4]
    rows = spark.sql("SELECT x, " + ", ".join(f"veil_round(x, {p}) AS r{i}" for i, p in enumerate(ps)) +
                     " FROM nums").collect()
    for r in rows:
        for i, p in enumerate(ps):
            exp, got = round(r.x, p), r[f"r{i}"]
            assert got == exp or (got != got and exp != exp) or (got == 0 and exp == 0), (r.x, p, got, exp)
