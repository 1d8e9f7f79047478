"""Small inputs that the operators' tests share."""

import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


#: Columns that clash with names the operators use themselves.
CLASH = ["doc", "c0", "spans", "score", "row", "node", "slot"]


def frame(spark, rows, key="doc_id", extra=CLASH):
    """Rows of (id, text) with extra columns of clashing names."""
    schema = StructType([StructField(key, LongType()), StructField("text", StringType()), *[StructField(c, StringType()) for c in extra]])
    return spark.createDataFrame([(i, t, *[f"x{i}"] * len(extra)) for i, t in rows], schema)


def edge_rows(sample):
    """Null and empty texts, a null id, repeated rows, punctuation only and a very long text."""
    return [(1, None), (2, ""), (None, sample), (3, sample), (3, sample), (4, "... --- !!!"), (5, (sample + " ") * 3000), (6, "é" * 5000), (7, "word")]
