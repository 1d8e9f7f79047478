"""Plan checks over every registered batch query of the catalog."""

import re

import pytest

import __spark_entry__ as E
from veilframe.plans import catalog, catalog_cases

SF = "/root/testdata/sf0.001"
ALLOWED_PARENTS = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject",
                   "GlobalLimit", "CollectLimit")
BATCH = [k for k in [*catalog.QUERIES, *catalog_cases.QUERIES] if not k.startswith("stream_")]


def _tree(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def _depth(line):
    return len(line) - len(line.lstrip(" :+-"))


@pytest.mark.parametrize("name", BATCH)
def test_single_partition_exchanges_only_feed_one_row_operators(spark, name):
    lines = _tree(E.queries()[name](spark, SF))
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        d = _depth(line)
        parent = next((lines[j] for j in range(i - 1, -1, -1) if _depth(lines[j]) < d), "")
        assert any(p in parent for p in ALLOWED_PARENTS), (name, parent.strip(), line.strip())


@pytest.mark.parametrize("name", BATCH)
def test_no_row_at_a_time_python(spark, name):
    plan = "\n".join(_tree(E.queries()[name](spark, SF)))
    assert not re.search(r"BatchEvalPython|PythonUDF", plan), name
