import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veilframe.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    return local_session("*", shuffle_partitions=8, app_name="veilframe-tests")


# Age, department and diagnosis of the 15 rows that the golden results are stated for.
STAFF_GOLDEN = [
    (28, "Engineering", "Diabetes"), (34, "Marketing", "Hypertension"), (45, "Engineering", "Asthma"),
    (29, "Sales", "Diabetes"), (52, "Management", "Heart Disease"), (38, "Engineering", "Asthma"),
    (31, "Marketing", "Hypertension"), (43, "Sales", "Diabetes"), (36, "Engineering", "Cancer"),
    (27, "Marketing", "Hypertension"), (49, "Management", "Heart Disease"), (33, "Sales", "Asthma"),
    (41, "Engineering", "Diabetes"), (30, "Marketing", "Cancer"), (47, "Management", "Heart Disease"),
]
# The other columns are invented by rule.
STAFF_ROWS = [
    (i, f"Person {chr(64 + i)}", f"p{i}@staff.test", age, 40_000 + 1_700 * i + 900 * (i % 4), department,
     f"900-{i:02d}-{7000 + i}", f"070-{i:04d}", f"{i} Quay Walk", diagnosis)
    for i, (age, department, diagnosis) in enumerate(STAFF_GOLDEN, 1)
]
STAFF_SCHEMA = ("id int, name string, email string, age int, salary int, department string, ssn string, "
                "phone string, address string, diagnosis string")


@pytest.fixture(scope="session")
def staff(spark):
    return spark.createDataFrame(STAFF_ROWS, STAFF_SCHEMA)
