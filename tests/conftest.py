import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tlake.session import build

    s = build("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
                                     "spark.sql.maxMetadataStringLength": "2000"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture()
def lake(spark, tmp_path):
    from tlake.plans import Lake

    return Lake(spark, f"{tmp_path}/hot", f"{tmp_path}/cold").create_tables()


def rows(df):
    return [tuple(r) for r in df.collect()]
