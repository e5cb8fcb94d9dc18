import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
for p in (str(ROOT), str(ROOT / "tests"), str(ROOT / "tests/llm")):
    if p not in sys.path:
        sys.path.insert(0, p)

from cases import CLASHING, SCHEMA, odd_rows  # noqa: E402

from wonted.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", "4g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(spark, odd):
    """The same table with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("other").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def folder_of(tmp_path_factory):
    """Writes a table where a query looks for it."""

    def write(table="documents", **tables):
        folder = str(tmp_path_factory.mktemp("tables"))
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write
