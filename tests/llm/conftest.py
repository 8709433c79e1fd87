import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import CLASH, EDGE  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string").selectExpr("*", *[f"'{c}' as {c}" for c in CLASH]).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
