import os
import sys

import pytest

from tests.conftest import spark  # noqa: F401

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

WORDS = "alpha beta gamma delta omega kappa sigma theta iota lambda".split()


@pytest.fixture()
def rows(spark):  # noqa: F811
    """Documents from (doc_id, text) pairs, with extra columns whose names an operator may use itself."""
    def make(pairs):
        schema = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, key STRING, size STRING, digest STRING"
        data = [(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in pairs]
        return spark.createDataFrame(data, schema)
    return make
