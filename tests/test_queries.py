"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest
from compare import compare

import __spark_entry__ as entry
from modlake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert compare(spark, SF, name, QUERIES[name], ORACLES[name]) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_vector_is_scored(spark):
    ids = lambda df: sorted(r.vec_id for r in df.select("vec_id").collect())
    assert ids(QUERIES["m14_m17_logistic_regression"](spark, SF)) == ids(spark.read.parquet(f"{SF}/embeddings.parquet"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
