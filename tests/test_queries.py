import importlib
import os

import pytest

from tests import oracle

MODULES = ["cadenza.plans.sequences", "cadenza.plans.relations", "cadenza.plans.scans", "cadenza.plans.kernels", "cadenza.plans.more", "cadenza.plans.files", "cadenza.plans.wordings", "cadenza.plans.notes", "cadenza.plans.lyrics", "cadenza.plans.rules", "cadenza.plans.media", "cadenza.plans.training_core"]
QUERIES = {name: q for m in MODULES for name, q in importlib.import_module(m).QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in importlib.import_module(m).SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    oracle.same_rows(QUERIES[name](spark, oracle.DATA), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() >= 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
