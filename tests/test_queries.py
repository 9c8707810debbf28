"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import subprocess
import sys

import oracle
import pytest
from conftest import ROOT, SMALL

from streamgrid.plans import catalog


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SMALL)
    assert oracle.differences(df, con, catalog.SQL[name]) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_queries_remain_without_the_libraries_of_others():
    code = """
import sys, warnings
sys.modules.update(dict.fromkeys(["ahocorasick", "tokenizers", "public_tokenizers"]))
warnings.simplefilter("ignore")
import __spark_entry__ as entry
from streamgrid.plans import catalog
assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.SQL)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
