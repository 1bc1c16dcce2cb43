"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    problem, _ = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert not problem


ELSEWHERE = {"G3_bpe_vocab"}  # its rows are compared in test_vocab.py


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - ELSEWHERE))
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "intent", "snippet"]
