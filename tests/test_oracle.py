"""Every registered query against its SQL twin."""

import re
from pathlib import Path

import pytest
from check import database, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", [name for name in entry.queries() if name in entry.QUERIES])
def test_query_agrees_with_sql(spark, con, name):
    assert differences(spark, con, SF, name) is None


def test_every_twin_belongs_to_a_query():
    assert all(re.match(r"op\d+_|pipeline$", name) for name in set(entry.queries()) - set(entry.oracle_sql()))
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_no_key_like_text_in_the_repository():
    shape = re.compile(r"ghp_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}")
    for path in Path(entry.__file__).parent.rglob("*.py"):
        assert not shape.search(path.read_text(encoding="utf-8")), path
