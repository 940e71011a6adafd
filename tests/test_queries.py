"""Every registered query of the core library against its SQL."""

import pytest

from corpusmill.plans.queries import QUERIES
from corpusmill.plans.sql import ORACLE_SQL
from tests.helpers import spark_rows, sql_rows


#: Thousands of merges are beyond SQL: tests/test_bpe.py holds these against brute force.
WITHOUT_SQL = {"bpe_full_merges", "bpe_full_tokens_per_word"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(ORACLE_SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["word", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
