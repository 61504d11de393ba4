import pytest

from quillmill.plans import catalogue


MAY_BE_EMPTY = {"vocab_missing_anti"}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, same_rows, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    assert len(got) or name in MAY_BE_EMPTY
    if name in catalogue.oracle_sql():
        want = duck.sql(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert same_rows(got) == same_rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
