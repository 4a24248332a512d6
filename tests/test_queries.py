"""Every registered query against its check SQL; those without one must run and keep their shape."""

import pytest

from quillspark import catalog

#: Results that may be empty on the smallest tables.
MAY_BE_EMPTY = {"random_pivot"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, data, compare):
    df = catalog.QUERIES[name](spark, data)
    if name in catalog.ORACLE_SQL:
        compare(df, catalog.ORACLE_SQL[name])
    else:
        assert df.columns and df.limit(1).count() == 1


def test_entry_points(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert set(catalog.QUERIES) <= set(names)
    assert set(e.oracle_sql()) <= set(names)
    assert e.entry(spark).columns == ["id", "book_id", "page_number", "title", "similarity"]


def test_search_plan_prunes_and_bounds(spark, data, capsys):
    """The similarity search reads only the columns it needs and keeps the best rows of each task."""
    catalog.QUERIES["chunk_similarity_topk"](spark, data).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan
    assert not any("text" in line for line in plan.splitlines() if line.startswith("ReadSchema"))
