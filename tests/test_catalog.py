"""Every query of the catalogue against its SQL, over whole tables."""

import pytest
from compare import same, sql

from touchline.plans import CATALOG, VIEWS

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(CATALOG))
def test_rows_as_sql(spark, name):
    query = CATALOG[name]
    got = query.run(spark, FOLDER)
    assert got.columns == [c for c, _ in query._columns()]
    rows = got.toArrow().to_pylist()
    if text := query.oracle(VIEWS):
        same(rows, sql(text, FOLDER))


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    first, again = e.entry(spark), e.entry(spark)
    assert first.schema == again.schema and first.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
