"""Every query over files against its SQL; a model's query, which fits trees, on the smallest tables too."""

import pytest

from kinmatch import file_queries


@pytest.mark.parametrize("name", sorted(file_queries.QUERIES))
def test_equals_sql(spark, sf_dir, same, name):
    same(file_queries.QUERIES[name](spark, sf_dir), file_queries.SQL[name])
