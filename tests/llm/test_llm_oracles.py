import sys
from pathlib import Path

import pytest

from fathomline.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.01")
