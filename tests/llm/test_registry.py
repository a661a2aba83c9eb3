import re

import __spark_entry__ as entry

from tessera.llm.queries import QUERIES, SQL


def test_one_query_of_each_operator_and_the_pipeline():
    names = entry.queries()
    assert sorted(int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert set(SQL) <= set(QUERIES) and set(SQL) <= set(entry.oracle_sql())
