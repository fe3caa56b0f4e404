from __future__ import annotations

import re

import __spark_entry__ as entry
from revcast.llm.queries import collect


def test_one_query_of_each_operator_is_registered():
    queries, oracles = collect()
    numbers = [re.match(r"op(\d+)_", n) for n in queries if n != "pipeline"]
    assert sorted(int(m[1]) for m in numbers) == list(range(1, 14)) and "pipeline" in queries
    assert set(oracles) <= set(queries) and set(queries) <= set(entry.queries()) and set(oracles) <= set(entry.oracle_sql())
