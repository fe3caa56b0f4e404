from __future__ import annotations

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


def test_entry_gives_bands_for_every_platform(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["series_id", "ds", "conservative", "expected", "aggressive"]
    assert df.count() == 150
