"""The driver contract: names, views and the flagship query."""

import re

import __spark_entry__ as entry


def test_names_and_checks():
    names = entry.queries()
    checks = entry.oracle_sql()
    assert len(names) > 220
    assert set(checks) <= set(names)


def test_checks_expand_their_views():
    for name, sql in entry.oracle_sql().items():
        for view in set(re.findall(r"(?:FROM|JOIN) (v_\w+)", sql)):
            assert f"{view} AS (" in sql, (name, view)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["atom_a_id", "atom_b_id", "relationship_type", "strength", "scope"]
    assert df.count() > 0
