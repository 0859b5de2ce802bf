import __spark_entry__ as e


def test_names_and_sql():
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q)
    assert {f"p{n}_found" for n in (1, 2, 4, 5, 6)} <= set(q)
