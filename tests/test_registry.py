import __spark_entry__ as entry
from tabsight.plans import registry


def test_oracle_keys_are_registered_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70 and all(callable(f) for f in q.values())
    assert all(isinstance(s, str) and s.strip() for s in o.values())
    # the corpus queries come from their own folder only; the rest is registered without it
    assert not any(k.startswith("op") and k[2:3].isdigit() for k in registry.queries())
    assert set(registry.queries()) <= set(q)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    cols = df.columns
    rows = df.collect()
    assert len(rows) == 6 and cols[:4] == ["column", "ordinal", "dtype", "semantic_type"]
    assert {r["semantic_type"] for r in rows} <= {"constant", "id", "datetime", "numeric", "categorical"}
