import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "sender_tx_count" in df.columns


def test_every_oracle_has_a_query():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60
    # the optional operators are registered all together, or not at all where the subpackage is gone
    optional = [k for k in q if k.startswith("op") or k == "pipeline"]
    assert len(optional) == (14 if E._llm is not None else 0)   # thirteen operators and the pipeline
