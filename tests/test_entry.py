import __spark_entry__


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {r["decision"] for r in rows} <= {"auto_reconciled", "review_required", "conflict"} and rows
