import __spark_entry__ as entry
from duoglot_checks.oracles import ORACLES
from duoglot_checks.queries import QUERIES


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "lang", "answer"] and df.count() == 40


def test_every_query_of_the_library_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
