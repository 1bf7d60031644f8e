import __spark_entry__ as driver
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "documents labels pages benchmark conversations events"
OWN = driver._own.QUERIES


def test_entry_and_names(spark):
    assert driver.entry(spark).columns == ["source_id", "recommendation", "n_items"]
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", ["triage_by_source", "history_profile", "editorial_decisions", "source_health", "new_entries", "sentence_scores", "public_listing", "rolling_source_outcomes"])
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = OWN[name](spark, SF)
    r = c.execute(driver.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(x) for x in df.columns]
    plain = lambda v: round(v, 5) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    assert sorted(repr([plain(v) for v in x]) for x in df.collect()) == sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())
