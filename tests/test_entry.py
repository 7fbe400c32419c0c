import os

import __spark_entry__ as driver


def test_catalogue_and_twins_agree_on_names():
    names, sql = set(driver.queries()), set(driver.oracle_sql())
    assert sql <= names
    assert not {n for n in names - sql if n in driver.QUERIES}


def test_flagship(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        rows = driver.entry(spark)
        assert rows.columns == ["name", "k_12", "k_15", "k_18", "k_21"] and rows.count() > 0
