"""Every registered query of the library against its SQL form, on the smallest tables; those that fold repeated keys on the next size too."""

import glob
import math
import os

import duckdb
import pytest

from pulsegrid.plans import catalogue

FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


#: Queries that sf0.01 is needed for, as keys repeat there.
REPEATED = ("feed_fire_calls", "scene_times", "unit_row_fold", "payload_outcomes")


def duck(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name, folder", [(n, FOLDERS[0]) for n in sorted(catalogue.ORACLE_SQL)] + [(n, FOLDERS[1]) for n in REPEATED])
def test_query_equals_sql(spark, name, folder):
    df = catalogue.QUERIES[name](spark, folder)
    found = duck(folder).execute(catalogue.ORACLE_SQL[name])
    assert plain(df.columns, df.collect()) == plain([d[0] for d in found.description], found.fetchall())


def test_entry_and_guard(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["type", "calls", "before"]
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
