"""Intermediate tables: places in groups of any size, and what is left of the tables of a run."""

import random

import pytest

from loregraph.functions import tables


def test_places_in_groups(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.6 else r.choice("abc"), r.randint(0, 500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(7)
    want = {}
    for g in {x[0] for x in rows}:
        want |= {i: n for n, (_, i) in enumerate(sorted((k, i) for x, k, i in rows if x == g))}
    assert {x.i: x.pos for x in tables.numbered(df, ["g"], ["k", "i"]).collect()} == want
    assert tables.numbered(df.where("false"), ["g"], ["k"]).collect() == []


def test_two_results_stay_until_they_are_released(spark):
    fs, at = tables._at(spark, tables._folder(spark))
    a, b = tables.saved(spark.range(5)), tables.saved(spark.range(7))
    assert (a.count(), b.count(), a.count()) == (5, 7, 5) and fs.exists(at)
    tables.release(spark)
    assert not fs.exists(at)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.catalog.clearCache()
        a.selectExpr("sum(id)").collect()
