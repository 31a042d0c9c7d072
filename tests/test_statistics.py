import random

import pytest
from pyspark.sql import Window, functions as F

from tablestory.operators import ordering as O, statistics as ST


def test_chi_square(spark):
    df = spark.createDataFrame([(3.84, 1), (7.0, 1), (0.0, 1), (50.0, 0)], "s double, d int")
    found = [r.t for r in df.select(ST.chi_square_significant(F.col("s"), F.col("d")).alias("t")).collect()]
    assert found == [False, True, False, False]


@pytest.mark.parametrize("groups, significant", [([(80, 100), (20, 100)], True), ([(52, 100), (48, 100)], False), ([(0, 100), (0, 100)], False)])
def test_rate_difference(spark, groups, significant):
    row = ST.rate_difference(spark.createDataFrame(groups, "yes int, total int")).first()
    assert row.significant is significant
    if significant:
        assert row.cramers_v == pytest.approx(0.6)


@pytest.mark.parametrize("groups, significant", [([[1, 2, 3, 2, 1, 2], [11, 12, 13, 12, 11, 12]], True), ([[1, 5, 3, 7, 2, 6], [2, 6, 3, 5, 1, 7]], False)])
def test_mean_difference(spark, groups, significant):
    df = spark.createDataFrame([(str(i), float(v)) for i, g in enumerate(groups) for v in g], "g string, v double")
    assert ST.mean_difference(ST.group_moments(df, ["g"], F.col("v"))).first().significant is significant


def test_mean_difference_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    row = ST.mean_difference(ST.group_moments(df, ["g"], F.col("v"))).first()
    assert row.significant and row.eta_squared == 1.0
    same = df.withColumn("v", F.lit(3.0))
    assert not ST.mean_difference(ST.group_moments(same, ["g"], F.col("v"))).first().significant


def test_pearson_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0), (4.0, None, 5.0)], "x double, y double, k double")
    row = df.agg(ST.pearson(F.col("x"), F.col("y")).alias("r"), ST.pearson(F.col("x"), F.col("k")).alias("c")).first()
    assert row.r == pytest.approx(1.0) and row.c == 0.0
    assert df.limit(2).agg(ST.pearson(F.col("x"), F.col("y")).alias("r")).first().r == 0.0


def test_quantiles_by_brackets(spark):
    random.seed(3)
    values = [random.choice([7.0] * 40 + [random.gauss(0, 50) for _ in range(60)]) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    ordered = sorted(values)
    ranks = [0, 1, 999, 2000, 2001, 3998, 3999]
    assert ST._order_statistics(df, len(values), ranks, limit=20) == {k: ordered[k] for k in ranks}
    assert ST.quantiles(df, "v", [0.5])[0] == pytest.approx((ordered[1999] + ordered[2000]) / 2)


def _events(spark, n=3000):
    """One key holds more than a third of the rows."""
    random.seed(5)
    rows = [(i, "hot" if random.random() < 0.4 else f"k{random.randint(0, 50)}", random.random() if random.random() < 0.8 else None) for i in range(n)]
    random.shuffle(rows)
    return spark.createDataFrame(rows, "i int, k string, v double").repartition(7)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_values_match_a_plain_window(spark, keys):
    df = _events(spark)
    v = F.col("v")
    made = O.running(df, ["i"], {
        "s": O.Running("sum", v), "c": O.Running("count", v, before=True), "hi": O.Running("max", v, before=True),
        "lo": O.Running("min", v), "first": O.Running("first", v), "last": O.Running("last", v, before=True),
    }, keys, ranges=16)
    w = Window.partitionBy(*keys).orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    wanted = df.select(
        "i", "k", "v", F.sum(v).over(upto).alias("s"), F.count(v).over(before).alias("c"), F.max(v).over(before).alias("hi"),
        F.min(v).over(upto).alias("lo"), F.first(v, True).over(upto).alias("first"), F.last(v, True).over(before).alias("last"),
    )
    key = lambda r: r.i
    for a, b in zip(sorted(made.collect(), key=key), sorted(wanted.collect(), key=key)):
        for c in wanted.columns:
            assert a[c] == pytest.approx(b[c]) if isinstance(b[c], float) else a[c] == b[c], (c, a, b)


def test_many_ranges_use_the_block_lookup(spark, monkeypatch):
    monkeypatch.setattr(O, "_TREE_LIMIT", 4)
    df = _events(spark, 800)
    numbered = O.row_index(df, ["k", "i"])
    wanted = df.select("i", (F.row_number().over(Window.orderBy("k", "i")) - 1).alias("w"))
    assert numbered.join(wanted, "i").where("row_index <> w").count() == 0


def test_row_order_does_not_depend_on_partitions(spark):
    df = _events(spark, 1000)
    one = ST.lag1_corr(df.coalesce(1), ["v"], ["i"]).first().r
    assert ST.lag1_corr(df.repartition(13), ["v"], ["i"]).first().r == pytest.approx(one)
