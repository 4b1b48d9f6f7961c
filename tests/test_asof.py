import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import discovery
from corpusloom.operators.asof import asof


def plain(left, right, forward):
    out = []
    for i, v in left:
        fit = [(a, n) for a, n in right if v is not None and a is not None and (a >= v if forward else a <= v)]
        a, n = (min(fit) if forward else max(fit)) if fit else (None, None)
        out.append((i, v, a, n))
    return sorted(out, key=str)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("spread", [5, 60, 10_000])
def test_against_brute_force(spark, forward, spread):
    rng = random.Random(spread)
    for n, m in ((400, 60), (30, 400), (50, 1), (20, 0), (0, 5)):
        left = [(i, rng.choice([None, rng.randrange(spread), 3])) for i in range(n)]
        right = [(rng.choice([None, rng.randrange(spread)]), f"r{k}") for k in range(m)]
        a, b = spark.createDataFrame(left, "i int, v long").repartition(5), spark.createDataFrame(right, "at long, name string").repartition(3)
        for small in (0, 1000):
            got = asof(a, b, "v", "at", forward, small)
            assert got.columns == ["i", "v", "at", "name"]
            assert sorted(map(tuple, got.collect()), key=str) == plain(left, right, forward)


@pytest.mark.parametrize("small", [0, 1000])
def test_dates_doubles_and_texts(spark, small):
    days = spark.createDataFrame([(date(2025, 1, 5), 1), (date(2025, 1, 9), 2)], "d date, x int")
    asked = spark.createDataFrame([(date(2025, 1, k),) for k in (4, 5, 8, 9)], "day date")
    assert {r["day"].day: r["x"] for r in asof(asked, days, "day", "d", small=small).collect()} == {4: None, 5: 1, 8: 1, 9: 2}
    assert {r["day"].day: r["x"] for r in asof(asked, days, "day", "d", True, small).collect()} == {4: 1, 5: 1, 8: 2, 9: 2}
    mixed = asof(spark.createDataFrame([(1,), (3,)], "n int"), spark.createDataFrame([(0.5, "a"), (2.5, "b")], "at double, k string"), "n", "at", small=small)
    assert {r["n"]: r["k"] for r in mixed.collect()} == {1: "a", 3: "b"}
    texts = asof(spark.createDataFrame([("b",), ("é",)], "t string"), spark.createDataFrame([("a",), ("c",)], "at string"), "t", "at", small=small)
    assert {r["t"]: r["at"] for r in texts.collect()} == {"b": "a", "é": "c"}
    with pytest.raises(ValueError, match="both sides"):
        asof(asked, asked, "day", "day")


def test_ranges_without_rows_of_the_right_side(spark):
    """One early row of the right side serves every range; a value with most rows is spread over several."""
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    got = asof(left.repartition(4), spark.createDataFrame([(2, "two"), (4000, "late")], "at long, k string"), "v", "at", small=1)
    counts = {r["k"]: r["n"] for r in got.groupBy("k").agg(F.count("*").alias("n")).collect()}
    late = sum(1 for i in range(5000) if i % 3 and i >= 4000)
    none = sum(1 for i in range(5000) if i % 3 and i < 2)
    assert counts == {None: none, "late": late, "two": 5000 - late - none}


def test_a_long_curve(spark):
    """A curve of a million points, which isn't sent to tasks."""
    curve = spark.range(1_000_000).select(F.expr("date_add(DATE'2000-01-01', cast(id % 20000 AS int))").alias("day"), (F.col("id") % 20_000 * 1000 + F.floor(F.col("id") / 20_000)).alias("id"))
    asked = spark.range(0, 20_000_000, 1001).withColumnRenamed("id", "n")
    got = discovery.day_of(asked, "n", curve).agg(F.count("day").alias("n"), F.min("day").alias("a"), F.max("day").alias("b")).first()
    assert got["n"] == 19_981 and got["a"] == date(2000, 1, 1) and got["b"].year == 2054
