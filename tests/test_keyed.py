import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import keyed


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(spark, root):
    return {r["path"]: r["sha256"] for r in keyed.index(spark, root).collect()}


def test_batches_against_a_dictionary(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path / "t")
    now = {k: f"v{k}" for k in range(0, 4000, 2)}
    schema = "k long, v string"
    keyed.create(spark.createDataFrame(list(now.items()), schema).repartition(5), root, "k", file_rows=200)
    assert rows(keyed.read(spark, root)) == sorted(now.items(), key=str) and len(files(spark, root)) == 10
    seen = files(spark, root)
    for keys, gone in (([*range(500, 560)], []), ([-5, -4, 9_000, 9_001], [2, 4, 777]), (rng.sample(range(3900, 3999), 30), []), ([], [0, 3998]), ([1, 3], []), ([], [12_345])):
        batch = {k: f"new{k}-{rng.random()}" for k in keys}
        did = keyed.upsert(spark, root, spark.createDataFrame(list(batch.items()), schema), "k", spark.createDataFrame([(k,) for k in gone], "k long") if gone else None, file_rows=200)
        held = {p for p, lo, hi in ((r["path"], r["lo"], r["hi"]) for r in keyed.index(spark, root).collect()) if p in seen}
        owners = {k for k in [*batch, *gone] if k in now}
        for k in gone:
            now.pop(k, None)
        now |= batch
        assert rows(keyed.read(spark, root)) == sorted(now.items(), key=str)
        after = files(spark, root)
        kept = {p: s for p, s in after.items() if p in seen}
        # files without a changed key keep their names and bytes
        assert kept == {p: seen[p] for p in kept} and len(seen) - len(kept) <= len(owners) and len(held) == len(kept)
        assert did["read"] <= 4 and did["files"] == len(seen)
        if not owners:
            assert len(kept) == len(seen)
        seen = after


def test_filters_know_their_keys_and_few_others(spark, tmp_path):
    root = str(tmp_path / "t")
    keyed.create(spark.range(0, 20_000, 2).select(F.concat(F.lit("key-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("k"), "id"), root, "k", file_rows=2500)
    every = spark.range(0, 20_000).select(F.concat(F.lit("key-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("k"), (F.col("id") % 2 == 0).alias("there"))
    found = keyed.holding(spark, root, every, "k").join(every.withColumnRenamed("k", "key"), "key").groupBy("there").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")).collect()
    n = {r["there"]: (r["n"], r["keys"]) for r in found}
    assert n[True] == (10_000, 10_000) and n.get(False, (0, 0))[0] < 250


def test_a_run_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    keyed.create(spark.createDataFrame([(i, "a") for i in range(20)], "k int, v string"), root, "k", file_rows=5)
    before = rows(keyed.read(spark, root))
    with monkeypatch.context() as m:
        m.setattr(keyed.sinks, "replace", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            keyed.upsert(spark, root, spark.createDataFrame([(3, "b")], "k int, v string"), "k")
    assert rows(keyed.read(spark, root)) == before
    keyed.upsert(spark, root, spark.createDataFrame([(3, "b")], "k int, v string"), "k")
    assert (3, "b") in rows(keyed.read(spark, root)) and keyed.read(spark, root).count() == 20


def test_equal_to_reconcile(spark, tmp_path):
    """Renamed rows that win over those of the key, as ``parts.reconcile`` has it."""
    from corpusloom.operators import parts

    root = str(tmp_path / "t")
    table = spark.createDataFrame([(f"k{i:03}", i) for i in range(60)], "k string, n int")
    remap = spark.createDataFrame([("k010", "k020"), ("k030", "x")], "old string, new string")
    keep = table.select("k").where("k <> 'k010' AND k <> 'k030'").unionByName(spark.createDataFrame([("x",)], "k string"))
    keyed.create(table, root, "k", file_rows=10)
    named = table.join(remap, F.col("k") == F.col("old")).select(F.col("new").alias("k"), "n")
    did = keyed.upsert(spark, root, named, "k", remap.select(F.col("old").alias("k")))
    assert rows(keyed.read(spark, root)) == rows(parts.reconcile(table, "k", keep, remap)) and did["read"] < did["files"]
