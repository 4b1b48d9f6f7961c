"""The feed of changes, whatever order batches come in, over restarts."""

import random
from datetime import datetime, timedelta

import pytest

from corpusloom.operators import log as lg
from corpusloom.streaming import feed
from corpusloom.streaming import log as stream

SCHEMA = "kind string, unit_id string, event_id long, ingest_time timestamp, note int, superseded_by string"


def records(rng, n):
    units = ["hot"] * 30 + [f"u{i}" for i in range(12)] + [None]
    return [(rng.choice(["insert"] * 5 + ["delete"]), rng.choice(units), i, rng.choice([None] + [datetime(2026, 1, 1) + timedelta(hours=rng.randint(0, 90))] * 12), rng.choice([None, 1]), None) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_feed_ends_at_the_current_records(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = records(rng, 240)
    rng.shuffle(rows)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    seen, before = [], spark.conf.get(feed.PROVIDER)
    for part in (rows[:100], rows[:7], rows[100:110], rows[110:]):  # some come twice
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(source)
        # one file a batch; each round goes on from the state of the one before
        feed.follow(stream.read(spark, source, SCHEMA, 1), out, mark).awaitTermination()
        seen += [r for r in part if r not in seen]
        got = spark.read.parquet(out)
        want = lg.current_events(spark.createDataFrame(seen, SCHEMA))
        inserts = lg.current(got.drop("superseded"))
        assert sorted(map(str, inserts.collect())) == sorted(map(str, want.where("kind = 'insert'").collect()))
    assert spark.conf.get(feed.PROVIDER) == before
    deletes = sorted(r["event_id"] for r in got.where("kind = 'delete'").collect())
    assert deletes == sorted(r[2] for p in (rows, rows[:7]) for r in p if r[0] == "delete")  # as they are
    chains = {}
    for r in sorted(got.where("kind = 'insert'").collect(), key=lambda r: (r["ingest_time"] is not None, r["ingest_time"], r["event_id"])):
        assert r["superseded"] == chains.get(r["unit_id"])
        chains[r["unit_id"]] = r["event_id"]
    assert set(chains) == {r[1] for r in rows if r[0] == "insert"}


def test_nothing_arrives(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    feed.follow(stream.read(spark, source, SCHEMA), out, mark).awaitTermination()
    assert spark.read.schema(SCHEMA).parquet(out).count() == 0


def test_states_are_fewer_than_units(spark, tmp_path):
    n = 3 * feed.BUCKETS
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for k in range(2):
        made = spark.range(n).selectExpr("'insert' kind", "concat('u', id) unit_id", f"id + {k * n} event_id", f"timestamp_seconds({k} + id) ingest_time", "1 note", "cast(null as string) superseded_by")
        made.write.mode("append").parquet(source)
        feed.follow(stream.read(spark, source, made.schema, 1000), out, mark).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 2 * n and got.where(f"superseded = event_id - {n}").count() == n and got.where("superseded IS NULL").count() == n
    states = spark.read.format("statestore").option("stateVarName", "current").load(mark)
    assert 0 < states.count() <= feed.BUCKETS


@pytest.mark.parametrize("kind, values", [("double", [0.0, -0.0, float("nan"), float("nan"), 1.5, None]), ("binary", [b"", b"\xff", b"\xfe", b"\xff", None, None])])
def test_units_of_other_kinds(spark, tmp_path, kind, values):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.createDataFrame([(v, i, datetime(2026, 1, 1)) for i, v in enumerate(values)], f"unit_id {kind}, event_id long, ingest_time timestamp").coalesce(1)
    for i in range(len(values)):  # one after the other
        rows.where(f"event_id = {i}").write.mode("append").parquet(source)
        feed.follow(stream.read(spark, source, rows.schema, 1), out, mark, kind=None).awaitTermination()
    got = {r["event_id"]: r["superseded"] for r in spark.read.parquet(out).collect()}
    assert got == ({0: None, 1: 0, 2: None, 3: 2, 4: None, 5: None} if kind == "double" else {0: None, 1: None, 2: None, 3: 1, 4: None, 5: 4})


def test_a_task_keeps_the_last_of_each_unit_in_bounded_room(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, f"u{i % 500}"]), rng.choice([None, rng.randint(0, 99)]), i) for i in range(6000)]
    cut = [pa.RecordBatch.from_pylist([dict(zip("nte", r)) for r in rows[i : i + 100]], pa.schema([("n", pa.string()), ("t", pa.int64()), ("e", pa.int64())])) for i in range(0, 6000, 100)]
    want = {}
    for n, t, e in rows:
        want[n] = max(want.get(n, ((False, 0), -1)), ((t is not None, t or 0), e))
    for room in (64 << 20, 20_000, 100):
        monkeypatch.setattr(feed, "HELD_BYTES", room)
        got = [r for b in feed._newest("n", "t", "e")(iter([cut[0][:0], *cut])) for r in b.to_pylist()]
        best = {}
        for r in got:
            best[r["n"]] = max(best.get(r["n"], ((False, 0), -1)), ((r["t"] is not None, r["t"] or 0), r["e"]))
        assert best == want and (room < 64 << 20 or len(got) == len(want))
