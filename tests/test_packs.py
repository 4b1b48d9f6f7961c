import hashlib
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import packs


def sha(x):
    return hashlib.sha256(x).hexdigest()


def stored(root):
    return sum(f.stat().st_size for f in os.scandir(f"{root}/packs"))


def test_objects_are_stored_once_and_read_by_hash(spark, tmp_path):
    rng, root = random.Random(2), str(tmp_path / "o")
    bodies = [rng.randbytes(rng.choice([1, 30, 2000])) for _ in range(150)] + [b"", "é".encode() * 50_000]
    df = spark.createDataFrame([(b,) for b in bodies * 3] + [(None,)], "c binary").repartition(6)
    assert packs.index(spark, root).count() == 0
    assert packs.add(df, root, "c", most=20_000) == len(set(bodies))
    size, names = stored(root), os.listdir(f"{root}/packs")
    assert len(names) > 4
    # what is there isn't written again
    more = [b"one more", bodies[3]]
    assert packs.add(spark.createDataFrame([(b,) for b in more], "c binary"), root, "c") == 1 and packs.add(df, root, "c") == 0
    assert stored(root) - size < 100 and set(names) < set(os.listdir(f"{root}/packs"))
    for b in (bodies[0], b"", bodies[-1], b"one more"):
        assert packs.get(spark, root, sha(b)) == b
    with pytest.raises(KeyError):
        packs.get(spark, root, sha(b"never"))
    asked = [(i, sha(b)) for i, b in enumerate(bodies)] + [(900, sha(b"never")), (901, None), (902, sha(bodies[5]))]
    got = packs.objects(spark.createDataFrame(asked, "i int, s string"), root, "s")
    assert got.columns == ["i", "s", "content"]
    held = {r["i"]: r["content"] and bytes(r["content"]) for r in got.collect()}
    assert {i: held[i] or b"" for i in range(len(bodies))} == dict(enumerate(bodies)) and held[900] is None is held[901] and held[902] == bodies[5]
    assert got.where(packs.verified(F.col("content"), F.col("s")).isNull()).count() == 2


def test_one_object_costs_its_own_bytes(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "o")
    rng = random.Random(5)
    bodies = [rng.randbytes(1000) for _ in range(300)]
    packs.add(spark.createDataFrame([(b,) for b in bodies], "c binary").coalesce(1), root, "c")
    read = []
    plain = packs._take

    class Counting:
        def __init__(self, stream):
            self.stream = stream

        def seek(self, at):
            self.stream.seek(at)

        def read(self, n):
            read.append(n)
            return self.stream.read(n)

    monkeypatch.setattr(packs, "_take", lambda stream, *place: plain(Counting(stream), *place))
    assert packs.get(spark, root, sha(bodies[7])) == bodies[7] and len(read) == 1 and read[0] < 1100


def test_writers_at_the_same_time(spark, tmp_path):
    root = str(tmp_path / "o")
    df = [spark.createDataFrame([(f"body {i}",) for i in range(a, a + 60)], "c string") for a in (0, 30)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda d: packs.add(d, root, "c"), df))
    assert packs.index(spark, root).count() == 90
    assert all(packs.get(spark, root, sha(f"body {i}".encode())) == f"body {i}".encode() for i in (0, 45, 89))


def test_a_run_that_breaks_off_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "o")
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    with monkeypatch.context() as m:
        m.setattr(packs, "checkpointed", lambda d: d.collect() and 1 / 0)
        with pytest.raises(ZeroDivisionError):
            packs.add(df, root, "c")
    assert packs.index(spark, root).count() == 0 and packs.add(df, root, "c") == 2
    assert packs.get(spark, root, sha(b"a")) == b"a"
