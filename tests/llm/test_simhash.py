import random
import re

import numpy as np
import pytest
import xxhash

from corpusloom.llm import components as cc
from corpusloom.llm import queries as q
from corpusloom.llm import simhash as sh


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def plain_components(fps):
    """Smallest id reachable, by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_against_the_definition():
    rng = random.Random(1)
    words = ["The", "CAT", "sat", "été", "\x1f", "a b", "x\ty", "É", "z\x0b", "ab\x00"]
    texts = [None, "", " \n ", "one", "one two", "a b c", "A B C"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)]
    assert sh.fingerprints(texts).tolist() == [plain_fingerprint(t) for t in texts]
    long = " ".join(rng.choice(words) for _ in range(300_000))
    assert sh.fingerprints(["x", long])[1] == plain_fingerprint(long)


def chains(rng):
    """Fingerprints with chains, tight groups and loners."""
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(10):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.append(x)
            x = near(rng, x, rng.randint(1, 4))
    centre = rng.getrandbits(64)
    fps += [near(rng, centre, rng.randint(0, 2)) for _ in range(80)]
    fps += [0, 7, 15, 1 << 63, (1 << 64) - 1]
    rng.shuffle(fps)
    return fps


@pytest.mark.parametrize("hot", [20_000, 0, 30])
def test_links_join_what_all_pairs_join(spark, monkeypatch, hot):
    monkeypatch.setattr(sh, "HOT_PAIRS", hot)
    monkeypatch.setattr(sh, "BLOCK", 8 if hot else 2048)
    fps = sorted(set(chains(random.Random(hot))))
    want = plain_components(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    number = {signed(x): i for i, x in enumerate(fps)}
    joined = list(range(len(fps)))

    def find(i):
        while joined[i] != i:
            i = joined[i]
        return i

    for r in sh.links(df).collect():
        a, b = find(number[r["x"]]), find(number[r["y"]])
        joined[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == want


def test_popcount_cells_bound_the_distance(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(20)]
    got = {r["fp"]: r["c"] for r in spark.createDataFrame([(signed(x),) for x in fps], "fp bigint").select("fp", sh.cells().alias("c")).collect()}
    for x in fps:
        for half in (0, 1):
            v = x >> 32 * half & 0xFFFFFFFF
            assert got[signed(x)][half]["counts"] == sum((v >> 2 * i & 3).bit_count() << 2 * i for i in range(16))


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 200
    edges = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(n // 2, i) for i in range(n)], "none": [(1, 1)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(150)]}[shape]
    names = [rng.randrange(-(10**12), 10**12) for _ in range(n)]
    rows = [(names[a], names[b]) for a, b in edges] + [(None, names[0])]
    rows += rows[:5]
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    group = {names[a]: {names[a]} for e in edges for a in e}
    for a, b in edges:
        if group[names[a]] is not group[names[b]]:
            group[names[a]] |= group[names[b]]
            for x in group[names[a]]:
                group[x] = group[names[a]]
    assert got == {x: min(g) for x, g in group.items() if len(g) > 1}


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted([(r["doc_id"], r["text"]) for r in docs] + [(1000, None), (1001, ""), (1002, "\n"), (1003, "word"), (1004, "WORD")])
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {rows[i][0]: (f"{fps[i]:016x}", rows[c][0]) for i, c in enumerate(plain_components(fps))}
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fingerprint string")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.op7(spark, df).collect()} == want
    assert q.op7(spark, df.where("doc_id < 0")).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "lonely words here")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in q.op7(spark, df).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5)]


def test_spanning_forest():
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    base = np.array([near(rng, centre, 2) for _ in range(30)], np.uint64)
    probe = np.array([near(rng, centre, 1) for _ in range(700)] + [rng.getrandbits(64)], np.uint64)
    x, y = sh.spanning(base, probe)
    assert len(x) <= 730 and set(y.tolist()) == {int(min(x.min(), base.min()))}
