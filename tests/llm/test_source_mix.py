import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries as q
from corpusloom.llm import source_mix as sm
from corpusloom.llm.running import running

SCHEMA = "doc_id long, text string, source string, size string, number int, before string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_targets(sizes, weights, share):
    """Words dealt out by weight; what a source can't have is dealt again."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    for _ in range(10_000):
        free = [i for i, n in enumerate(sizes) if out[i] < 2 * n]
        total = sum(weights[i % len(weights)] for i in free)
        if not free or left < 1e-9:
            break
        over = 0.0
        for i in free:
            out[i] += left * weights[i % len(weights)] / total
            over += max(0.0, out[i] - 2 * sizes[i])
            out[i] = min(out[i], 2.0 * sizes[i])
        left = over
    return out


def test_targets_against_dealing_again_and_again():
    rng = random.Random(2)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 10, 1000, rng.randint(0, 10**6)]) for _ in range(rng.randint(1, 12))]
        got = sm.targets(sizes)
        assert got == pytest.approx(plain_targets(sizes, (3, 1, 2), 1.5), rel=1e-6, abs=1e-6)
        assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * n for t, n in zip(got, sizes))
    assert sm.targets([]) == [] and sm.targets([0, 0]) == [0, 0]
    with pytest.raises(ValueError):
        sm.targets([5], share=2.5)


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        for seed in (0, 7, 2**32 - 1):
            assert sorted(sm.permuted(np.arange(n), n, seed).tolist()) == list(range(n))
    assert (sm.permuted(np.arange(1000), 1000, 1) != sm.permuted(np.arange(1000), 1000, 2)).mean() > 0.9


def some_plan(**how):
    return sm.plan(["a", "b", "c", None], [100_000, 3_000, 77, 40_001], block_words=50, shard_blocks=64, **how)


def test_tree_deals_out_exact_quotas():
    p = some_plan()
    shards = list(sm.quotas(p, 0, p.shards))
    assert [s for s, *_ in shards] == list(range(p.shards)) and p.shards > 50
    total = p.quota.sum(axis=0)
    assert (sum(own for _, own, _ in shards) == total).all()
    before = np.zeros_like(total)
    for _, own, b in shards:
        assert (b == before).all() and abs(own.sum() - total.sum() / p.shards) <= 1
        before = before + own
    # a task that works on some shards only finds the same
    for low, high in ((0, 1), (17, 23), (p.shards - 1, p.shards)):
        for (s, own, b), (s2, own2, b2) in zip(sm.quotas(p, low, high), shards[low:high], strict=True):
            assert s == s2 and (own == own2).all() and (b == b2).all()
    assert not list(sm.quotas(sm.plan([], []), 0, 1))


def test_shares_of_shards_are_hypergeometric():
    """Mean and variance of a source's blocks in a shard over many seeds."""
    got = np.array([[own for s, own, _ in sm.quotas(some_plan(seed=k), 5, 6)][0] for k in range(400)])
    p = some_plan()
    total = p.quota.sum(axis=0)
    n, everything = got[0].sum(), total.sum()
    share = total / everything
    want = n * share * (1 - share) * (everything - n) / (everything - 1)
    assert np.allclose(got.mean(axis=0), n * share, atol=4 * np.sqrt(want / len(got)) + 0.01)
    assert np.allclose(got.var(axis=0)[[0, 3]], want[[0, 3]], rtol=0.35)


def test_draws_are_disjoint_and_reach_the_target():
    p = some_plan()
    rows = [tuple(map(int, r)) for cols in sm.drawn(p, 0, p.shards) for r in zip(*cols)]
    assert len({r[2:5] for r in rows}) == len(rows)  # a block once a pass at most
    for s, n in enumerate(p.sizes):
        mine = [r for r in rows if r[2] == s]
        assert sum(r[5] for r in mine) == min(round(p.targets[s]), 2 * n)
        assert all(0 < r[5] <= min(50, n - r[4] * 50) for r in mine)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r[0]].append(r[1])
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    # shuffled: neighbours in a shard are of many blocks far apart
    first = [r[4] for r in sorted(rows) if r[0] == 3 and r[2] == 0]
    assert np.corrcoef(first, range(len(first)))[0, 1] < 0.7


def test_blocks_grow_with_the_input_and_quotas_stay_exact(monkeypatch):
    monkeypatch.setattr(sm, "MOST_BLOCKS", 100)
    p = sm.plan(["a", "b"], [10**6, 10**5])
    assert p.quota.sum() <= 100 and p.block > sm.BLOCK_WORDS
    rows = [tuple(map(int, r)) for cols in sm.drawn(p, 0, p.shards) for r in zip(*cols)]
    assert sum(r[5] for r in rows) == p.words.sum() == 1_650_000


def test_running_sums_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.choice([None, *range(20)]), rng.randint(0, 9), "x") for _ in range(500)]
    df = spark.createDataFrame(rows, "g int, k int, w long, _at string").repartition(7)
    for n in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((r["g"], r["before"], r["w"], -1 if r["k"] is None else r["k"]) for r in running(df, "g", ["k"], "w").collect())
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(got) == 500
        for g in (0, 1, 2):
            mine = [r for r in got if r[0] == g]
            at = 0
            for _, before, w, _ in sorted(mine, key=lambda r: (r[3], r[1], r[2])):
                assert before == at
                at += w
    assert running(df.where("g > 9"), "g", ["k"], "w").count() == 0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(i, " \t".join(rng.choice(["alpha", "b", "é", "\x1c", "x y"]) for _ in range(rng.choice([0, 1, 30, 300]))), rng.choice(["s", "s", "s", "t", "Z", "ß", None, ""]), "h", 1, "h") for i in range(200)]
    out += [(300, None, "s", None, None, None), (301, "", "empty", None, None, None), (302, " \n ", None, None, None, None), (303, "word " * 40_000, "s", None, None, None), (None, "a b c", "t", None, None, None), (None, None, None, None, None, None)]
    return out + [out[5], out[5], (5, "another text of this id", "t", None, None, None)]


def test_query_on_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = q.op12(spark, df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, plain_targets([sizes[s] for s in names], (3, 1, 2), 1.5)))
    source_of = {(r[0], len(words(r[1]))): r[2] for r in rows}
    total = Counter()
    for r in got:
        s = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s]) and 0 <= r["taken"] <= 2 * r["size"]
        total[s] += r["taken"]
    assert all(abs(total[s] - goal[s]) <= 1 for s in names)
    assert sorted(map(str, q.op12(spark, df.repartition(3)).collect())) == sorted(map(str, got))
    assert q.op12(spark, df.where("doc_id < 0")).count() == 0
    assert [r["taken"] for r in q.op12(spark, df.where("doc_id = 300")).collect()] == [0]


def test_shards_hold_the_words_that_are_counted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    mix = sm.prepare(df, block_words=16, shard_blocks=32)
    out = sm.shard_texts(df, mix).withColumn("p", F.spark_partition_id()).collect()
    count = Counter()
    for r in out:
        count[r["doc_id"]] += len(words(r["text"]))
    want = Counter()
    for r in sm.taken(mix).collect():
        want[r["doc_id"]] += r["taken"]
    assert count == +want
    # every word of a document that is taken whole stands in it as often as in the mix, passes apart
    texts = {(r[0]): r[1] for r in rows[:200]}
    for i in list(texts)[:60]:
        own, got = Counter(words(texts[i])), Counter(w for r in out if r["doc_id"] == i for w in words(r["text"]))
        assert i == 5 or all(got[w] <= 2 * own[w] for w in got)
    assert {len({r["p"] for r in out if r["shard"] == s}) for s in {r["shard"] for r in out}} == {1}


def test_test_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = q.QUERIES["op12_source_mix"](spark, sf)
    docs = {r["doc_id"]: (r["source"], len(words(r["text"]))) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()}
    rows, total, goal = got.collect(), Counter(), {}
    for r in rows:
        s, n = docs.pop(r["doc_id"])
        assert r["size"] == n and r["taken"] <= 2 * n
        total[s] += r["taken"]
        goal[s] = r["target"]
    assert not docs and all(abs(total[s] - goal[s]) <= 1 for s in goal)
