import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import merkle as m
from corpusloom.llm import queries as q
from tests.llm.oracle import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, place string, now binary, of int"
NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_leaf(r, text):
    values = [r[0], r[3], r[2], r[4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(top, siblings of each node as [(left, right)] from the lowest level up)."""
    paths, groups, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        for i, members in enumerate(groups):
            a = i // 16 * 16
            for k in members:
                paths[k].append((level[a:i], level[i + 1 : a + 16]))
        level = [sha("".join(level[a : a + 16])) for a in range(0, len(level), 16)]
        groups = [sum(groups[a : a + 16], []) for a in range(0, len(groups), 16)]
    return level[0], paths


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, row_leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in by[s]])
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, upper in zip(names, above):
        for (_, _, leaf, r), path in zip(by[s], trees[s][1]):
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                now = row_leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in path + upper:
                now = sha("".join([*left, now, *right]))
            proof = sha("".join(x for left, right in path + upper for x in left + right))
            out.append((r[0], leaf, trees[s][0], root, proof, now, now == root))
    return Counter(out)


def result(df):
    return Counter(tuple(r[c] for c in NAMES) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "c", None, 3) for r in rows], SCHEMA).repartition(4)


def some_rows(rng, sizes):
    texts = ["Alpha BETA", "no capitals", "ÄÖ É", "", None, "x" * 100_000 + "Z", "MiXed"]
    ids = iter(rng.sample(range(100_000), sum(sizes.values())))
    return [(next(ids), rng.choice(texts), rng.choice(["en", None]), s, rng.choice([1, None, 10**12])) for s, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, "b": 1}, {None: 257, "": 3, "ß": 16, "Z": 15, "a": 272}, {"big": 4400, "z": 1}, {f"s{i}": 1 + i % 3 for i in range(290)}])
def test_against_brute_force(spark, sizes):
    rows = some_rows(random.Random(len(sizes)), sizes)
    want = plain(rows)
    assert result(q.op13(spark, table(spark, rows))) == want
    if len(rows) > 30:
        assert 0 < sum(n for r, n in want.items() if not r[-1]) < len(rows)


def test_odd_rows(spark):
    rows = some_rows(random.Random(1), {"a": 40, None: 5})
    rows += [rows[0], rows[0], (None, None, None, None, None), (None, "UPPER", None, "a", 1), (None, "UPPER", None, "a", 1), (rows[1][0], "ANOTHER text of the id", None, "a", 2)]
    df = table(spark, rows)
    assert result(q.op13(spark, df)) == plain(rows)
    none = q.op13(spark, df.where("doc_id < 0"))
    assert none.count() == 0 and none.columns == list(NAMES)


def test_levels_and_missing_children():
    assert [m.levels_of(n) for n in (0, 1, 16, 17, 256, 257, 4096, 4097)] == [1, 1, 1, 2, 2, 3, 3, 4]
    with pytest.raises(RuntimeError):
        m.arrived([(0, 3, b"", None), (2, 3, b"", None)])
    with pytest.raises(RuntimeError):
        m.hashed(((0, 0), [(0, 3, b"", None), (1, 3, b"", None)]))


def test_nodes_of_one_source_are_spread():
    count = Counter(m.spread((7, i)) % 13 for i in range(13_000))
    assert len(count) == 13 and max(count.values()) < 1300


@pytest.mark.parametrize("sf,rows", [("/root/testdata/sf0.001", 200), ("/root/testdata/sf0.1", 10_000)])
def test_equals_its_sql(spark, sf, rows):
    assert compare(spark, "op13", q.QUERIES["op13_merkle"], q.ORACLE_SQL["op13_merkle"], sf) == rows
