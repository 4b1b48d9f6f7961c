import random
import re
from itertools import permutations

import numpy as np
import pytest

from corpusloom.llm import filter_audit as fa
from corpusloom.llm import queries as q
from tests.llm.oracle import compare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, part int"
LABELS = "doc_id long, quality int, toxic int, part string"


def plain(rows, labels):
    """The audit by going through the rows, order by order."""
    fails = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A"} if len(words) < 100 else set()
        own |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        own |= {"D"} if re.search("[#$%&*|]", t) else set()
        own |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        fails.append((lang or "", own, any(j == i and a == 1 for j, a, _ in labels if j is not None), any(j == i and b == 1 for j, _, b in labels if j is not None)))
    out, shapley = {}, {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in mine if f in x[1]]
                out[part, "".join(order), k + 1] = (len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(got) == len(rows)
    return got


def test_small_tables_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "d&d", "e", "é  f", "ÄÖ", "#"]
    texts = [" \t".join(rng.choice(words[: rng.randint(1, 8)]) for _ in range(rng.choice([0, 1, 5, 99, 100, 101, 130]))) for _ in range(60)]
    texts += [None, "", " \n\x0b\x1c ", "A" * 1_000_000, " ".join(map(str, range(30_000))), "AB ef ghij", "A123456789"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, "", "x" * 50]), "s", 1, "clash", 7) for i in range(150)]
    rows += [rows[3], rows[3], (None, "", "en", None, None, None, None), (None, None, None, None, None, None, None), (5, "other text of a repeated id", "en", None, None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "clash") for i in range(0, 140, 2)] + [(4, 1, 0, "c"), (4, 0, 1, "c"), (None, 1, 1, "c"), (9999, 1, 1, "c")]
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)
    want = plain([r[:3] for r in rows], [x[:3] for x in labels])
    assert result(q.op11(spark, docs, marks)) == want and len(want) == 600 * 4
    assert q.op11(spark, docs.where("doc_id < 0"), marks).count() == 0
    assert result(q.op11(spark, docs.where("doc_id = 7"), marks.where("doc_id < 0"))) == plain([rows[7][:3]], [])


def test_bitsets_by_parts():
    rng = np.random.default_rng(1)
    for n, parts in ((1, 1), (64, 1), (65, 2), (1000, 7), (300, 200)):
        part = np.unique(rng.integers(0, parts, n), return_inverse=True)[1]
        filters, marks = [rng.random(n) < p for p in (0.1, 0.5, 1.0)], [rng.random(n) < 0.3]
        got = fa.counted(part, part.max() + 1, filters, marks)
        for p in range(part.max() + 1):
            for k, (before, f) in enumerate(fa.prefixes(3)):
                alive = (part == p) & ~np.any([filters[g] for g in range(3) if before >> g & 1] or [np.zeros(n, bool)], axis=0)
                gone = alive & filters[f]
                assert got[p, k].tolist() == [(alive & ~gone).sum(), gone.sum(), (gone & marks[0]).sum()]


def test_any_filters_parts_and_marks(spark, monkeypatch):
    """Other names and numbers of filters, more parts than a task holds, null flags."""
    monkeypatch.setattr(fa, "HELD_PARTS", 3)
    rng = random.Random(5)
    rows = [(i % 11, rng.choice([True, False, None]), rng.choice([True, False]), rng.choice([True, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "p int, short boolean, loud boolean, rare boolean").repartition(3)
    got = {(r["part"], r["filter_order"], r["step"]): r for r in fa.audit(df, ["short", "loud"], "p", ["rare"]).collect()}
    assert len(got) == 11 * 2 * 2
    for p in range(11):
        mine = [r for r in rows if r[0] == p]
        r = got[str(p), "loudshort", 2]
        gone = [x for x in mine if x[1] and not x[2]]
        assert (r["removed"], r["lost_rare"], r["kept"], r["redundant"]) == (len(gone), sum(bool(x[3]) for x in gone), sum(not x[1] and not x[2] for x in mine), sum(bool(x[1]) and x[2] for x in mine))
        assert r["shapley"] == sum(bool(x[1]) for x in mine) + len(gone) and r["unique_fails"] == len(gone)
    with pytest.raises(ValueError):
        fa.audit(df, list("abcdefghi"), "p", [])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_equals_its_sql(spark, sf):
    assert compare(spark, "op11", q.QUERIES["op11_filter_audit"], q.ORACLE_SQL["op11_filter_audit"], sf) == 2400
