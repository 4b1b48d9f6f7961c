import random
import time
import tracemalloc

import numpy as np
import pytest

from corpusloom.llm import decontaminate as dc
from corpusloom.llm import queries as q

VOCABULARY = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60


def passage(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = rng.choice(VOCABULARY)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, rng.choice(VOCABULARY))
    return words


def distance(item, text):
    """Smallest edit distance of item to any run of text, and the first end of such a run."""
    row = [0] * (len(text) + 1)
    for w in item:
        new = [row[0] + 1]
        for j, x in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != w)))
        row = new
    return min(row), row.index(min(row))


def test_edit_row_equals_the_plain_way():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 8))], [rng.randrange(4) for _ in range(rng.randint(0, 15))]
        row = dc.edit_row(np.array(a), np.array(b, dtype=np.int64))
        assert (int(row.min()), int(row.argmin())) == distance(a, b)


def test_hits_against_brute_force():
    """Every hit is right; those within the distance are found at the target recall, equal passages always."""
    rng = random.Random(2)
    items = [(i, passage(rng, rng.randint(15, 57))) for i in range(60)] + [(100, ["one"]), (101, passage(rng, 4))]
    index = dc.Index([(i, " ".join(w)) for i, w in items])
    allowed = {i: len(w) // 5 for i, w in items}
    texts, planted = [], []
    for _ in range(500):
        i, w = rng.choice(items[:60])
        share = rng.choice([0, 0.05, 0.1, 0.15, 0.2])
        body = edited(rng, w, int(share * len(w)))
        texts.append(passage(rng, rng.randint(0, 200)) + body + passage(rng, rng.randint(0, 200)))
        planted.append((i, share))
    texts += [passage(rng, 300) for _ in range(100)]
    got = index.hits([" ".join(t) for t in texts])
    due = missed = 0
    for t, hits in zip(texts, got):
        found = {h[0]: h for h in hits}
        for i, w in items:
            d, end = distance(w, t)
            if i in found:
                assert found[i][1:] == (d, end, len(w)) and d <= allowed[i]
            elif d <= allowed[i]:
                due += 1
                missed += 1
                assert d > 0
            due += i in found
    assert due > 450 and missed / due < 0.02


@pytest.mark.parametrize("share", [0.05, 0.2])
def test_pieces_lose_nothing(share, monkeypatch):
    """With every window a candidate, all that brute force finds is found."""
    rng = random.Random(5)
    monkeypatch.setattr(dc.Index, "keys", lambda self, ids, start, length: length[None, :].astype(np.uint64))
    items = [(i, passage(rng, rng.randint(3, 30))) for i in range(20)]
    index = dc.Index([(i, " ".join(w)) for i, w in items], share=share)
    texts = []
    for _ in range(150):
        _, w = rng.choice(items)
        texts.append(passage(rng, rng.randint(0, 30)) + edited(rng, w, int(share * len(w))) + passage(rng, rng.randint(0, 30)))
    for t, hits in zip(texts, index.hits([" ".join(t) for t in texts])):
        want = {i for i, w in items if t and distance(w, t)[0] <= int(share * len(w) + 1e-9)}
        assert {h[0] for h in hits} == want


def test_case_marks_and_ends():
    index = dc.Index([(1, "Alpha beta, gamma; delta epsilon zeta"), (2, None), (3, "..."), (4, "alpha BETA gamma delta epsilon zeta")])
    assert index.hits(["ALPHA\nbeta gamma delta--epsilon zeta!", None, "", "alpha beta gamma delta epsilon", "beta", "x alpha beta gamma x delta epsilon zeta"]) == [
        [(1, 0, 6, 6), (4, 0, 6, 6)], [], [], [(1, 1, 5, 6), (4, 1, 5, 6)], [], [(1, 1, 8, 6), (4, 1, 8, 6)],
    ]
    assert dc.Index([]).hits(["a b"]) == [[]]
    # runs do not reach over the end of a text
    assert index.hits(["alpha beta gamma", "delta epsilon zeta"]) == [[], []]


def test_blocks_of_items_and_query(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(passage(rng, 30)), 0) for i in range(30)] + [(77, None, 0), (None, "a b c", 0)]
    texts = [(i, " ".join(passage(rng, 50)) + " " + items[i % 30][1], "h") for i in range(40)] + [(90, None, "h"), (91, "", "h"), (92, " ".join(passage(rng, 200_000)), "h")]
    texts.append(texts[0])
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string, hits string"), spark.createDataFrame(items, "item_id long, text string, doc_id int")
    whole = sorted(map(tuple, q.op6(spark, docs, bench).collect()))
    assert sorted((r[0], r[1]) for r in whole) == sorted((i, i % 30) for i, *_ in texts if i < 90)
    monkeypatch.setattr(dc, "BLOCK_CHARS", 1000)
    assert len(dc.indexes(bench, "item_id", "text")) > 3
    assert sorted(map(tuple, q.op6(spark, docs, bench).collect())) == whole
    assert q.op6(spark, docs.where("doc_id < 0"), bench).count() == 0 == q.op6(spark, docs, bench.where("item_id < 0")).count()


def test_test_tables(spark):
    """Every text that holds an item word for word is found."""
    sf = "/root/testdata/sf0.1"
    items = {r["item_id"]: " " + " ".join(dc.words_of(r["text"])) + " " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        t = " " + " ".join(dc.words_of(r["text"])) + " "
        want |= {(r["doc_id"], i) for i, w in items.items() if w in t}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in q.QUERIES["op6_decontaminate"](spark, sf).collect()}
    assert {k for k, d in got.items() if d == 0} == want


def edited_with_unknown(rng, words, edits, mark):
    """Edits that put in words of no item."""
    words = list(words)
    for k in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 1 and len(words) > 1:
            del words[at]
        else:
            words[at : at + (kind == 0)] = [f"{mark}{k}"]
    return words


@pytest.fixture(scope="module")
def many_lengths():
    rng = random.Random(11)
    items = [(100 * n + i, passage(rng, n)) for n in (5, 8, 20, 40, 60, 150) for i in range(30)]
    return items, dc.Index([(i, " ".join(w)) for i, w in items])


@pytest.mark.parametrize("share", [0, 0.05, 0.1, 0.2])
def test_recall_with_unknown_words(many_lengths, share):
    items, index = many_lengths
    rng = random.Random(12)
    texts = [passage(rng, 40) + edited_with_unknown(rng, w, int(share * len(w)), f"u{i}x") + passage(rng, 40) for i, w in items]
    caught = [any(h[0] == i for h in hits) for (i, _), hits in zip(items, index.hits([" ".join(t) for t in texts]))]
    for at in range(0, len(items), 30):
        assert sum(caught[at : at + 30]) >= 29
    assert sum(caught) >= 0.98 * len(items)
    if not share:
        assert all(caught)


def test_bands_alone_meet_the_target_and_filter(many_lengths):
    """Every window of an item's size is walked, without the lookup of pieces before."""
    items, index = many_lengths
    rng = random.Random(13)
    met = strange = 0
    for k, (_, w) in enumerate(items):
        n, d = len(w), len(w) // 5
        text = np.array([index.vocabulary.get(x, 0) for x in passage(rng, d) + edited_with_unknown(rng, w, d, "u") + passage(rng, 2 * n)])
        own = index.keys(index.items[k], np.zeros(1, np.int64), np.array([n]))
        start = np.arange(2 * d + 1)
        met += bool((index.keys(text, start, np.full(len(start), n)) == own).any())
        far = index.keys(text, np.array([len(text) - n]), np.array([n]))
        strange += bool((far == own).any())
    assert met >= 0.97 * len(items) and strange < 0.3 * len(items)  # three words are a third of this text


def test_walks_follow_from_the_target():
    lengths = [20, 60]
    few, many = (dc.walks_for(lengths, 0.2, t, 6, 2, 11) for t in (0.5, 0.99))
    assert 1 <= few < many <= dc.MOST_WALKS and dc.walks_for([4], 0.2, 0.99, 6, 2, 11) == 1


def test_long_items_are_walked_in_bounded_batches():
    rng = random.Random(14)
    long = passage(rng, 5000)
    index = dc.Index([(1, " ".join(long)), (2, "a b c d e")], walks=4)
    sizes = np.array([5] * 9000 + [5000] * 3)
    seen = list(index.batches(sizes))
    assert sorted(np.concatenate(seen).tolist()) == list(range(len(sizes)))
    assert all(len(b) == 1 or len(b) * dc.steps_of(int(sizes[b].max())) * 4 <= dc.WRITTEN for b in seen)
    assert [h[0] for h in index.hits([" ".join(["x"] * 30 + edited_with_unknown(rng, long, 300, "q")) + " a b c d e"])[0]] == [1, 2]


def test_edited_items_in_documents(spark, monkeypatch):
    """Items with unknown words put in, planted in real texts, in one block and in several."""
    rng = random.Random(15)
    sf = "/root/testdata/sf0.001"
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], dc.words_of(r["text"])) for r in bench.collect()]
    bodies = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 5000").limit(80).collect()]
    rows, want = [], set()
    for k, body in enumerate(bodies):
        i, w = items[k % len(items)]
        share = (0, 0.05, 0.1, 0.2)[k // 20]
        rows.append((k, f"{body} {' '.join(edited_with_unknown(rng, w, int(share * len(w)), f'q{k}x'))} {body}", "x"))
        want.add((k, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = {(r["doc_id"], r["item_id"]) for r in q.op6(spark, docs, bench).collect()}
    assert len(want - got) <= 1
    monkeypatch.setattr(dc, "BLOCK_CHARS", 3000)
    out = dc.with_hits(docs, bench)
    assert out.columns == ["doc_id", "text", "_row", "hits"] and out.count() == len(rows)
    in_blocks = {(r["doc_id"], h["item_id"]) for r in out.collect() for h in r["hits"]}
    assert len(want - in_blocks) <= 1


@pytest.mark.parametrize("known", [False, True])
@pytest.mark.parametrize("n", [5, 7, 8, 12, 29, 37, 40, 45, 59, 80, 195])
def test_recall_of_an_index_of_one_length(n, known):
    """300 items of one length, each planted with as many edits as are allowed."""
    rng = random.Random(n)
    words = [f"v{i}" for i in range(3000)]
    items = [rng.choices(words, k=n) for _ in range(300)]
    index = dc.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    texts = []
    for k, w in enumerate(items):
        body = edited_with_unknown(rng, w, n // 5, f"u{k}x")
        body = [rng.choice(words) if known and x[0] == "u" else x for x in body]
        texts.append(" ".join(rng.choices(words, k=30) + body + rng.choices(words, k=30)))
    assert sum(any(h[0] == i for h in hits) for i, hits in enumerate(index.hits(texts))) >= 297


def test_an_error_tells_of_a_recall_that_is_not_reached():
    assert 1 < dc.walks_of(40, 0.2, 0.999, 6, 2, 11) <= dc.MOST_WALKS
    with pytest.raises(ValueError, match="40 words"):
        dc.walks_of(40, 0.95, 0.999, 6, 2, 11)


def test_no_step_is_sampled_twice_in_a_band():
    places = np.random.default_rng(1).random((5, 6, 3))
    steps = dc.steps_sampled(places, np.array([3, 4, 90]))
    for k, n in enumerate((3, 4, 90)):
        assert (np.diff(np.sort(steps[..., k], axis=2)) > 0).all() and steps[..., k].min() >= 0 and steps[..., k].max() < n


def test_edit_search_of_many_items_equals_the_plain_way():
    rng = random.Random(6)
    for _ in range(200):
        items = [np.array(rng.choices(range(1, 5), k=rng.randint(1, 70))) for _ in range(rng.randint(1, 9))]
        region = np.array(rng.choices(range(5), k=rng.randint(0, 120)), dtype=np.int64)
        least, end = dc.edit_search(items, region)
        for i, x in enumerate(items):
            assert (least[i], end[i]) == distance(x.tolist(), region.tolist())


def test_long_stretches_are_added_up_in_parts(monkeypatch):
    monkeypatch.setattr(dc, "MARKS", 64)
    rng = random.Random(7)
    items, region = [np.array(rng.choices(range(1, 4), k=30)) for _ in range(5)], np.array(rng.choices(range(4), k=1000))
    want = dc.edit_search(items, region)
    monkeypatch.setattr(dc, "LONG", 10)
    assert all((a == b).all() for a, b in zip(want, dc.edit_search(items, region)))


def test_merged_intervals_against_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        rows = [(rng.randrange(3), a := rng.randrange(60), a + rng.randrange(8)) for _ in range(rng.randint(0, 20))]
        gap = rng.randrange(4)
        got = set(zip(*(x.tolist() for x in dc.merged(*np.array(rows, np.int64).reshape(-1, 3).T, gap))))
        want = set()
        for g in range(3):
            for _, a, b in sorted(r for r in rows if r[0] == g):
                last = max((x for x in want if x[0] == g), default=None)
                if last and a <= last[2] + gap:
                    want.remove(last)
                    a, b = last[1], max(b, last[2])
                want.add((g, a, b))
        assert got == want


def peak_of(run):
    tracemalloc.start()
    began = time.perf_counter()
    out = run()
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, took, peak / 1e6


def test_items_that_are_nearly_equal_in_a_text_of_copies():
    rng = random.Random(9)
    base = passage(rng, 100)
    items = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(100)] = f"own{i}"
        items.append((i, " ".join(words)))
    index = dc.Index(items)
    [hits], took, peak = peak_of(lambda: index.hits([" ".join(base * 250)]))
    assert [h[:2] for h in hits] == [(i, 1) for i in range(300)] and took < 30 and peak < 300


def test_items_with_a_common_opening():
    rng = random.Random(10)
    words = [f"v{i}" for i in range(5000)]
    opening = rng.choices(words, k=13)
    items = [opening + rng.choices(words, k=rng.randint(40, 60)) for _ in range(1500)]
    index = dc.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    text = [w for _ in range(25) for w in opening + rng.choices(words, k=75)]
    (without, one), took, peak = peak_of(lambda: index.hits([" ".join(text), " ".join(text + items[77] + text)]))
    assert without == [] and [h[:2] for h in one] == [(77, 0)] and took < 30 and peak < 300


def test_many_long_items():
    rng = random.Random(16)
    items = [(i, " ".join(passage(rng, 5000))) for i in range(60)]
    index, took, peak = peak_of(lambda: dc.Index(items))
    assert took < 60 and peak < 500
    edited_text = " ".join(edited_with_unknown(rng, items[9][1].split(), 1000, "q"))
    assert [h[0] for h in index.hits([f"a b {edited_text} c d"])[0]] == [9]


def test_walks_of_many_lengths_are_tried_by_tasks(spark, monkeypatch):
    rng = random.Random(17)
    rows = spark.createDataFrame([(i, " ".join(passage(rng, n))) for i, n in enumerate((5, 9, 30, 30, 50))] + [(9, ""), (10, None)], "i long, t string").where("t IS NOT NULL")
    here = dc.all_walks(rows)
    monkeypatch.setattr(dc, "TRIED_HERE", 0)
    assert dc.all_walks(rows) == here == {n: dc.walks_of(n, 0.2, 0.999, 6, 2, 11) for n in (5, 9, 30, 50)}
