import difflib
import random
import time

import numpy as np
import pytest

from corpusloom.functions import matching as mt


def plain(x, y):
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


def edited(rng, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.choice([0, 0, 1, 5, 40])] = rng.choices(letters, k=rng.choice([0, 1, 3, 30]))
    return "".join(out)


@pytest.mark.parametrize("letters", ["a", "ab", "abcd ", "abcdefghij klmno\n", "aбć😀 "])
def test_equals_the_plain_way(letters, monkeypatch):
    rng = random.Random(len(letters))
    for cells, places in ((1500, 8), (0, 8), (0, 0)):
        monkeypatch.setattr(mt, "CELLS", cells)
        monkeypatch.setattr(mt, "MOST_PLACES", places)
        for _ in range(60):
            x = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 60, 300])))
            for y in (edited(rng, x, rng.randint(0, 6), letters), "".join(rng.choices(letters, k=rng.choice([0, 3, 80, 200]))), x * 2):
                assert mt.ratio(x, y) == plain(x, y)


def test_texts_of_repeated_lines(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(mt, "CELLS", 50)
    lines = ["read more about this\n", "share\n", "share this page with all your friends and foes\n"]
    for _ in range(40):
        x = "".join(rng.choices(lines, k=rng.randint(1, 40)))
        y = edited(rng, "".join(rng.choices(lines, k=rng.randint(1, 40))), 3, "xyz")
        assert mt.ratio(x, y) == plain(x, y) and mt.ratio(x, x) == 1.0


def test_longest_block_by_halving():
    rng = random.Random(3)
    for _ in range(100):
        x, y = ("".join(rng.choices("ab", k=rng.randint(1, 30))) for _ in range(2))
        m = difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match()
        i, j, n = mt.longest(mt.Rolling(x), mt.Rolling(y), (0, len(x), 0, len(y)))
        assert n == m.size and (not n or (i, j) == (m.a, m.b))


def test_texts_of_a_million_characters():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(20_000)]
    x = " ".join(rng.choices(words, k=160_000))
    y = list(x)
    for _ in range(1000):
        at = rng.randrange(len(y))
        y[at : at + 7] = "☃" * rng.randint(0, 20)
    y = "".join(y)
    began = time.perf_counter()
    got = mt.ratio(x, y)
    took = time.perf_counter() - began
    assert len(x) > 900_000 and 0.97 < got < 0.999 and took < 60
    print(took)
    # a page of lines that are all the same, with one other line in its middle
    line = "the same line again and again\n"
    assert mt.ratio(line * 10_000 + "☃" + line * 10_000, line * 20_000) == 2 * 600_000 / 1_200_001


def test_windows_of_equal_text_have_equal_hashes():
    r = mt.Rolling("abcabcabd")
    h = r.windows(0, 9, 3)
    assert h[0] == h[3] and len(np.unique(h)) == 4 and len(r.windows(2, 4, 3)) == 0
