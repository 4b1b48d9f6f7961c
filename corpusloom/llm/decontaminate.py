"""Benchmark decontamination: passages of a text within a small word edit distance of a benchmark item.

Texts and items are lower-cased runs of letters, digits and underscores. An item of L words is found in a text if some
run of the text's words is at most floor(``share`` * L) word insertions, deletions and substitutions away (items of
under 1 / share words must stand there exactly).

Windows of an item's size are mapped by CGK random walks: a walk writes the current word at each step and moves on by a
random bit that depends on the step and the word, so that a small edit distance becomes a small Hamming distance. Bands
of sampled steps are hashed, all from the first 1.5 L steps, in which a walk is still within its words, and of long items
from the first ``STEPS``, which pass some 160 words; a window that shares a band with an item of its size, in any of several walks, is a candidate. Equal passages always meet.

How many walks an item has depends on its length (``walks_of``): it is the smallest number of the index's own walks, with
its own seeds and steps, that meet ``target_recall`` of random items of that length, each with as many edits as allowed
at random places, of random kinds, that put in words that no item has. The trial takes the one window that begins where
the passage does, so what the index finds, which walks others too, is more. Every length that the items have is tried; if
the target isn't reached by ``MOST_WALKS``, an error says so.

Not every window need be walked. An item is cut into d + 1 even pieces, for d allowed edits. Of a passage within d edits
at least one piece, say the k-th from 0, stands untouched with exactly k edits before it: take the first k for which the
pieces up to it have k edits at most. So where a text has the k-th piece, windows are walked that would put it in its
place, give or take k words; this loses nothing. Items of one length that share a piece give the same windows, which are
kept as intervals of starts.

Windows that meet items become intervals of the text for each item, without listing windows by items; these are verified
by Myers' bit-parallel edit distance, with the bits of all items that want the same stretch of text side by side in one
integer. What a task holds is bounded by ``ROWS``, ``WRITTEN`` and ``BITS`` and does not grow with the text beyond the
word numbers and the hits themselves.

The items are brought to the driver and broadcast in blocks of about ``BLOCK_CHARS`` characters, one after the other:
a block's index is built, held against all texts and given up before the next one is built. One block needs one pass
and no shuffle. With more, texts are first written with a row number, each pass writes the rows with hits, and these are
joined to the texts at the end.

Defined results: null and empty texts have no hits, null items and items without words match nothing. Equal items are
all reported. Texts of any length are searched whole, in memory that grows by some 24 bytes a word of the text. Of several places the one with the smallest distance is
reported, of those the first. Other columns pass through untouched; a column of the name ``into`` is replaced. Without
items all rows have no hits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, text_udf, unused

WORD = re.compile(r"\w+")
BLOCK_CHARS = 32 << 20
#: Words of a piece that are looked up at most.
PIECE = 4
#: Windows that are walked at once at most, and numbers that these walks may write.
WINDOWS, WRITTEN = 4000, 4_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    h = np.zeros(max(len(ids) - n + 1, 0), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)
    return mixed(h)


#: Steps of a walk at most: edits add up on the way, so later steps of long items would meet less and less often.
STEPS = 240


def steps_of(n):
    """Steps of a walk over n words. A step moves on every other time, so a walk that isn't cut off ends at about three
    quarters."""
    return np.minimum(n + (n + 1) // 2, STEPS)


def batches(length: np.ndarray, walks: int) -> Iterator[np.ndarray]:
    """Places of the windows, in batches of like length whose walks write a bounded number of words."""
    order = np.argsort(length, kind="stable")
    ordered, at = length[order], 0
    while at < len(order):
        longest = 2 * int(ordered[at])
        most = max(1, min(WINDOWS, WRITTEN // (steps_of(longest) * walks)))
        stop = min(at + most, int(np.searchsorted(ordered, longest, side="right")))
        yield order[at:stop]
        at = stop


def steps_sampled(places: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The sampled steps [walks, bands, sampled, windows] of walks with so many steps, no step twice in a band. ``places``
    [walks, bands, sampled] in [0, 1)."""
    out = np.empty((*places.shape, len(steps)), np.int64)
    for k in range(places.shape[2]):
        at = (places[:, :, k, None] * np.maximum(steps - k, 1)).astype(np.int64)
        for earlier in np.moveaxis(np.sort(out[:, :, :k], axis=2), 2, 0):
            at += at >= earlier
        out[:, :, k] = at
    return out


def band_keys(ids: np.ndarray, start: np.ndarray, length: np.ndarray, pad: int, step_seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Band hashes [walks * bands, windows] of the windows of ids. ``step_seeds`` [steps, walks, 1] decide the walks,
    ``places`` [walks, bands, sampled] the sampled steps."""
    walks, bands, sampled = places.shape
    out = np.empty((walks * bands, len(start)), np.uint64)
    padded = np.append(ids, pad)
    for at in batches(length, walks):
        s, n = start[at], length[at]
        steps = steps_of(int(n.max()))
        i = np.zeros((walks, len(s)), np.int64)
        written = np.empty((steps, walks, len(s)), np.int64)
        for t in range(steps):
            word = np.where(i < n, padded[np.minimum(s + i, len(ids))], pad)
            written[t] = word
            # + 1, as a walk has to move on from word 0 too
            i += ((mixed((word + 1).astype(np.uint64) * step_seeds[t]) >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
        place = steps_sampled(places, steps_of(n))
        word = written[place, np.arange(walks)[:, None, None, None], np.arange(len(s))]
        h = np.broadcast_to(n.astype(np.uint64), (walks, bands, len(s))).copy()
        for k in range(sampled):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + word[:, :, k].astype(np.uint64))
        h = h.reshape(walks * bands, -1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(walks * bands, dtype=np.uint64)[:, None]
        out[:, at] = mixed(h)
    return out


#: Walks that are tried at most, trials for each length, and trials times words, for long items; 200 trials at least.
MOST_WALKS, TRIALS, TRIED_WORDS = 64, 1000, 100_000


def seeds_of(longest: int, bands: int, sampled: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(step seeds, places) of MOST_WALKS walks; those of a shorter walk are the first of a longer one's."""
    steps = np.arange(steps_of(longest) * MOST_WALKS, dtype=np.uint64).reshape(-1, MOST_WALKS, 1)
    steps = mixed(mixed(steps + np.uint64(seed + 1)) + np.uint64(seed)) | np.uint64(1)
    return steps, np.random.default_rng(seed).random((MOST_WALKS, bands, sampled))


def edited(rng: np.random.Generator, words: list[int], d: int) -> list[int]:
    """d edits of random kinds at random places, which put in word 0."""
    for kind, place in zip(rng.integers(3, size=d).tolist(), rng.random(d).tolist()):
        at = int(place * len(words))
        words[at : at + (kind != 2)] = [] if kind == 1 and len(words) > 1 else [0]
    return words


@lru_cache(maxsize=4096)
def walks_of(n: int, share: float, target: float, bands: int, sampled: int, seed: int) -> int:
    """How many of the index's walks items of n words need for the target recall."""
    d = int(n * share + 1e-9)
    if not d:
        return 1
    steps, places = seeds_of(n, bands, sampled, seed)
    rng = np.random.default_rng([seed, n])
    trials = min(TRIALS, max(200, TRIED_WORDS // n))
    # words of one item differ; those of different trials have nothing to do with each other
    items = np.arange(1, n + 1) + rng.integers(1 << 30, size=(trials, 1)) * np.int64(n)
    pad = -2
    texts = np.full((trials, n), pad)
    for r, item in enumerate(items.tolist()):
        words = edited(rng, item, d)[:n]
        texts[r, : len(words)] = words
    start, length = np.arange(trials) * n, np.full(trials, n)
    met, low = np.zeros((0, trials), bool), 0
    for high in (8, 16, 32, MOST_WALKS):  # few are enough as a rule
        own, found = (band_keys(x.reshape(-1), start, length, pad, steps[:, low:high], places[low:high]) for x in (items, texts))
        met = np.concatenate([met, (own == found).reshape(high - low, bands, trials).any(axis=1)])
        recall = np.logical_or.accumulate(met, axis=0).mean(axis=1)
        if recall[-1] >= target:
            return int(np.argmax(recall >= target)) + 1
        low = high
    raise ValueError(f"{MOST_WALKS} walks meet {recall[-1]:.4f} of items of {n} words, and not {target}")


def walks_for(lengths: list[int], share: float, target: float, bands: int, sampled: int, seed: int) -> int:
    """Walks that the hardest of the lengths needs."""
    return max((walks_of(n, share, target, bands, sampled, seed) for n in lengths), default=1)


#: Rows (pieces at places, items at places) and windows that are worked on at once, and bits of items side by side.
ROWS, MET, BITS = 400_000, 20_000, 1 << 17


def spelled_out(counts: np.ndarray, most: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, their places in that slice repeated by their counts, number within the row), about ``most`` at once; a row
    stands alone if it has more."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        n = counts[at:stop]
        row = np.repeat(np.arange(len(n)), n)
        yield slice(at, stop), row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def merged(group: np.ndarray, low: np.ndarray, high: np.ndarray, gap: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals [low, high] of each group, put together where not more than ``gap`` lies between them; a gap for each
    row is the same in all rows of a group."""
    if not len(group):
        return group, low, high
    order = np.lexsort((low, group))
    group, low, high = group[order], low[order], high[order]
    gap = gap[order] if isinstance(gap, np.ndarray) else gap
    rank = np.cumsum(np.append(False, group[1:] != group[:-1]))
    reach = int(high.max()) + int(np.max(gap)) + 2
    upto = np.maximum.accumulate(high + rank * reach)
    first = np.append(True, (low + rank * reach)[1:] > (upto + gap)[:-1]) | np.append(True, group[1:] != group[:-1])
    last = np.append(first[1:], True)
    return group[first], low[first], (upto - rank * reach)[last]


class Index:
    """Items ready to be looked for. Word number 0 stands for all words that no item has."""

    def __init__(self, items: list[tuple[int, str | None]], share: float = 0.2, target_recall: float = 0.999, walks: dict[int, int] | int | None = None, bands: int = 6, sampled: int = 2, seed: int = 11):
        """``walks``: the number of walks, for all or by length, if it is known; by default ``walks_of`` each length."""
        known = sorted((i, w) for i, text in items if i is not None and (w := words_of(text)))
        self.item_ids = np.array([i for i, _ in known], np.int64)
        self.vocabulary = {w: n + 1 for n, w in enumerate(sorted({x for _, ws in known for x in ws}))}
        self.items = [np.array([self.vocabulary[x] for x in ws], np.int64) for _, ws in known]
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.allowed = np.floor(self.lengths * share + 1e-9).astype(np.int64)
        longest = int(self.lengths.max()) if len(self.items) else 1
        self.pad = len(self.vocabulary) + 1
        lengths = np.unique(self.lengths).tolist()
        known_walks = walks if isinstance(walks, dict) else dict.fromkeys(lengths, walks) if walks else {}
        self.walks = np.ones(longest + 1, np.int64)  # by length
        for n in lengths:
            self.walks[n] = known_walks.get(n) or walks_of(n, share, target_recall, bands, sampled, seed)
        most = int(self.walks.max())
        steps, places = seeds_of(longest, bands, sampled, seed)
        self.steps, self.places = steps[:, :most].copy(), places[:most]
        self.pieces: dict[int, tuple[np.ndarray, ...]] = {}
        self._cut()
        start = np.cumsum(self.lengths) - self.lengths
        flat = np.concatenate(self.items) if self.items else np.zeros(0, np.int64)
        key, item = [], []
        for n in lengths:
            mine = np.flatnonzero(self.lengths == n)
            found = self.keys(flat, start[mine], self.lengths[mine])
            key.append(found.reshape(-1))
            item.append(np.tile(mine, len(found)))
        key, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (key, item))
        order = np.lexsort((item, key))
        self.key, self.key_item = key[order].astype(np.uint64), item[order]

    def _cut(self) -> None:
        """Pieces by their number of words: sorted hashes, and the item's length, the piece's number and its offset, once
        for all items that have them."""
        found = defaultdict(set)
        for ids, d in zip(self.items, self.allowed.tolist()):
            edges = np.arange(d + 2) * len(ids) // (d + 1)
            size = np.minimum(np.diff(edges), PIECE)
            for n in np.unique(size).tolist():
                g = grams(ids, n)
                found[n].update((int(g[a]), len(ids), k, a) for k, a in enumerate(edges[:-1].tolist()) if size[k] == n)
        for n, rows in found.items():
            h, *rest = zip(*sorted(rows))
            h = np.array(h, np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(h >> np.uint64(44)).astype(np.int64)] = True
            self.pieces[n] = (h, *(np.array(x, np.int64) for x in rest), seen)

    def keys(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Band hashes [walks * bands, windows] of the windows of ids, by the walks that the longest of them needs."""
        walks = int(self.walks[length].max(initial=1))
        return band_keys(ids, start, length, self.pad, self.steps[:, :walks], self.places[:walks])

    def batches(self, length: np.ndarray) -> Iterator[np.ndarray]:
        return batches(length, int(self.walks[length].max(initial=1)))

    def windows(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, first, last): intervals of starts of the windows that put a piece of an item in its place. low, high:
        for each word the ends of its text."""
        found = [np.zeros((3, 0), np.int64)]
        for n, (h, length, number, offset, seen) in self.pieces.items():
            if len(ids) < n:
                continue
            whole = np.ones(len(ids) - n + 1, bool)
            for k in range(n):
                whole &= ids[k : k + len(whole)] > 0
            whole &= high[: len(whole)] >= np.arange(len(whole)) + n
            at = np.flatnonzero(whole)
            g = grams(ids, n)[at]
            keep = seen[(g >> np.uint64(44)).astype(np.int64)]
            at, g = at[keep], g[keep]
            a = np.searchsorted(h, g)
            counts = np.searchsorted(h, g, side="right") - a
            for rows, row, within in spelled_out(counts, ROWS):
                word, piece = at[rows][row], a[rows][row] + within
                size, k = length[piece], number[piece]
                top = np.maximum(high[word] - size, low[word])
                place = word - offset[piece]
                found.append(np.array(merged(size, np.clip(place - k, low[word], top), np.clip(place + k, low[word], top), 1)))
                if sum(x.shape[1] for x in found) > 4 * ROWS:
                    found = [np.array(merged(*np.concatenate(found, axis=1), 1))]
        return merged(*np.concatenate(found, axis=1), 1)

    def candidates(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, first word, last word + 1) of the stretches of a text in which an item may be."""
        length, first, last = self.windows(ids, low, high)
        counts = -(-(last - first + 1) // MET)  # long intervals in parts
        length, first, last = np.repeat(length, counts), np.repeat(first, counts), np.repeat(last, counts)
        first += MET * (np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts))
        order = np.argsort(first, kind="stable")
        length, first, last = length[order], first[order], np.minimum(last, first + MET - 1)[order]
        for rows, row, within in spelled_out(last - first + 1, MET):
            yield from self._met(ids, low, high, first[rows][row] + within, length[rows][row])

    def _met(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        found = []
        # a window may not reach into the next text: what is over counts as no word
        inside = np.minimum(length, high[start] - start)
        for at in self.batches(length):
            s, n, m = start[at], length[at], inside[at]
            block = np.full((len(s), int(n.max())), self.pad)
            column = np.arange(block.shape[1])
            valid = column < m[:, None]
            block[valid] = ids[(s[:, None] + column)[valid]]
            keys = self.keys(block.reshape(-1), np.arange(len(s)) * block.shape[1], n)
            a = np.searchsorted(self.key, keys)
            there = self.key[np.minimum(a, len(self.key) - 1)] == keys
            _, window = np.nonzero(there)
            found.append(np.array([a[there], s[window], n[window]]))
        if not found:
            return
        # a key stands for all items that have it: windows that lie close become one stretch before items are spelled out
        key, s, n = np.concatenate(found, axis=1)
        ends = len(ids) + 1
        group, first, last = merged(key * ends + high[s], s, s, n)
        a, end_of = group // ends, group % ends
        counts = np.searchsorted(self.key, self.key[a], side="right") - a
        for rows, row, within in spelled_out(counts, ROWS):
            item, end = self.key_item[a[rows][row] + within], end_of[rows][row]
            d, n = self.allowed[item], self.lengths[item]
            begin = np.maximum(first[rows][row] - d, low[end - 1])
            pair, begin, stop = merged(end * len(self.items) + item, begin, np.minimum(last[rows][row] + n + d, end))
            yield pair % len(self.items), begin, stop

    def hits(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item id, distance, end of the run in words, words of the item), by item id."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        flat: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        get = self.vocabulary.get
        for k, t in enumerate(texts):
            flat.append(np.array([get(w, 0) for w in words_of(t)], np.int64))
            counts[k] = len(flat[-1])
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        low, high = np.repeat(ends - counts, counts), np.repeat(ends, counts)
        best = np.zeros((4, 0), np.int64)  # end of the text, item, distance, end of the run
        for item, begin, stop in self.candidates(ids, low, high):
            distance, end = self.verified(ids, item, begin, stop)
            keep = distance <= self.allowed[item]
            best = np.concatenate([best, [high[begin[keep]], item[keep], distance[keep], end[keep]]], axis=1)
            best = best[:, np.lexsort(best[::-1])]
            best = best[:, np.append(True, (best[:2, 1:] != best[:2, :-1]).any(axis=0))[: best.shape[1]]]
        text_of = {int(e): k for k, (e, c) in enumerate(zip(ends, counts)) if c}
        for end, i, distance, stop in best.T.tolist():
            k = text_of[end]
            out[k].append((int(self.item_ids[i]), distance, stop - end + int(counts[k]), int(self.lengths[i])))
        for rows in out:
            rows.sort()
        return out

    def verified(self, ids: np.ndarray, item: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(smallest distance, first end) of each item to the runs of words of its stretch. Items whose stretches are of
        like length and overlap are looked for together, in the stretch that holds them all."""
        distance, end = np.empty(len(item), np.int64), np.empty(len(item), np.int64)
        size = np.frexp((stop - begin).astype(float))[1]
        order = np.lexsort((begin, size))
        rows, at = list(zip(order.tolist(), begin[order].tolist(), stop[order].tolist(), size[order].tolist(), self.lengths[item[order]].tolist())), 0
        while at < len(rows):
            _, a, b, s, bits = rows[at]
            group = at + 1
            while group < len(rows) and rows[group][3] == s and rows[group][1] < b and rows[group][2] <= a + (3 << s) // 2 and bits < BITS:
                b, bits, group = max(b, rows[group][2]), bits + rows[group][4] + 1, group + 1
            mine = order[at:group]
            unique, back = np.unique(item[mine], return_inverse=True)
            got = edit_search([self.items[i] for i in unique], ids[a:b])
            distance[mine], end[mine] = got[0][back], got[1][back] + a
            at = group
        return distance, end


#: Bytes of marks that a search keeps before it adds them up, and words of an item beyond which its bits would take more
#: memory than a row of distances.
MARKS, LONG = 4 << 20, 20_000


def edit_row(item: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Edit distance of the item to the best run of the region that ends before each of its positions."""
    place = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for w in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != w))
        # insertions: the least of what stands to the left plus the way from there
        row = np.minimum.accumulate(new - place) + place
    return row


def edit_search(items: list[np.ndarray], region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest edit distance of each item to a run of the region, the first end of such a run), by Myers' bit-parallel
    algorithm. Every item has the bits of its words in one integer, and a bit above them that stays 0, at which sums stop."""
    size = np.array([len(x) for x in items], np.int64)
    if size.max() > LONG:
        rows = [edit_row(x, region) for x in items]
        return np.array([r.min() for r in rows]), np.array([r.argmin() for r in rows])
    top = np.cumsum(size + 1) - 2  # the bit of each item's last word
    n_bytes = int(top[-1]) // 8 + 1
    words = np.concatenate(items)
    bit = np.arange(len(words)) + np.repeat(np.arange(len(items)), size)

    def number(bits: np.ndarray) -> int:
        held = np.zeros(n_bytes * 8, np.uint8)
        held[bits] = 1
        return int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")

    every, tops = number(bit), number(top)
    there = np.flatnonzero(np.isin(words, region))
    there = there[np.argsort(words[there], kind="stable")]
    bounds = np.flatnonzero(np.append(True, words[there][1:] != words[there][:-1])) if len(there) else there
    equal = {int(words[x[0]]): number(bit[x]) for x in np.split(there, bounds[1:])} if len(there) else {}
    least, end, score = size.copy(), np.zeros(len(items), np.int64), size.copy()
    up, down, marks, done = every, 0, [], 0

    def add_up() -> None:
        nonlocal score, done
        signs = np.frombuffer(b"".join(marks), np.uint8).reshape(-1, 2, n_bytes)[:, :, top >> 3] >> (top & 7).astype(np.uint8) & 1
        scores = score + np.cumsum(signs[:, 0].astype(np.int64) - signs[:, 1], axis=0)
        at = scores.argmin(axis=0)
        lowest = scores[at, np.arange(len(items))]
        better = lowest < least
        least[better], end[better] = lowest[better], (at + done + 1)[better]
        score, done = scores[-1], done + len(scores)
        marks.clear()

    most = 2 * max(16, MARKS // (2 * n_bytes))
    for w in region.tolist():
        eq = equal.get(w, 0)
        across = ((eq & up) + up ^ up) | eq
        more, less = down | every ^ ((across | up) & every), up & across
        marks += (more & tops).to_bytes(n_bytes, "little"), (less & tops).to_bytes(n_bytes, "little")
        eq |= down
        more <<= 1
        up = (less << 1 | every ^ ((eq | more) & every)) & every
        down = more & eq
        if len(marks) >= most:
            add_up()
    if marks:
        add_up()
    return least, end


HITS = "array<struct<item_id:bigint,distance:int,end_word:int,item_words:int>>"
KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end_word", pa.int32()), ("item_words", pa.int32())]))


def finder(index):
    """Text column to array of hits, by a broadcast index."""
    names = [f.name for f in KIND.value_type]
    return text_udf(lambda texts: pa.array([[dict(zip(names, h)) for h in rows] for rows in index.value.hits(texts)], KIND), HITS)


#: Words of the distinct lengths together up to which the driver tries their walks itself.
TRIED_HERE = 4000


def all_walks(rows: DataFrame, share: float = 0.2, target_recall: float = 0.999, bands: int = 6, sampled: int = 2, seed: int = 11) -> dict[int, int]:
    """``walks_of`` every length of the items in column t, tried by tasks where there are many or long ones."""
    words = F.udf(lambda t: len(words_of(t)), "int")
    lengths = sorted(r[0] for r in rows.select(words("t").alias("n")).where("n > 0").distinct().collect())
    how = (share, target_recall, bands, sampled, seed)
    if sum(lengths) <= TRIED_HERE:
        return {n: walks_of(n, *how) for n in lengths}
    spark = rows.sparkSession
    tasks = max(1, min(len(lengths), 4 * spark.sparkContext.defaultParallelism))
    tried = F.udf(lambda n: walks_of(n, *how), "int")
    dealt = spark.createDataFrame([(n,) for n in lengths], "n int").repartition(tasks, "n")
    return {r["n"]: r["walks"] for r in dealt.select("n", tried("n").alias("walks")).collect()}


class Blocks:
    """The indexes of the items' blocks, each built when it is asked for."""

    def __init__(self, items: DataFrame, item_id: str, text: str, **how):
        self.rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
        total = self.rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
        self.count, self.how = -(-total // BLOCK_CHARS) or 1, how
        if "walks" not in how:
            self.how = how | {"walks": all_walks(self.rows, **how)}

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[Index]:
        for b in range(self.count):
            yield Index([(r["i"], r["t"]) for r in self.rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.count)) == b).collect()], **self.how)


def indexes(items: DataFrame, item_id: str, text: str, **how) -> Blocks:
    return Blocks(items, item_id, text, **how)


def with_hits(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "hits", **how) -> DataFrame:
    """df with an array column of the benchmark items that its text holds, by item id."""
    context = df.sparkSession.sparkContext
    blocks = indexes(items, item_id, item_text, **how)
    if len(blocks) == 1:
        return df.withColumn(into, finder(context.broadcast(next(iter(blocks))))(F.col(text).cast("string")))
    row, found = unused("_row", df), []
    texts = stored(df.withColumn(row, F.monotonically_increasing_id()), "texts")
    for index in blocks:
        sent = context.broadcast(index)
        found.append(stored(texts.select(F.col(row).alias("_r"), finder(sent)(F.col(text).cast("string")).alias("_h")).where(F.size("_h") > 0), "hits"))
        sent.destroy()
    # an item is in one block, so a row has as many hits here as it has items
    merged = reduce(DataFrame.union, found).groupBy("_r").agg(F.array_sort(F.flatten(F.collect_list("_h"))).alias("_h"))
    joined = texts.join(merged, F.col(row) == F.col("_r"), "left")
    kept = [c for c in df.columns if c != into]
    return joined.select(*[texts[f"`{c}`"] for c in kept], F.coalesce("_h", F.array().cast(HITS)).alias(into))

