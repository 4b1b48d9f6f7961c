"""Language identification of code-switched text by a linear-chain conditional random field over words.

Each word gets a score for each language from its affixes, its character n-grams and its entry in a lexicon of
frequent words; learned transition scores tie neighbouring words together. Forward-backward gives each word's
marginal over the languages: ``label_words`` returns every word's likeliest language, ``predict`` the text's, the one with
the largest sum of marginals, its score being that sum's share.

Training: for each language about ``per_label`` windows of whole texts, taken by a hash of their text, are brought
to the driver (the bound is ``per_label`` times the number of languages; nothing else of the corpus is). Windows
of different languages are spliced into sequences, so that transitions are learned from switches too.

Defined results: a null text, an empty one and one without a letter are ``und`` with score 0. Repeated rows get
equal results. With no labelled text every result is ``und`` with score 0. Ties go to the language that sorts
first. Texts may be of any length and are read whole; a task needs some 100 bytes for each word of its longest text and
language. Other columns pass through untouched; a column of the name ``into`` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_udf

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
BITS = 17
#: Words in a sequence are cut into runs of this many; runs are worked on side by side.
RUN = 256
#: Distinct words that a task keeps the scores of.
CACHED_WORDS = 300_000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; none if no character is a letter."""
    if not text or not any(map(str.isalpha, text)):
        return []
    return WORD.findall(text.lower())


def feature_rows(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hashed feature) of every affix and n-gram of every word.

    With ^ and $ as a word's ends: n-grams of 1 to 3 characters, and the 4-grams at either end. Prefixes and
    suffixes are the n-grams that hold an end."""
    joined = "\x02" + "\x03\x02".join(words) + "\x03"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    opens, closes = c == 2, c == 3
    word = np.cumsum(opens) - 1
    owners, hashed = [], []
    h = np.zeros(len(c), dtype=np.uint64)
    for n in range(1, 5):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        keep = word[:m] == word[n - 1 :]
        if n == 4:
            keep &= opens[:m] | closes[n - 1 :]
        if n == 1:
            keep &= ~(opens | closes)
        mixed = (h[keep] ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        owners.append(word[:m][keep])
        hashed.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(hashed)


def messages(before: np.ndarray | None, after: np.ndarray | None, step: np.ndarray, first: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised messages along all sequences laid end to end, [T, K].

    Each is the one before it, times ``before``, times the matrix ``step``, or ``start`` where ``first`` is True;
    then times ``after``. Runs of RUN words are worked on side by side: once from each of the K unit messages,
    which gives each run's transfer matrix; the messages that enter the runs follow from these; then once more
    from those."""
    T, K = len(first), len(start)
    runs = -(-T // RUN)
    pad = runs * RUN - T

    def folded(x: np.ndarray | None, fill: float) -> np.ndarray | None:
        if x is None:
            return None
        if pad:
            x = np.concatenate([x, np.full((pad, *x.shape[1:]), fill, dtype=x.dtype)])
        return np.ascontiguousarray(np.swapaxes(x.reshape(runs, RUN, *x.shape[1:]), 0, 1))

    before, after, first = folded(before, 1), folded(after, 1), folded(first, 0)
    some = first.any(axis=1)

    def moved(a: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        if before is not None:
            a = a * before[t]
        a = a @ step
        if some[t]:
            a[..., first[t], :] = start
        if after is not None:
            a *= after[t]
        total = a.sum(axis=-1, keepdims=True)
        a /= total
        return a, total[..., 0]

    unit = np.repeat(np.eye(K)[:, None, :], runs, axis=1)
    scale = np.zeros((K, runs))
    for t in range(RUN):
        unit, total = moved(unit, t)
        scale += np.log(total)
    transfer = unit * np.exp(scale - scale.max(axis=0))[..., None]
    enter = np.empty((runs, K))
    a = np.full(K, 1.0 / K)
    for r in range(runs):
        enter[r] = a
        a = a @ transfer[:, r]
        a /= a.sum()
    out = np.empty((RUN, runs, K))
    a = enter
    for t in range(RUN):
        a, _ = moved(a, t)
        out[t] = a
    return np.swapaxes(out, 0, 1).reshape(runs * RUN, K)[:T]


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals [T, K], forward messages, messages from the right) of all sequences laid end to end."""
    emit = np.exp(score - score.max(axis=1, keepdims=True))
    A, s = np.exp(trans), np.exp(start - start.max())
    last = np.append(first[1:], True)
    alpha = messages(None, emit, A, first, s / s.sum())
    following = np.concatenate([np.ones((1, len(s))), emit[:0:-1]])
    beta = messages(following, None, A.T, last[::-1], np.full(len(s), 1.0 / len(s)))[::-1]
    m = alpha * beta
    return m / m.sum(axis=1, keepdims=True), alpha, beta


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # [2**BITS, K]
    lexicon: dict[str, int]
    lexical: np.ndarray  # [entries + 1, K]; the last row is for words outside the lexicon
    trans: np.ndarray
    start: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of K scores for each word."""
        out = np.zeros((len(words), len(self.labels)))
        if not words:
            return out
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            owner, h = feature_rows(part)
            for k in range(out.shape[1]):
                out[at : at + len(part), k] = np.bincount(owner, weights=self.weights[h, k], minlength=len(part))
        out += self.lexical[[self.lexicon.get(w, -1) for w in words]]
        return out


def train(samples: list[tuple[str, str]], rounds: int = 40, lexicon_size: int = 20_000, rate: float = 0.3, l2: float = 1e-3) -> Model | None:
    """A model of (language, text window) pairs; None if no window has a word."""
    windows = [(lang, w) for lang, text in sorted(samples) if (w := words_of(text))]
    if not windows:
        return None
    labels = sorted({lang for lang, _ in windows})
    K, code = len(labels), {x: i for i, x in enumerate(labels)}
    order = np.random.default_rng(1).permutation(len(windows))
    tokens: list[str] = []
    truth: list[int] = []
    first: list[bool] = []
    for n, i in enumerate(order):  # three windows in a row make a sequence
        lang, words = windows[i]
        tokens += words
        truth += [code[lang]] * len(words)
        first += [n % 3 == 0] + [False] * (len(words) - 1)
    y, reset = np.array(truth), np.array(first)
    counts = Counter(tokens)
    lexicon = {w: i for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]) if n >= 3}
    vocabulary = sorted(counts)
    number = {w: i for i, w in enumerate(vocabulary)}
    ids = np.array([number[w] for w in tokens])
    entry = np.array([lexicon.get(w, len(lexicon)) for w in vocabulary])
    owner, h = feature_rows(vocabulary)
    model = Model(labels, np.zeros((1 << BITS, K)), lexicon, np.zeros((len(lexicon) + 1, K)), np.zeros((K, K)), np.zeros(K))
    slots = {id(x): np.full(x.shape, 1e-8) for x in (model.weights, model.lexical, model.trans, model.start)}
    prev, here = np.flatnonzero(~reset) - 1, np.flatnonzero(~reset)
    seen = np.zeros((K, K))
    np.add.at(seen, (y[prev], y[here]), 1)
    gold = np.eye(K)[y]
    for _ in range(rounds):
        by_word = np.empty((len(vocabulary), K))
        for k in range(K):
            by_word[:, k] = np.bincount(owner, weights=model.weights[h, k], minlength=len(vocabulary))
        by_word += model.lexical[entry]
        score = by_word[ids]
        m, alpha, beta = marginals(score, reset, model.trans, model.start)
        right = np.exp(score - score.max(axis=1, keepdims=True)) * beta
        pair = alpha[prev][:, :, None] * np.exp(model.trans)[None] * right[here][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        diff, by = gold - m, np.empty_like(by_word)
        for k in range(K):
            by[:, k] = np.bincount(ids, weights=diff[:, k], minlength=len(vocabulary))
        grad_w, grad_l = np.empty_like(model.weights), np.empty_like(model.lexical)
        for k in range(K):
            grad_w[:, k] = np.bincount(h, weights=by[owner, k], minlength=1 << BITS)
            grad_l[:, k] = np.bincount(entry, weights=by[:, k], minlength=len(lexicon) + 1)
        grads = ((model.weights, grad_w), (model.lexical, grad_l), (model.trans, seen - pair.sum(axis=0)), (model.start, diff[reset].sum(axis=0)))
        for x, g in grads:
            g = g / len(tokens) - l2 * x / 100
            slots[id(x)] += g * g
            x += rate * g / np.sqrt(slots[id(x)])
    model.weights = model.weights.astype(np.float32)
    return model


def sample(df: DataFrame, text: str, label: str, per_label: int = 250, window: int = 1500) -> list[tuple[str, str]]:
    """About ``per_label`` windows of different texts for each label, of at most ``window`` characters from anywhere in
    the text. All of them are used: the share of texts that is taken is set from the number of different texts."""
    known = df.select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("y")).where("y IS NOT NULL AND t RLIKE '[\\\\p{L}]'")
    at = F.xxhash64("t")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.approx_count_distinct(at, 0.02).alias("n")).collect()}
    if not counts:
        return []
    share = F.lit(1.0)
    for y, n in counts.items():
        if n > per_label:
            share = F.when(F.col("y") == y, F.lit(per_label / n)).otherwise(share)
    room = F.greatest(F.length("t") - window, F.lit(1))
    chosen = known.where(F.pmod(at, F.lit(1 << 20)) < share * (1 << 20))
    # copies count once: a text that stands in a third of all rows gives one window
    rows = chosen.select("y", F.substring("t", (F.pmod(F.shiftright(at, 20), room) + 1).cast("int"), F.lit(window)).alias("t")).distinct().collect()
    return [(r["y"], r["t"]) for r in rows]


class Labeller:
    """A model with the scores of the words that were seen."""

    def __init__(self, model: Model):
        self.model = model
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.labels)))

    def marginals(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all words end to end [T, K], number of words of each list); one word at least."""
        if len(self.seen) > CACHED_WORDS:
            self.seen.clear()
            self.rows = self.rows[:0]
        fresh = list(dict.fromkeys(w for x in lists for w in x if w not in self.seen))
        if fresh:
            self.seen.update(zip(fresh, range(len(self.seen), len(self.seen) + len(fresh))))
            self.rows = np.concatenate([self.rows, self.model.scores(fresh)])
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        ids = np.fromiter((self.seen[w] for x in lists for w in x), dtype=np.int64, count=int(lengths.sum()))
        first = np.zeros(len(ids), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        return marginals(self.rows[ids], first, self.model.trans, self.model.start)[0], lengths


RESULT = "struct<lang_pred:string,score:double>"


def predictor(model: Model | None):
    """Text column to struct(lang_pred, score)."""

    def make():
        labeller = Labeller(model) if model else None

        def predict(texts: list[str | None]) -> pa.Array:
            lists = [words_of(t) for t in texts] if model else [[] for _ in texts]
            langs: list[str] = [UNKNOWN] * len(texts)
            scores = np.zeros(len(texts))
            if any(lists):
                m, lengths = labeller.marginals(lists)
                full = np.flatnonzero(lengths)
                share = np.add.reduceat(m, (np.cumsum(lengths) - lengths)[full], axis=0) / lengths[full][:, None]
                best = share.argmax(axis=1)
                scores[full] = np.minimum(share[np.arange(len(full)), best], 1.0)
                for i, k in zip(full, best):
                    langs[i] = model.labels[k]
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

        return predict

    return text_udf(None, RESULT, make)


WORD_LABELS = "array<struct<word:string,lang:string,score:double>>"
WORD_KIND = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))


def label_words(df: DataFrame, model: Model | None, text: str = "text", into: str = "word_labels") -> DataFrame:
    """df with an array column: each word of the text, in lower case, with its likeliest language and that one's marginal.
    Empty for texts without a letter, and without a model."""

    def make():
        labeller = Labeller(model) if model else None

        def label(texts: list[str | None]) -> pa.Array:
            lists = [words_of(t) for t in texts] if model else [[] for _ in texts]
            if not any(lists):
                return pa.array([[] for _ in texts], WORD_KIND)
            m, lengths = labeller.marginals(lists)
            best = m.argmax(axis=1)
            words = pa.array([w for x in lists for w in x], pa.string())
            langs = pa.array(model.labels, pa.string()).take(pa.array(best))
            each = pa.StructArray.from_arrays([words, langs, pa.array(m[np.arange(len(best)), best], pa.float64())], ["word", "lang", "score"])
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), each)

        return label

    return df.withColumn(into, text_udf(None, WORD_LABELS, make)(F.col(text).cast("string")))


def fit(df: DataFrame, text: str = "text", label: str = "lang", **how: int) -> Model | None:
    return train(sample(df, text, label, **how))


def predict(df: DataFrame, model: Model | None, text: str = "text", into: str = "language") -> DataFrame:
    """df with the struct column ``into`` (lang_pred, score)."""
    return df.withColumn(into, predictor(model)(F.col(text).cast("string")))

