"""Paths to elements, as rules for page containers write them, matched while a page is read.

A subset of XPath 1.0: child and descendant steps (``/`` and ``//``) with a name or ``*``, and predicates of attributes
(``@id``, ``@id='x'``, ``!=``), ``contains``, ``starts-with``, ``not``, ``normalize-space`` and ``concat``, ``and``, ``or``,
brackets, and positions (``[2]``, ``position()=2``). What needs more than an element's attributes and what came before it,
as text or ``last()``, is an error when the rule is read.

A path is an automaton whose states are the steps that are done. Every open element has the set of states that end at it
and the set of those that end at it or around it; an element that opens makes a step from a state of its parent's (child)
or of any around it (descendant) if its name and attributes fit. So a page is matched as it is read, without a tree, in
memory that grows with the depth of the page only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

TOKEN = re.compile(r"""\s*(?:("[^"]*"|'[^']*')|(//|!=|[/@()\[\],=*])|(\d+)|([A-Za-z_][\w.-]*))""")
#: An element's attributes and its position go in.
Test = Callable[[dict, int], object]


@dataclass(frozen=True)
class Step:
    anywhere: bool
    name: str
    tests: tuple[Test, ...]


class _Words:
    """The tokens of a path, taken from the left."""

    def __init__(self, path: str):
        self.path, self.left, at = path, [], 0
        while path[at:].strip():
            m = TOKEN.match(path, at)
            if not m:
                raise ValueError(f"{path}: nothing is known that begins with {path[at:at + 10]!r}")
            self.left.append(m[0].strip())
            at = m.end()

    def next_is(self, *words: str) -> bool:
        return bool(self.left) and self.left[0] in words

    def take(self, *words: str) -> str:
        if not self.left or words and self.left[0] not in words:
            raise ValueError(f"{self.path}: {' or '.join(words) or 'more'} is wanted before {''.join(self.left[:3])!r}")
        return self.left.pop(0)


def _squeezed(text: str) -> str:
    return " ".join(re.findall(r"[^ \t\r\n]+", text))


def _value(w: _Words) -> Test:
    """A text or a number."""
    word = w.take()
    if word[0] in "\"'":
        return lambda attrs, at, x=word[1:-1]: x
    if word.isdigit():
        return lambda attrs, at, x=int(word): x
    if word == "@":
        return lambda attrs, at, name=w.take().lower(): attrs.get(name)
    if word not in ("concat", "normalize-space", "contains", "starts-with", "not", "position"):
        raise ValueError(f"{w.path}: {word} is not known")
    w.take("(")
    if word == "not":
        inner = _either(w)
        w.take(")")
        return lambda attrs, at: not inner(attrs, at)
    given: list[Test] = []
    while not w.next_is(")"):
        given.append(_value(w))
        if not w.next_is(")"):
            w.take(",")
    w.take(")")
    wanted = {"position": (0, 0), "normalize-space": (1, 1), "concat": (2, 99)}.get(word, (2, 2))
    if not wanted[0] <= len(given) <= wanted[1]:
        raise ValueError(f"{w.path}: {word} of {len(given)}")
    if word == "position":
        return lambda attrs, at: at
    texts = lambda attrs, at: [str(g(attrs, at) or "") for g in given]
    if word == "concat":
        return lambda attrs, at: "".join(texts(attrs, at))
    if word == "normalize-space":
        return lambda attrs, at: _squeezed(texts(attrs, at)[0])
    fits = str.__contains__ if word == "contains" else str.startswith
    return lambda attrs, at: fits(*texts(attrs, at))


def _compared(w: _Words) -> Test:
    if w.next_is("("):
        w.take("(")
        inner = _either(w)
        w.take(")")
        return inner
    left = _value(w)
    if not w.next_is("=", "!="):
        return left
    equal, right = w.take() == "=", _value(w)

    def test(attrs: dict, at: int) -> bool:
        a, b = left(attrs, at), right(attrs, at)
        # an attribute that isn't there is neither equal nor unequal to anything
        return a is not None and b is not None and (a == b if isinstance(a, int) and isinstance(b, int) else str(a) == str(b)) == equal

    return test


def _joined(w: _Words, word: str, part: Callable[[_Words], Test], how: Callable) -> Test:
    parts = [part(w)]
    while w.next_is(word):
        w.take()
        parts.append(part(w))
    return parts[0] if len(parts) == 1 else lambda attrs, at: how(_holds(p(attrs, at)) for p in parts)


def _holds(value: object) -> bool:
    return value is not None and value is not False and value != ""


def _either(w: _Words) -> Test:
    found = _joined(w, "or", lambda w: _joined(w, "and", _compared, all), any)
    return lambda attrs, at: _holds(found(attrs, at))


def _predicate(w: _Words) -> Test:
    w.take("[")
    if w.left[:1] and w.left[0].isdigit() and w.left[1:2] == ["]"]:
        place = int(w.take())
        w.take("]")
        return lambda attrs, at: at == place
    test = _either(w)
    w.take("]")
    return test


@lru_cache(maxsize=256)
def compiled(path: str) -> tuple[Step, ...]:
    """The steps of a path that begins with / or // (a point before it is allowed)."""
    w = _Words(path.strip().removeprefix("."))
    steps = []
    while w.left:
        anywhere = w.take("/", "//") == "//"
        name, tests = w.take(), []
        if not re.fullmatch(r"\*|[A-Za-z_][\w.-]*", name) or w.next_is("("):
            raise ValueError(f"{path}: {name} is no element")
        while w.next_is("["):
            tests.append(_predicate(w))
        steps.append(Step(anywhere, name.lower(), tuple(tests)))
    if not steps:
        raise ValueError("an empty path")
    return tuple(steps)


class Matcher:
    """The automaton over a page: ``start`` for every element that opens, in order, ``end`` for every one that ends."""

    def __init__(self, path: str):
        self.steps = compiled(path)
        self.states = [(1, 1, Counter())]  # of each open element: done at it, done at or around it, children by test

    def start(self, name: str, attrs: dict[str, str | None]) -> bool:
        """Whether the element is one that the path leads to."""
        parent, around, children = self.states[-1]
        attrs = {k: v or "" for k, v in attrs.items()}
        own = 0
        for k, step in enumerate(self.steps):
            if not (around if step.anywhere else parent) >> k & 1 or step.name not in ("*", name):
                continue
            for t, test in enumerate(step.tests):
                # a position counts the parent's children that have passed the tests before this one
                children[k, t] += 1
                if not test(attrs, children[k, t]):
                    break
            else:
                own |= 2 << k
        self.states.append((own, around | own, Counter()))
        return bool(own >> len(self.steps) & 1)

    def end(self) -> None:
        self.states.pop()
