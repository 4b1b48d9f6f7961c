"""Search terms in one regular-expression dialect, compiled for Java (Spark) and RE2 (DuckDB).

A term is one or more patterns joined by &&, all of which must be found. In a pattern \\w is a letter, digit or underscore
of any script and \\b the boundary between those and others. RE2 can't look around, so there \\b may stand at the ends of
a pattern only.
"""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"
OTHER = r"[^\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def parts(term: str) -> list[str]:
    found = [p.strip() for p in term.split("&&")]
    if not all(found):
        raise ValueError(f"an empty part in {term!r}")
    for p in found:
        re.compile(p)
    return found


def _elements(pattern: str) -> list[tuple[str, str]]:
    """(element, quantifier) of a pattern in order; an element is a character, an escape, a class or a group."""
    return [(m[1], m[2] or "") for m in re.finditer(r"(\\.|\[(?:\\.|[^\]])*\]|\((?:\\.|[^()\\]|\([^()]*\))*\)|[^\\])((?:[*+?]|\{[^}]*\})[?+]?)?", pattern, re.S)]


def _is_word(elements: list[tuple[str, str]], step: int) -> bool:
    """What the elements match surely begins (step 1) or ends (step -1) with a word character."""
    for element, quantifier in elements[::step]:
        if element.startswith("("):
            inner = re.sub(r"^\((\?:)?", "", element)[:-1]
            sure = "(" not in inner and "\\" not in inner.replace("\\w", "") and all(_is_word(_elements(x), step) for x in inner.split("|"))
        else:
            sure = element == r"\w" or len(element) == 1 and (element.isalnum() or element == "_")
        if not sure:
            return False
        if not quantifier.startswith(("*", "?", "{0", "{,")):
            return True
    return False


def _translated(pattern: str, boundary: str | None) -> str:
    """With ``boundary`` for \\b; by default the cheapest look-around that means the same there."""
    out, elements = [], _elements(pattern)
    plain = boundary is None and not any(e == "|" for e, _ in elements)
    for i, (element, quantifier) in enumerate(elements):
        if element == r"\b" and boundary is None:
            if plain and _is_word(elements[i + 1 :], 1):
                element = f"(?<!{WORD})"
            elif plain and _is_word(elements[:i], -1):
                element = f"(?!{WORD})"
            else:
                element = BOUNDARY
            out.append(element + quantifier)
        else:
            out.append(re.sub(r"\\(.)", lambda m: {"w": WORD, "b": BOUNDARY if boundary is None else boundary, "W": OTHER}.get(m[1], m[0]), element, flags=re.S) + quantifier)
    return "".join(out)


def java(pattern: str) -> str:
    return _translated(pattern, None)


def re2(pattern: str) -> str:
    head, tail = "", ""
    if pattern.startswith(r"\b"):
        head, pattern = f"(?:^|{OTHER})", pattern[2:]
    if pattern.endswith(r"\b") and not pattern.endswith(r"\\b"):
        tail, pattern = f"(?:{OTHER}|$)", pattern[:-2]
    if re.search(r"(?<!\\)(?:\\\\)*\\b", pattern):
        raise ValueError(r"\b inside a pattern can't be said in RE2")
    return head + _translated(pattern, "") + tail


#: What Java means and the regex module doesn't, by the piece of a pattern that says it.
JAVA_ONLY = {".": r"[^\n\r\x85\u2028\u2029]", "$": r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)", r"\s": r"[ \t\n\x0B\f\r]", r"\S": r"[^ \t\n\x0B\f\r]", r"\d": "[0-9]", r"\D": "[^0-9]"}


def python(pattern: str) -> str:
    """For the regex module (its version 1), with the meaning that the pattern has in Java."""

    def piece(m: re.Match) -> str:
        inside = re.sub(r"\\.", lambda e: JAVA_ONLY.get(e[0], e[0]), m[0][1:], flags=re.S) if m[0][0] == "[" else None
        return JAVA_ONLY.get(m[0], m[0]) if inside is None else "[" + inside

    return java(re.sub(r"\\.|\[(?:\\.|[^\]])*\]|[.$]", piece, pattern, flags=re.S))


#: Characters that a literal has at least to tell patterns apart.
LEAST_LITERAL = 3


def _branches(pattern: str) -> list[str]:
    """What stands between the |s that aren't in a group."""
    found = [""]
    for element, quantifier in _elements(pattern):
        if element == "|":
            found.append("")
        else:
            found[-1] += element + quantifier
    return found


def needed(pattern: str) -> tuple[frozenset[str], bool] | None:
    """(literals, first): a text that the pattern is found in has one of the literals, and if ``first`` each place where it
    is found begins with one. None if no literal of LEAST_LITERAL characters is sure."""
    branches = _branches(pattern)
    if len(branches) > 1:
        every = [needed(b) for b in branches]
        return None if None in every else (frozenset().union(*(x for x, _ in every)), all(f for _, f in every))
    options: list[tuple[frozenset[str], bool]] = []
    run, begins, leading = "", True, True

    def close() -> None:
        nonlocal run
        if run:
            options.append((frozenset([run]), begins))
        run = ""

    for element, quantifier in _elements(pattern):
        if element in "()" or element.startswith("(?") and not element.startswith("(?:"):
            return None
        sure = not quantifier.startswith(("*", "?", "{0", "{,"))
        letter = element if len(element) == 1 and element not in ".^$" else element[1:] if re.fullmatch(r"\\[^\w]", element, re.S) else None
        if letter is not None and sure:
            if not run:
                begins = leading
            run, leading = run + letter, False
            if quantifier:
                close()
            continue
        close()
        if element.startswith("(") and sure:
            inner = needed(re.sub(r"^\((\?:)?", "", element)[:-1])
            if inner:
                options.append((inner[0], inner[1] and leading))
        leading = leading and element == r"\b" and not quantifier
    close()
    best = max(options, key=lambda o: (min(map(len, o[0])), o[1]), default=None)
    return best if best and min(map(len, best[0])) >= LEAST_LITERAL else None
