"""Boolean trigram queries of regular expressions (after Cox 2012): what every match must contain.

A query is a set of alternatives, each a set of lower-case trigrams: a text can match only if it holds all
trigrams of one alternative. The alternative without trigrams is always true.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

Strings = frozenset[str]
Query = frozenset[frozenset[str]]

ALWAYS: Query = frozenset([frozenset()])
NEVER: Query = frozenset()
#: Sets of strings and of alternatives beyond this size are given up for weaker ones.
MOST = 48
#: Classes of more characters than this are any character.
SMALL_CLASS = 8


def _least(query: Query) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(x for x in query if not any(y < x for y in query))


def both(x: Query, y: Query) -> Query:
    found = _least(frozenset(a | b for a, b in product(x, y)))
    return found if len(found) <= MOST else min(x, y, key=len)


def either(x: Query, y: Query) -> Query:
    found = _least(x | y)
    return found if len(found) <= MOST else ALWAYS


def of_strings(strings: Strings) -> Query:
    """At least one of `strings` is in the text."""
    if any(len(s) < 3 for s in strings):
        return ALWAYS
    found = _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))
    return found if len(found) <= MOST else ALWAYS


@dataclass(frozen=True)
class Shape:
    """What is known of the matches of an expression.

    `exact` are all of them, if few; else each starts with one of `starts` and ends with one of `ends`.
    """

    exact: Strings | None
    starts: Strings
    ends: Strings
    query: Query

    @property
    def heads(self) -> Strings:
        return self.starts if self.exact is None else self.exact

    @property
    def tails(self) -> Strings:
        return self.ends if self.exact is None else self.exact


_EMPTY: Strings = frozenset([""])
NOTHING = Shape(_EMPTY, _EMPTY, _EMPTY, ALWAYS)
ANYTHING = Shape(None, _EMPTY, _EMPTY, ALWAYS)


def _few(strings: Strings, cut) -> Strings:
    """Shorter pieces of `strings` until there are few; those of fewer than three characters say no trigram alone."""
    for size in (8, 4, 3, 2, 1, 0):
        if len(strings) <= MOST:
            break
        strings = frozenset(cut(s, size) for s in strings)
    return strings


def _inexact(shape: Shape) -> Shape:
    """The strings of `exact` as starts and ends, their trigrams in the query."""
    if shape.exact is None:
        return shape
    starts = _few(shape.exact, lambda s, n: s[:n])
    ends = _few(shape.exact, lambda s, n: s[len(s) - min(n, len(s)) :])
    return Shape(None, starts, ends, both(shape.query, of_strings(shape.exact)))


def _join(x: Strings, y: Strings) -> Strings:
    return frozenset(a + b for a, b in product(x, y))


def _then(x: Shape, y: Shape) -> Shape:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST:
        return Shape(_join(x.exact, y.exact), _EMPTY, _EMPTY, both(x.query, y.query))
    query = both(x.query, y.query)
    if len(x.tails) * len(y.heads) <= MOST:  # every match holds an end of x followed by a start of y
        query = both(query, of_strings(_join(x.tails, y.heads)))
    starts = _join(x.exact, y.heads) if x.exact is not None else x.starts
    ends = _join(x.tails, y.exact) if y.exact is not None else y.ends
    x, y = _inexact(x), _inexact(y)
    query = both(query, both(x.query, y.query))
    return Shape(None, _few(starts, lambda s, n: s[:n]), _few(ends, lambda s, n: s[max(0, len(s) - n) :]), query)


def _or(x: Shape, y: Shape) -> Shape:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MOST:
        return Shape(x.exact | y.exact, _EMPTY, _EMPTY, either(x.query, y.query))
    x, y = _inexact(x), _inexact(y)
    starts = _few(x.starts | y.starts, lambda s, n: s[:n])
    ends = _few(x.ends | y.ends, lambda s, n: s[max(0, len(s) - n) :])
    return Shape(None, starts, ends, either(x.query, y.query))


def _characters(found: set[str] | None) -> Shape:
    """One character of a set, None for any."""
    if not found or not all(c.isascii() for c in found):
        return ANYTHING
    lower = frozenset(c.lower() for c in found)
    return Shape(lower, _EMPTY, _EMPTY, ALWAYS) if len(lower) <= SMALL_CLASS else ANYTHING


def _class(items) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < 128:
            found.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return found


def _shape(items) -> Shape:
    whole = NOTHING
    for kind, value in items:
        whole = _then(whole, _item(kind, value))
    return whole


def _item(kind, value) -> Shape:
    if kind is op.LITERAL:
        return _characters({chr(value)})
    if kind is op.IN:
        return _characters(_class(value))
    if kind is op.BRANCH:
        shapes = [_shape(branch) for branch in value[1]]
        whole = shapes[0]
        for shape in shapes[1:]:
            whole = _or(whole, shape)
        return whole
    if kind is op.SUBPATTERN:
        return _shape(value[3])
    if kind is op.ATOMIC_GROUP:
        return _shape(value)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        shape = _shape(inner)
        if least == 0:
            return _or(NOTHING, shape) if most == 1 else ANYTHING
        whole = shape
        for _ in range(min(least, 8) - 1):
            whole = _then(whole, shape)
        if most == least and least <= 8:
            return whole
        # More may follow: it starts with what the least number starts with and ends with any end.
        whole = _inexact(whole)
        return Shape(None, whole.starts, _inexact(shape).ends, whole.query)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return NOTHING
    return ANYTHING


def trigram_query(pattern: str) -> Query:
    """What a text in lower case must hold for `pattern` to match; ALWAYS when nothing is mandatory."""
    return _inexact(_shape(_parser.parse(pattern))).query


def as_alternation(trigrams: frozenset[str], escape) -> str:
    """An expression for one of `trigrams`, shared beginnings once, so a search tries few alternatives."""
    first: dict[str, dict[str, list[str]]] = {}
    for t in sorted(trigrams):
        first.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    parts = []
    for a, rest in first.items():
        inner = [escape(b) + "[" + "".join(map(escape, ends)) + "]" for b, ends in rest.items()]
        parts.append(escape(a) + "(?:" + "|".join(inner) + ")")
    return "|".join(parts)
