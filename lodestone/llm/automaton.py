"""Byte regexes to minimal deterministic automata.

The syntax: literals, ``\\xHH`` and escaped literals, classes with ranges and
negation, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

ANY = frozenset(range(256))


class _Parser:
    """Recursive descent to a tree of tuples: set, cat, alt, rep."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def parse(self):
        tree = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.peek()!r} in {self.p!r}")
        return tree

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated(self.atom()))
        return ("cat", items)

    def repeated(self, tree):
        while True:
            c = self.peek()
            if c and c in "?*+":
                self.take()
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            elif m := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.p, self.i):
                self.i = m.end()
                low = int(m[1])
                high = int(m[3]) if m[3] else None if m[2] else low
            else:
                return tree
            tree = ("rep", tree, low, high)

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"open group in {self.p!r}")
            return tree
        if c == "[":
            self.take()
            negated = self.peek() == "^" and bool(self.take())
            chosen: set[int] = set()
            while self.peek() != "]" or not chosen:
                low = self.byte()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    chosen.update(range(low, self.byte() + 1))
                else:
                    chosen.add(low)
            self.take()
            return ("set", ANY - chosen if negated else frozenset(chosen))
        return ("set", frozenset((self.byte(),)))


def either_case(tree):
    """The same tree with ASCII letters in either case."""
    kind, *rest = tree
    if kind == "set":
        low = {b | 32 for b in rest[0] if 65 <= b <= 90}
        up = {b & ~32 for b in rest[0] if 97 <= b <= 122}
        return ("set", rest[0] | low | up)
    if kind == "rep":
        return ("rep", either_case(rest[0]), *rest[1:])
    return (kind, [either_case(x) for x in rest[0]])


def backward(tree):
    """The tree of the reversed language."""
    kind, *rest = tree
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", backward(rest[0]), *rest[1:])
    items = [backward(x) for x in rest[0]]
    return (kind, items[::-1] if kind == "cat" else items)


def parse(pattern: str, ignore_case: bool = False):
    tree = _Parser(pattern).parse()
    return either_case(tree) if ignore_case else tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Adds the tree after ``start``; returns the state behind it."""
        kind, *rest = tree
        if kind == "set":
            end = self.state()
            middle = self.state()
            self.empty[start].append(middle)
            self.step[middle] = (rest[0], end)
            return end
        if kind == "cat":
            for x in rest[0]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in rest[0]:
                head = self.state()
                self.empty[start].append(head)
                self.empty[self.add(x, head)].append(end)
            return end
        inner, low, high = rest
        for _ in range(low):
            start = self.add(inner, start)
        end = self.state()
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            self.empty[start].append(end)
            for _ in range(high - low):
                start = self.add(inner, start)
                self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Dfa:
    """A transition array: the state after ``byte`` is ``next[state + byte]``.

    States are multiples of 256. Those from ``accepting`` on accept;
    ``labels`` has the accepted rules of each. ``dead`` is the state without a
    way on, or -1.
    """

    next: list[int]
    start: int
    accepting: int
    labels: dict[int, tuple[int, ...]]
    dead: int


def build(trees: list, search: bool) -> Dfa:
    """Subset construction over all trees at once, then minimisation.

    With ``search`` a match may begin anywhere; otherwise at the start only.
    """
    nfa = _Nfa()
    heads = [nfa.state() for _ in trees]
    ends = {nfa.add(t, h): k for k, (t, h) in enumerate(zip(trees, heads, strict=True))}

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.step[s] or s in ends)

    # bytes that no class tells apart share a column
    classes = {c for x in nfa.step if x for c in [x[0]]}
    kinds: dict[tuple, list[int]] = {}
    for b in range(256):
        kinds.setdefault(tuple(b in c for c in sorted(classes, key=sorted)), []).append(b)
    columns = list(kinds.values())

    begin = closure(heads)
    states, rows, todo = {begin: 0}, [], [begin]
    while todo:
        now, row = todo.pop(0), []
        for column in columns:
            reached = {nfa.step[s][1] for s in now if nfa.step[s] and column[0] in nfa.step[s][0]}
            after = closure(reached) | begin if search else closure(reached)
            if after not in states:
                states[after] = len(states)
                todo.append(after)
            row.append(states[after])
        rows.append(row)
    label = [tuple(sorted({ends[s] for s in now if s in ends})) for now in states]

    # Moore's refinement: split blocks until successors agree
    block, count = label, -1
    while len(set(block)) != count:
        count = len(set(block))
        names: dict = {}
        block = [names.setdefault((block[s], *(block[t] for t in rows[s])), len(names)) for s in range(len(rows))]
    one = {b: s for s, b in reversed(list(enumerate(block)))}
    order = sorted(one, key=lambda b: (bool(label[one[b]]), b))
    place = {b: 256 * k for k, b in enumerate(order)}
    table = [0] * (256 * len(order))
    for b, s in one.items():
        for column, t in zip(columns, rows[s], strict=True):
            for x in column:
                table[place[b] + x] = place[block[t]]
    accepting = 256 * sum(not label[one[b]] for b in order)
    dead = next((p for b, p in place.items() if p < accepting and all(table[p + x] == p for x in range(256))), -1)
    return Dfa(table, place[block[0]], accepting, {place[b]: label[s] for b, s in one.items() if label[s]}, -1 if search else dead)
