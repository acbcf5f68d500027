"""Byte automata: a small regex dialect -> NFA -> subset construction -> minimal DFA in transition arrays.

The dialect has literals, ``\\xHH`` and escaped characters, ``.``-free classes with ranges, groups, ``|`` and the
quantifiers ``? * + {m} {m,} {m,n}``; patterns are ASCII and match bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

UNBOUNDED = -1


# ---- syntax tree: ("set", frozenset) | ("cat", [..]) | ("alt", [..]) | ("rep", node, lo, hi)

class _Parser:
    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        c = self.p[self.i]
        self.i += 1
        return c

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.quantified(self.atom()))
        return ("cat", items)

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.take()
            return node
        if c == "[":
            return ("set", self.byte_class())
        return ("set", frozenset([self.escaped() if c == "\\" else ord(c)]))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            v = int(self.p[self.i:self.i + 2], 16)
            self.i += 2
            return v
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def byte_class(self) -> frozenset:
        negate = self.peek() == "^"
        if negate:
            self.take()
        out: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            lo = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                c = self.take()
                out.update(range(lo, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                out.add(lo)
        self.take()
        return frozenset(set(range(256)) - out if negate else out)

    def quantified(self, node):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.p.index("}", self.i)
                lo, comma, hi = self.p[self.i:end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(lo), int(hi) if hi else UNBOUNDED if comma else int(lo))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else UNBOUNDED)
        return node


def parse(pattern: str):
    p = _Parser(pattern)
    node = p.alternatives()
    if p.i != len(pattern):
        raise ValueError(f"cannot parse {pattern!r} at {p.i}")
    return node


def either_case(node):
    """The same tree with every ASCII letter in either case."""
    kind = node[0]
    if kind == "set":
        s = set(node[1])
        s.update(b ^ 32 for b in node[1] if 65 <= b <= 90 or 97 <= b <= 122)
        return ("set", frozenset(s))
    if kind == "rep":
        return ("rep", either_case(node[1]), *node[2:])
    return (kind, [either_case(x) for x in node[1]])


# ---- Thompson construction

@dataclass
class Nfa:
    edges: list[list[tuple[frozenset, int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, node, start: int) -> int:
        """Adds ``node`` after ``start``; its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.edges[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                s = self.state()
                self.empty[start].append(s)
                self.empty[self.add(x, s)].append(end)
            return end
        _, inner, lo, hi = node
        for _ in range(lo):
            start = self.add(inner, start)
        if hi == UNBOUNDED:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        for _ in range(hi - lo):
            self.empty[start].append(end)
            start = self.add(inner, start)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def backwards(node):
    """The tree that matches the same strings read from the right."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "cat":
        return ("cat", [backwards(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [backwards(x) for x in node[1]])
    return (kind, backwards(node[1]), *node[2:])


@dataclass(frozen=True)
class Dfa:
    """``table[state, byte]`` is the next state (0 starts); ``accepts[state]`` has the rules that end there, as bits."""

    table: np.ndarray
    accepts: np.ndarray


def compile_rules(trees: list, anchored: bool) -> Dfa:
    """One minimal automaton for all rules. Not anchored: every byte may start a match, so one pass sees all ends."""
    nfa = Nfa()
    start = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        s = nfa.state()
        nfa.empty[start].append(s)
        ends[nfa.add(tree, s)] = k
    # bytes that no set tells apart share a column
    sets = {s for row in nfa.edges for s, _ in row}
    column: dict[tuple, int] = {}
    of_byte = [column.setdefault(tuple(b in s for s in sets), len(column)) for b in range(256)]
    byte_of = {c: b for b, c in reversed(list(enumerate(of_byte)))}
    step = [[[t for on, t in row if byte_of[c] in on] for c in range(len(column))] for row in nfa.edges]
    closed: dict[frozenset, frozenset] = {}
    first = nfa.closure([start])
    index, todo, rows, accepts = {first: 0}, [first], [], []
    while todo:
        states = todo.pop(0)
        accepts.append(sum(1 << k for e, k in ends.items() if e in states))
        row = []
        for c in range(len(column)):
            moved = frozenset(t for s in states for t in step[s][c])
            nxt = closed[moved] if moved in closed else closed.setdefault(moved, nfa.closure(moved))
            if not anchored:
                nxt = nxt | first
            if nxt not in index:
                index[nxt] = len(index)
                todo.append(nxt)
            row.append(index[nxt])
        rows.append(row)
    table, accepts = minimise(np.array(rows), np.array(accepts, dtype=np.int64))
    return Dfa(table[:, of_byte].astype(np.int32), accepts)


def minimise(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement: states stay together while they accept alike and move to the same classes."""
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    # number the classes by first state, so that state 0 stays the start
    order = np.unique(part, return_index=True)[1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[np.argsort(order)] = np.arange(len(order))
    keep = np.sort(order)
    return rank[part[table[keep]]], accepts[keep]
