"""Deterministic automata over bytes: a small regex compiler with subset construction and minimisation.

Patterns are ASCII: literals, escapes (\\x20, \\., ...), [classes] with ranges and negation, (groups), | * + ?
and {m,n}. ``compile_rules`` builds one automaton for many patterns that finds, in one pass over a text's
bytes, every place where a match of any of them ends.
"""

from __future__ import annotations

from dataclasses import dataclass

_ALL = (1 << 256) - 1


class _Parser:
    """Regex to a tree: ("set", mask) | ("cat", [..]) | ("alt", [..]) | ("rep", node, least, most or None)."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.i, self.ignore_case = pattern, 0, ignore_case

    def parse(self):
        node = self._alt()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return node

    def _more(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _alt(self):
        branches = [self._cat()]
        while self._more() == "|":
            self.i += 1
            branches.append(self._cat())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def _cat(self):
        parts = []
        while self._more() not in ("", "|", ")"):
            parts.append(self._repeat())
        return ("cat", parts)

    def _repeat(self):
        node = self._atom()
        while (c := self._more()) and c in "*+?{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i : end].partition(",")
                node = ("rep", node, int(low), int(high) if high else (int(low) if "," not in self.p[self.i : end] else None))
                self.i = end + 1
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def _escape(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            value = int(self.p[self.i : self.i + 2], 16)
            self.i += 2
            return value
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c}")
        return ord(c)

    def _fold(self, mask: int) -> int:
        if self.ignore_case:
            for b in range(65, 91):
                if mask >> b & 1 or mask >> (b + 32) & 1:
                    mask |= 1 << b | 1 << (b + 32)
        return mask

    def _atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p[self.i : self.i + 2] == "?:":
                self.i += 2
            node = self._alt()
            if self._more() != ")":
                raise ValueError("missing )")
            self.i += 1
            return node
        if c == "[":
            return ("set", self._fold(self._class()))
        if c == "\\":
            return ("set", self._fold(1 << self._escape()))
        if c in "*+?{)":
            raise ValueError(f"unexpected {c!r}")
        return ("set", self._fold(1 << ord(c)))

    def _class(self) -> int:
        negated = self._more() == "^"
        self.i += negated
        mask, first = 0, True
        while first or self.p[self.i] != "]":
            first = False
            low = self._member()
            high = low
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                high = self._member()
            for b in range(low, high + 1):
                mask |= 1 << b
        self.i += 1
        return _ALL & ~mask if negated else mask

    def _member(self) -> int:
        c = self.p[self.i]
        self.i += 1
        return self._escape() if c == "\\" else ord(c)


def _reversed(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    if kind == "rep":
        return ("rep", _reversed(node[1]), *node[2:])
    return node


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        """Build ``node`` from ``start`` on; the state it ends in."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        end = self.state()
        if kind == "alt":
            for x in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(x, first)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(inner, start)
                self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """Transition arrays. A state is its row's offset in ``table``; rows at and after ``accepting`` accept.

    ``classes`` maps a byte to its class (for bytes.translate); ``table[state + class]`` is the next state;
    ``rules`` gives, by state, the numbers of the patterns of which a match ends there.
    """

    classes: bytes
    table: list[int]
    start: int
    accepting: int
    rules: dict[int, tuple[int, ...]]
    dead: int

    def longest(self, data: bytes, start: int, stop: int, step: int = 1) -> int | None:
        """Where the longest match that begins at ``start`` ends, going by ``step`` to ``stop``; None if there is none."""
        state, table, classes, found = self.start, self.table, self.classes, None
        if state >= self.accepting:
            found = start
        for i in range(start, stop, step):
            state = table[state + classes[data[i]]]
            if state >= self.accepting:
                found = i + step
            elif state == self.dead:
                break
        return found


def compile_rules(patterns: list[tuple[str, bool]], anywhere: bool, backwards: bool = False) -> Dfa:
    """One minimal automaton for (pattern, ignore case) pairs; ``anywhere``: matches may begin at any byte."""
    nfa = _Nfa()
    root, finals = nfa.state(), {}
    for k, (pattern, ignore_case) in enumerate(patterns):
        tree = _Parser(pattern, ignore_case).parse()
        first = nfa.state()
        nfa.empty[root].append(first)
        finals[nfa.add(_reversed(tree) if backwards else tree, first)] = k
    masks = {m for moves in nfa.moves for m, _ in moves}
    signature = [tuple(m >> b & 1 for m in masks) for b in range(256)]
    numbers = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = bytes(numbers[s] for s in signature)
    samples = [classes.index(c) for c in range(len(numbers))]
    # Subset construction.
    begin = nfa.closure([root])
    names, rows, todo = {begin: 0}, [], [begin]
    for subset in todo:
        row = []
        for b in samples:
            reached = {t for s in subset for m, t in nfa.moves[s] if m >> b & 1}
            target = nfa.closure(reached | ({root} if anywhere else set()))
            if target not in names:
                names[target] = len(names)
                todo.append(target)
            row.append(names[target])
        rows.append(row)
    accepts = [tuple(sorted(finals[s] for s in subset if s in finals)) for subset in todo]
    # Minimisation by refining the partition of the states until no block is split (Moore).
    block = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    block_of = [block[a] for a in accepts]
    while True:
        keys = [(block_of[s], tuple(block_of[t] for t in rows[s])) for s in range(len(rows))]
        renamed = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        if len(renamed) == len(set(block_of)):
            break
        block_of = [renamed[k] for k in keys]
    member = {}
    for s, b in enumerate(block_of):
        member.setdefault(b, s)
    order = sorted(member, key=lambda b: (bool(accepts[member[b]]), b))
    width = len(samples)
    offset = {b: i * width for i, b in enumerate(order)}
    table = [offset[block_of[t]] for b in order for t in rows[member[b]]]
    accepting = next((offset[b] for b in order if accepts[member[b]]), len(table))
    rules = {offset[b]: accepts[member[b]] for b in order if accepts[member[b]]}
    dead = next((o for b, o in offset.items() if o < accepting and all(table[o + c] == o for c in range(width))), -1)
    return Dfa(classes, table, offset[block_of[0]], accepting, rules, -1 if anywhere else dead)
