"""Regular expressions over bytes as deterministic automata: Thompson construction, subset construction, minimisation.

Syntax: literals, ``\\xHH``, ``\\`` before a sign, classes with ranges and ``^``, groups, ``|``, and the repeats
``? * + {m} {m,} {m,n}``. Patterns are ASCII; there are no anchors, look-arounds or back references.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Tree = tuple


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        c = self.text[self.at]
        self.at += 1
        return c

    def either(self) -> Tree:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self) -> Tree:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("seq", parts)

    def repeat(self) -> Tree:
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                bounds = (int(low), int(high) if high else None if comma else int(low))
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, *bounds)
        return node

    def atom(self) -> Tree:
        c = self.take()
        if c == "(":
            node = self.either()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            self.take()
            return node
        if c == "[":
            return ("set", self.char_class())
        if c == ".":
            return ("set", frozenset(range(256)))
        return ("set", frozenset([self.escape() if c == "\\" else ord(c)]))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def char_class(self) -> frozenset[int]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = high = self.escape() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else ord(c)
            found.update(range(low, high + 1))
        self.take()
        return frozenset(set(range(256)) - found if negated else found)


def parse(pattern: str) -> Tree:
    reader = _Reader(pattern)
    tree = reader.either()
    if reader.at != len(pattern):
        raise ValueError(f"cannot read {pattern!r} from place {reader.at}")
    return tree


def reverse(tree: Tree) -> Tree:
    """The tree of the words read backwards."""
    kind = tree[0]
    if kind == "seq":
        return ("seq", [reverse(t) for t in reversed(tree[1])])
    if kind == "or":
        return ("or", [reverse(t) for t in tree[1]])
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    return tree


def shortest(tree: Tree) -> Tree:
    """The tree without the open end of its last repeat: it matches somewhere in a text exactly if ``tree`` does.

    Runs that end several rules would otherwise be followed side by side, which multiplies the states.
    """
    if tree[0] == "seq" and tree[1]:
        return ("seq", [*tree[1][:-1], shortest(tree[1][-1])])
    if tree[0] == "rep" and tree[2] > 0:
        return ("rep", tree[1], tree[2], tree[2])
    return tree


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.on) - 1

    def add(self, tree: Tree, begin: int) -> int:
        """Build ``tree`` from ``begin``; its end state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            middle = self.state()
            self.free[begin].append(middle)
            self.on[middle] = (tree[1], end)
            return end
        if kind == "seq":
            for t in tree[1]:
                begin = self.add(t, begin)
            return begin
        if kind == "or":
            ends = [self.add(t, begin) for t in tree[1]]
            end = self.state()
            for e in ends:
                self.free[e].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            begin = self.add(inner, begin)
        end = self.state()
        if high is None:
            loop = self.state()
            self.free[begin].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            self.free[loop].append(end)
        else:
            self.free[begin].append(end)
            for _ in range(high - low):
                begin = self.add(inner, begin)
                self.free[begin].append(end)
        return end


class Automaton:
    """Deterministic automaton of several rules.

    ``moves[state * 256 + byte]`` is the next state times 256, ``accepts[state]`` the set of rules, as bits, that end
    there. States that accept something come last, from ``first_accept`` (times 256) on; state 0 is the start.
    ``dead`` is the state (times 256) from which nothing is accepted any more, or -1.
    """

    def __init__(self, trees: Sequence[Tree], anywhere: bool):
        nfa = _Nfa()
        start = nfa.state()
        ends = {nfa.add(t, start): 1 << i for i, t in enumerate(trees)}
        classes, of_byte = self._byte_classes(nfa)
        table, accepts = self._subsets(nfa, start, ends, classes, anywhere)
        table, accepts = self._minimal(table, accepts)
        accepting = np.array([bool(a) for a in accepts])
        order = np.lexsort((np.arange(len(accepts)) != 0, accepting))  # the start leads those that accept nothing
        if accepting[0]:
            raise ValueError("a rule accepts the empty word")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        full = (place[table[order]] * 256)[:, of_byte]
        self.moves: list[int] = full.ravel().tolist()
        self.accepts = [accepts[i] for i in order]
        self.first_accept = int((~accepting).sum()) * 256
        stuck = [s for s in range(self.first_accept // 256) if (full[s] == s * 256).all()]
        self.dead = stuck[0] * 256 if stuck and not anywhere else -1

    @property
    def size(self) -> int:
        return len(self.accepts)

    @staticmethod
    def _byte_classes(nfa: _Nfa) -> tuple[list[int], np.ndarray]:
        """Bytes that no rule tells apart share a class: one byte of each class, and the class of each byte."""
        seen: dict[tuple[bool, ...], int] = {}
        sets = list({edge[0] for edge in nfa.on if edge})
        of_byte = np.array([seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)])
        return [int(np.argmax(of_byte == c)) for c in range(len(seen))], of_byte

    @staticmethod
    def _subsets(
        nfa: _Nfa, start: int, ends: dict[int, int], classes: list[int], anywhere: bool
    ) -> tuple[np.ndarray, list[int]]:
        def closure(states: set[int]) -> frozenset[int]:
            todo, found = list(states), set(states)
            while todo:
                for n in nfa.free[todo.pop()]:
                    if n not in found:
                        found.add(n)
                        todo.append(n)
            return frozenset(s for s in found if nfa.on[s] or s in ends)

        first = closure({start})
        index, rows, accepts, todo = {first: 0}, [], [], [first]
        for subset in todo:
            row = []
            for byte in classes:
                reached = {e[1] for s in subset if (e := nfa.on[s]) and byte in e[0]}
                target = closure(reached | {start} if anywhere else reached)
                if target not in index:
                    index[target] = len(index)
                    todo.append(target)
                row.append(index[target])
            rows.append(row)
            accepts.append(sum({ends[s] for s in subset if s in ends}))
        return np.array(rows), accepts

    @staticmethod
    def _minimal(table: np.ndarray, accepts: list[int]) -> tuple[np.ndarray, list[int]]:
        """Merge states that no continuation tells apart; the start keeps number 0."""
        part = np.unique(np.array(accepts), return_inverse=True)[1]
        while True:
            _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
            if finer.max() == part.max():
                break
            part = finer
        names: dict[int, int] = {}
        for p in part:
            names.setdefault(int(p), len(names))
        part = np.array([names[int(p)] for p in part])
        one = np.array([int(np.argmax(part == p)) for p in range(len(names))])
        return part[table[one]], [accepts[i] for i in one]
