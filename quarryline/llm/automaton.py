"""Regular expressions to one deterministic automaton over bytes.

A small syntax (literals, classes, groups, ``|``, ``? * + {m} {m,n}``,
``(?i:...)``) becomes a nondeterministic automaton, then by subset
construction a deterministic one, then the minimal one by partition
refinement. All expressions share the automaton; a state says which accept.
"""

from __future__ import annotations

from collections.abc import Sequence


def parse(pattern: str):
    """A tree of ("set", bytes), ("cat", nodes), ("or", nodes), ("rep", node, m, n or None)."""
    at = 0

    def alternatives(fold: bool):
        nonlocal at
        options = [[]]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                options.append([])
            else:
                options[-1].append(repeated(fold))
        parts = [("cat", o) for o in options]
        return parts[0] if len(parts) == 1 else ("or", parts)

    def repeated(fold: bool):
        nonlocal at
        node = atom(fold)
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at:end].partition(",")
                at = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def folded(values: set[int], fold: bool):
        if fold:
            values |= {v ^ 32 for v in values if chr(v).isascii() and chr(v).isalpha()}
        return ("set", frozenset(values))

    def atom(fold: bool):
        nonlocal at
        if pattern[at] == "(":
            if pattern.startswith("(?i:", at):
                at, fold = at + 4, True
            else:
                at += 3 if pattern.startswith("(?:", at) else 1
            node = alternatives(fold)
            at += 1
            return node
        if pattern[at] == "[":
            at += 1
            values: set[int] = set()
            while pattern[at] != "]":
                a = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    values |= set(range(a, char() + 1))
                else:
                    values.add(a)
            at += 1
            return folded(values, fold)
        return folded({char()}, fold)

    return alternatives(False)


def reverse(node):
    """The tree of the reversed language."""
    kind = node[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in node[1][::-1]])
    if kind == "or":
        return ("or", [reverse(x) for x in node[1]])
    return ("rep", reverse(node[1]), *node[2:]) if kind == "rep" else node


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Puts ``node`` behind ``start``; the state behind it."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(x, first)].append(end)
            return end
        _, x, low, high = node
        for _ in range(low):
            start = self.add(x, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(x, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(x, start)
            self.empty[start].append(end)
        return end


class Dfa:
    """next: 256 next states by state (-1: none); accepts: expressions by state; 0 is the start."""

    def __init__(self, trees: Sequence, anywhere: bool = False):
        """anywhere: a match may begin at each byte."""
        nfa = _Nfa()
        start = nfa.state()
        final: dict[int, int] = {}
        for i, tree in enumerate(trees):
            first = nfa.state()
            nfa.empty[start].append(first)
            final[nfa.add(tree, first)] = i

        def close(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        # Bytes that no expression tells apart share a column.
        sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
        kinds: dict[tuple, list[int]] = {}
        for b in range(256):
            kinds.setdefault(tuple(b in s for s in sets), []).append(b)
        columns = list(kinds.values())

        first = close([start])
        number, order, table = {first: 0}, [first], []
        for states in order:  # grows meanwhile
            row = []
            for column in columns:
                to = {t for s in states for chars, t in nfa.moves[s] if column[0] in chars}
                if anywhere:
                    to.add(start)
                if not to:
                    row.append(-1)
                    continue
                target = close(to)
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                row.append(number[target])
            table.append(row)
        accepts = [tuple(sorted({final[s] for s in states if s in final})) for states in order]

        # Moore's refinement: states differ if they accept or lead differently.
        block = [sorted(set(accepts)).index(a) for a in accepts]
        count = len(set(block))
        while True:
            marks = [(block[i], *(block[t] if t >= 0 else -1 for t in row)) for i, row in enumerate(table)]
            names: dict[tuple, int] = {}
            block = [names.setdefault(m, len(names)) for m in marks]
            if len(names) == count:
                break
            count = len(names)
        self.subsets = len(order)
        self.next = [[-1] * 256 for _ in range(count)]
        self.accepts: list[tuple[int, ...]] = [()] * count
        for i, row in enumerate(table):
            self.accepts[block[i]] = accepts[i]
            for column, t in zip(columns, row, strict=True):
                for b in column:
                    self.next[block[i]][b] = block[t] if t >= 0 else -1

    def longest(self, data: bytes, at: int, step: int, bound: int) -> int:
        """The end of the longest match that begins at ``at`` and runs by
        ``step`` (1, or -1: bytes before ``at``, for reversed expressions)
        within ``bound``, or -1."""
        state, best = 0, at if self.accepts[0] else -1
        while at != bound:
            state = self.next[state][data[at if step > 0 else at - 1]]
            if state < 0:
                break
            at += step
            if self.accepts[state]:
                best = at
        return best
