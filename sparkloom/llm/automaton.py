"""Regular expressions over bytes compiled to one deterministic automaton.

The syntax: literals, escapes (backslash and a character, or xHH), classes with ranges and negation, groups, alternation, and the
repeats ? * + {n} {n,} {n,m}. Several patterns share an automaton: its states carry the set of patterns that accept there.
"""

from __future__ import annotations

from collections import defaultdict

Node = tuple


class _Parser:
    def __init__(self, pattern: str, any_case: bool):
        self.s, self.i, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alternation(self) -> Node:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self) -> Node:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat(self.atom()))
        return ("seq", parts)

    def repeat(self, node: Node) -> Node:
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, least, most)
        return node

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord({"t": "\t", "n": "\n", "r": "\r"}.get(c, c))

    def cased(self, found: set[int]) -> Node:
        if self.any_case:
            found = found | {b ^ 32 for b in found if chr(b).isalpha() and b < 128}
        return ("set", frozenset(found))

    def atom(self) -> Node:
        c = self.take()
        if c == "(":
            node = self.alternation()
            self.take()
            return node
        if c == "\\":
            return self.cased({self.escaped()})
        if c != "[":
            return self.cased({ord(c)})
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                c = self.take()
                found.update(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                found.add(low)
        self.take()
        return self.cased(set(range(256)) - found if negated else found)


def parse(pattern: str, any_case: bool = False) -> Node:
    return _Parser(pattern, any_case).alternation()


def backwards(node: Node) -> Node:
    """A pattern for the reversed strings of another's."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", backwards(node[1]), *node[2:])
    parts = [backwards(x) for x in node[1]]
    return (kind, parts[::-1] if kind == "seq" else parts)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node: Node, start: int) -> int:
        """Builds node from start; returns the state after it."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            mid = self.state()
            self.empty[start].append(mid)
            self.moves[mid] = (node[1], end)
            return end
        if kind == "seq":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
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
            end = self.state()
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.empty[start].append(end)
        return end


class Automaton:
    """table[state * 256 + byte] is the next state times 256. States from `accepting` on accept; rules[state] has the patterns' numbers.
    The dead state, from which nothing accepts, is `dead` (or -1). Numbers are premultiplied by 256 all through."""

    def __init__(self, nodes: list[Node], anywhere: bool):
        nfa = _Nfa()
        root = nfa.state()
        final: dict[int, int] = {}
        for number, node in enumerate(nodes):
            first = nfa.state()
            nfa.empty[root].append(first)
            final[nfa.add(node, first)] = number
        classes = self._byte_classes(nfa)
        found, out, accepts = self._subsets(nfa, root, final, classes, anywhere)
        self._minimise(found, out, accepts, classes)

    @staticmethod
    def _byte_classes(nfa: _Nfa) -> list[int]:
        """For each byte the number of its class: bytes that the same moves take are one."""
        kinds: dict[tuple, int] = {}
        sets = list({m[0] for m in nfa.moves if m})
        return [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]

    @staticmethod
    def _subsets(nfa, root, final, classes, anywhere):
        sample = {k: b for b, k in enumerate(classes)}
        by_class = {m: [k for k, b in sample.items() if b in m[0]] for m in {m for m in nfa.moves if m}}
        closures: dict[int, frozenset] = {}

        def closure(state: int) -> frozenset:
            if state not in closures:
                seen, todo = {state}, [state]
                while todo:
                    for t in nfa.empty[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                closures[state] = frozenset(s for s in seen if nfa.moves[s] or s in final)
            return closures[state]

        first = closure(root)
        number, order, out = {first: 0}, [first], []
        for subset in order:
            reach: dict[int, set] = defaultdict(set)
            for s in subset:
                if m := nfa.moves[s]:
                    for k in by_class[m]:
                        reach[k] |= closure(m[1])
            row = []
            for k in range(len(sample)):
                nxt = frozenset(reach.get(k, set()) | first if anywhere else reach.get(k, set()))
                if nxt not in number:
                    number[nxt] = len(order)
                    order.append(nxt)
                row.append(number[nxt])
            out.append(row)
        accepts = [frozenset(final[s] for s in subset if s in final) for subset in order]
        return order, out, accepts

    def _minimise(self, found, out, accepts, classes) -> None:
        """Refines the partition by acceptance until no block's members go to different blocks."""
        block = [0] * len(found)
        kinds: dict = {}
        for i, a in enumerate(accepts):
            block[i] = kinds.setdefault(a, len(kinds))
        while True:
            kinds = {}
            new = [kinds.setdefault((block[i], *(block[j] for j in out[i])), len(kinds)) for i in range(len(found))]
            if len(kinds) == len(set(block)):
                break
            block = new
        members: dict[int, int] = {}
        for i, b in enumerate(block):
            members.setdefault(b, i)
        order = sorted(members, key=lambda b: (bool(accepts[members[b]]), members[b]))
        place = {b: 256 * i for i, b in enumerate(order)}
        self.table = [place[block[out[members[b]][classes[c]]]] for b in order for c in range(256)]
        self.start = place[block[0]]
        self.rules = {place[b]: tuple(sorted(accepts[members[b]])) for b in order if accepts[members[b]]}
        self.accepting = min(self.rules)
        self.dead = next((place[b] for b in order if not accepts[members[b]] and all(block[j] == b for j in out[members[b]])), -1)
        self.states = len(order)

    def longest(self, data: bytes, start: int, step: int = 1) -> int:
        """The number of bytes of the longest match from start on (with step -1: of data[start], data[start - 1] ..), or -1."""
        s, t, best, n, i = self.start, self.table, -1, 0, start
        end = len(data) if step > 0 else -1
        while i != end:
            s = t[s + data[i]]
            n += 1
            i += step
            if s >= self.accepting:
                best = n
            elif s == self.dead:
                break
        return best
