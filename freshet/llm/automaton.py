"""One minimal deterministic automaton for many byte patterns, and its scan of many texts in one pass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of text that a lane of the scan is meant to hold.
LANE = 2048


class _Parser:
    """Patterns over bytes: literals, escapes, classes, groups, |, *, +, ? and {m}, {m,}, {m,n}, as a nested tuple."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        tree = self.either()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def either(self):
        options = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        items = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            items.append(self.repeated(self.atom()))
        return ("seq", items)

    def repeated(self, tree):
        while self.i < len(self.p) and self.p[self.i] in "*+?{":
            c = self.p[self.i]
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i + 1 : end].partition(",")
                least, most = int(low), (int(high) if high else None) if "," in self.p[self.i : end] else int(low)
                self.i = end + 1
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
                self.i += 1
            tree = ("rep", tree, least, most)
        return tree

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 3 if self.p.startswith("(?:", self.i) else 1
            tree = self.either()
            if self.i >= len(self.p):
                raise ValueError("a group isn't closed")
            self.i += 1
            return tree
        if c == "[":
            return ("set", self.bracket())
        return ("set", frozenset([self.char()]))

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def bracket(self) -> frozenset[int]:
        self.i += 1
        negated = self.p[self.i] == "^"
        self.i += negated
        found: set[int] = set()
        while self.p[self.i] != "]":
            low = self.char()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                found.update(range(low, self.char() + 1))
            else:
                found.add(low)
        self.i += 1
        return frozenset(set(range(256)) - found if negated else found)


def _either_case(tree):
    kind = tree[0]
    if kind == "set":
        return ("set", frozenset(ord(f(chr(b))) if b < 128 else b for b in tree[1] for f in (str.lower, str.upper)))
    if kind == "rep":
        return ("rep", _either_case(tree[1]), *tree[2:])
    return (kind, [_either_case(x) for x in tree[1]])


def _reversed(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", _reversed(tree[1]), *tree[2:])
    return (kind, [_reversed(x) for x in (tree[1][::-1] if kind == "seq" else tree[1])])


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Adds tree from the state start; the state it ends in."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "seq":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in tree[1]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(x, own)].append(end)
            return end
        _, inner, least, most = tree
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


@dataclass
class Dfa:
    """step[state, byte_class]; states are in order of acceptance, those from first_accepting on accept."""

    step: np.ndarray
    byte_class: np.ndarray
    accepts: np.ndarray  # a bit for each rule
    start: int
    first_accepting: int
    resets: np.ndarray  # bytes after which every state is the start

    def table(self) -> list[list[int]]:
        return self.step[:, self.byte_class].tolist()


def compiled(trees: list, anchored: bool) -> Dfa:
    """Subset construction over classes of bytes that no rule tells apart, then minimisation by refinement."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {nfa.add(tree, root): 1 << k for k, tree in enumerate(trees)}
    if not anchored:
        nfa.moves[root].append((frozenset(range(256)), root))
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    kinds: dict[tuple, int] = {}
    byte_class = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.int64)
    sample = [int(np.argmax(byte_class == c)) for c in range(len(kinds))]

    closures: dict[int, frozenset[int]] = {}

    def closure(state: int) -> frozenset[int]:
        if state not in closures:
            found, todo = {state}, [state]
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in found:
                        found.add(x)
                        todo.append(x)
            closures[state] = frozenset(x for x in found if nfa.moves[x] or x in ends)
        return closures[state]

    moves = [[[t for s, t in m if sample[c] in s] for c in range(len(kinds))] for m in nfa.moves]
    number = {closure(root): 0}
    todo, rows = [closure(root)], []
    while len(rows) < len(todo):
        row = []
        for c in range(len(kinds)):
            to = frozenset().union(*(closure(t) for s in todo[len(rows)] for t in moves[s][c]))
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    step = np.array(rows, np.int64)
    accepts = np.array([sum(ends.get(s, 0) for s in states) for states in todo], np.int64)

    block = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    chosen = np.unique(block, return_index=True)[1]
    order = chosen[np.argsort(accepts[chosen] > 0, kind="stable")]
    renumbered = np.empty(len(order), np.int64)
    renumbered[block[order]] = np.arange(len(order))
    step, accepts, start = renumbered[block[step[order]]], accepts[order], int(renumbered[block[0]])
    resets = (step == start).all(axis=0)[byte_class]
    return Dfa(step, byte_class, accepts, start, int((accepts == 0).sum()), resets)


@dataclass
class Rule:
    """A pattern, head then body. Matches of which fewer than `least` bytes lie in the body are dropped."""

    kind: str
    head: str
    body: str
    either_case: bool = False  # of letters in the head
    least: int = 0

    def head_tree(self):
        tree = _Parser(self.head).parse()
        return _either_case(tree) if self.either_case else tree

    def tree(self):
        return ("seq", [self.head_tree(), _Parser(self.body).parse()])


class Scanner:
    """All rules' matches, leftmost and longest, not overlapping within a rule.

    The combined automaton marks, in one pass over the bytes, where a match of which rules can end. Only there a
    rule's reversed automaton finds the match's first byte and its anchored one the last. Rules must be such that
    of two overlapping matches the one that starts first also comes first to a place where it could end.
    """

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        trees = [r.tree() for r in rules]
        self.all = compiled(trees, anchored=False)
        self.forward = [(d := compiled([t], anchored=True), d.table(), d.accepts.tolist()) for t in trees]
        self.heads = [(d := compiled([r.head_tree()], anchored=True), d.table(), d.accepts.tolist()) for r in rules]
        self.backward = [(d := compiled([_reversed(t)], anchored=True), d.table(), d.accepts.tolist()) for t in trees]
        if not self.all.resets[10]:
            raise ValueError("no rule may match a line feed")

    def ends(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions after which a match may end, ascending, and the bits of their rules."""
        dfa, text = self.all, np.frombuffer(data, np.uint8)
        if not len(text):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        stops = np.flatnonzero(dfa.resets[text]) + 1  # a lane may begin after any of them
        wanted = np.arange(LANE, len(text), LANE)
        at = np.searchsorted(stops, wanted)
        cuts = np.unique(np.concatenate([[0], stops[at[at < len(stops)]], [len(text)]]))
        starts, sizes = cuts[:-1], np.diff(cuts)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        width = dfa.step.shape[1]
        step = (dfa.step * width).ravel()
        classes = dfa.byte_class[text].astype(np.int32)
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        state = np.full(len(starts), dfa.start * width, np.int64)
        at = starts.copy()
        limit = dfa.first_accepting * width
        places, masks = [], []
        for n in active.tolist():
            if n < len(state):
                state, at = state[:n], at[:n]
            state = step[state + classes[at]]
            at += 1
            if state.max() >= limit:
                hit = np.flatnonzero(state >= limit)
                places.append(at[hit])
                masks.append(dfa.accepts[state[hit] // width])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        places, masks = np.concatenate(places), np.concatenate(masks)
        order = np.argsort(places, kind="stable")
        return places[order], masks[order]

    def _begin(self, k: int, data: bytes, end: int, low: int) -> int:
        """The first byte, from low on, of a match that ends at end."""
        dfa, table, accepts = self.backward[k]
        state, best, dead = dfa.start, -1, self._dead(dfa)
        for i in range(end - 1, low - 1, -1):
            state = table[state][data[i]]
            if accepts[state]:
                best = i
            if state == dead:
                break
        return best

    @staticmethod
    def _dead(dfa: Dfa) -> int:
        """The state that nothing leaves and that doesn't accept; -1 if there is none."""
        if not hasattr(dfa, "_dead_state"):
            own = (dfa.step == np.arange(len(dfa.step))[:, None]).all(axis=1) & (dfa.accepts == 0)
            dfa._dead_state = int(np.flatnonzero(own)[0]) if own.any() else -1
        return dfa._dead_state

    def _longest(self, automaton: tuple, data: bytes, start: int) -> int:
        """Where the longest match from start ends."""
        dfa, table, accepts = automaton
        state, best, dead = dfa.start, start, self._dead(dfa)
        for i in range(start, len(data)):
            state = table[state][data[i]]
            if state == dead:
                break
            if accepts[state]:
                best = i + 1
        return best

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text the (start, end, rule) of all matches that are long enough, in bytes, by start and rule."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        joined = b"\n".join(texts)
        places, masks = self.ends(joined)
        if not len(places):
            return found
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        owner = np.searchsorted(begins, places - 1, side="right") - 1
        for k, rule in enumerate(self.rules):
            mine = (masks >> k) & 1 == 1
            last, low = -1, 0
            for end, doc in zip(places[mine].tolist(), owner[mine].tolist()):
                if doc != last:
                    last, low = doc, 0
                own, end = texts[doc], end - int(begins[doc])
                if end <= low:
                    continue
                start = self._begin(k, own, end, low)
                if start < 0:
                    continue
                low = self._longest(self.forward[k], own, start)
                if low - self._longest(self.heads[k], own, start) >= rule.least:
                    found[doc].append((start, low, k))
        for own in found:
            own.sort(key=lambda x: (x[0], x[2]))
        return found
