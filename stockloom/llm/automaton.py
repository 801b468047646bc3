"""Regular expressions of several rules compiled to one minimal automaton that scans bytes once.

Each rule's expression becomes an NFA, then by subset construction a deterministic automaton that
searches: its states are the sets of NFA states reached from each possible start,
earliest start first, so it finds leftmost, longest, non-overlapping matches. The product of the
rules' automata, reduced to its reachable states and minimised, is a pair of transition arrays
over classes of bytes: the next state, and which rules' matches end before this byte.
Where a match starts is found by running the rule's reversed automaton back from its end.

Compilation refuses rules that one pass cannot serve: those whose match may
have to be given back (a longer one was under way and failed) and those where a
later start matches while an earlier one is open. An expression that ends in a repeated class is neither.

`scan` moves many lanes of the text at once, all from the initial state; a lane whose
predecessor ended in another state is run again from there until it meets
the states it went through before. So the result is that of one pass over the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: A byte that no UTF-8 text holds; it ends every match and resets the automaton.
SEPARATOR = 0xFF
#: Bytes of a lane, and lanes that are moved together.
STEPS, LANES = 1024, 4096
SHORT, FULL = 1, 2


@dataclass(frozen=True)
class Rule:
    """An expression over bytes: literals, \\xHH, [classes], groups, |, ?, *, +, {m}, {m,}, {m,n}.

    `least`: matches that repeat their last item less often are passed over but not reported.
    `fold`: ASCII letters match in either case.
    """

    kind: str
    pattern: str
    least: int = 1
    fold: bool = False


class Parser:
    """Recursive descent over one expression; nodes are tuples (kind, ...)."""

    def __init__(self, rule: Rule):
        self.text, self.at, self.fold = rule.pattern, 0, rule.fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, expected: str = "") -> str:
        c = self.peek()
        if not c or (expected and c != expected):
            raise ValueError(f"bad expression {self.text!r} at {self.at}")
        self.at += 1
        return c

    def parse(self) -> tuple:
        node = self.either()
        if self.at < len(self.text):
            raise ValueError(f"bad expression {self.text!r} at {self.at}")
        return node

    def either(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self) -> tuple:
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated())
        return ("seq", items)

    def repeated(self) -> tuple:
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                span = ""
                while self.peek() != "}":
                    span += self.take()
                self.take()
                low, comma, high = span.partition(",")
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            node = self.either()
            self.take(")")
            return node
        if c == "[":
            return ("set", self.folded(self.members()))
        if c in ")|?*+{}.^$":
            raise ValueError(f"bad expression {self.text!r} at {self.at}")
        return ("set", self.folded({self.code(c)}))

    def code(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            if c == "x":
                return int(self.take() + self.take(), 16)
            if c.isalnum():
                raise ValueError(f"unknown escape \\{c} in {self.text!r}")
        return ord(c)

    def members(self) -> set[int]:
        out: set[int] = set()
        while self.peek() != "]":
            low = high = self.code(self.take())
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.code(self.take())
            out.update(range(low, high + 1))
        self.take()
        return out

    def folded(self, codes: set[int]) -> frozenset[int]:
        if max(codes) > 127:
            raise ValueError("expressions are over ASCII")
        both = {ord(x) for c in codes for x in (chr(c).lower(), chr(c).upper())} if self.fold else codes
        return frozenset(both)


class Nfa:
    """States with byte sets and free moves; `level` marks accepting ones (SHORT or FULL)."""

    def __init__(self, rule: Rule):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.level: dict[int, int] = {}
        self.start = self.new()
        node = Parser(rule).parse()
        if rule.least > 1:
            *head, last = node[1] if node[0] == "seq" else [node]
            if last[0] != "rep" or last[2:] != (1, None):
                raise ValueError("`least` needs an expression that ends in +")
            at = self.build(("seq", head), self.start)
            for _ in range(rule.least - 1):
                at = self.build(last[1], at)
                self.level[at] = SHORT
            self.level[self.build(last, at)] = FULL
        else:
            self.level[self.build(node, self.start)] = FULL
        if self.level.keys() & self.closed([self.start]):
            raise ValueError(f"{rule.pattern!r} matches nothing at all")

    def new(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, node: tuple, at: int) -> int:
        """Add a node's states after `at`; returns where it ends."""
        if node[0] == "set":
            end = self.new()
            self.moves[at].append((node[1], end))
            return end
        if node[0] == "seq":
            for item in node[1]:
                at = self.build(item, at)
            return at
        if node[0] == "or":
            end = self.new()
            for option in node[1]:
                self.free[self.build(option, at)].append(end)
            return end
        _, item, low, high = node
        for _ in range(low):
            at = self.build(item, at)
        if high is None:
            loop, end = self.new(), self.new()
            self.free[at].append(loop)
            self.free[self.build(item, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.new()
        self.free[at].append(end)
        for _ in range(high - low):
            at = self.build(item, at)
            self.free[at].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def sets(self) -> set[frozenset[int]]:
        return {chars for moves in self.moves for chars, _ in moves}

    def move(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed([to for s in states for chars, to in self.moves[s] if byte in chars])

    def of(self, states: frozenset[int]) -> int:
        return max((self.level.get(s, 0) for s in states), default=0)


def explored(first, successors: Callable) -> tuple[list, list[list]]:
    """All states reachable from the first, and for each the list that `successors` gives, states as numbers."""
    number, order, rows = {first: 0}, [first], []
    for state in order:
        row = []
        for to, out in successors(state):
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append((number[to], out))
        rows.append(row)
    return order, rows


def searcher(nfa: Nfa, rule: Rule, samples: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The rule's searching automaton: next state and level of the match that ended, by state and byte class."""
    first = nfa.closed([nfa.start])

    def opened(groups: list, seen: frozenset, byte: int) -> tuple:
        fresh = nfa.move(first, byte) - seen
        return (*groups, fresh) if fresh else tuple(groups)

    def step(groups: tuple, byte: int) -> tuple:
        level = nfa.of(groups[-1]) if groups else 0
        now: list[frozenset[int]] = []
        seen: frozenset[int] = frozenset()
        for g in groups:
            moved = nfa.move(g, byte) - seen
            if moved:
                now.append(moved)
                seen |= moved
                if nfa.of(moved):
                    break
        if level and not now:
            return opened([], seen, byte), level
        if not level and not (now and nfa.of(now[-1])):
            return checked(opened(now, seen, byte)), 0
        if level and not nfa.of(now[-1]):
            raise ValueError(f"{rule.pattern!r} may have to give back what it read")
        return checked(tuple(now)), 0

    def checked(groups: tuple) -> tuple:
        if len(groups) > 1 and nfa.of(groups[-1]):
            raise ValueError(f"{rule.pattern!r} may match from a later start while an earlier one is open")
        return groups

    _, rows = explored((), lambda groups: [step(groups, byte) for byte in samples])
    return np.array([[to for to, _ in r] for r in rows]), np.array([[out for _, out in r] for r in rows])


def reverse(nfa: Nfa) -> tuple[list[list[int]], list[bool]]:
    """Automaton of the reversed matches: by state and byte the next state (0: none), and which states end one."""
    back: list[list[tuple[frozenset[int], int]]] = [[] for _ in nfa.moves]
    free: list[list[int]] = [[] for _ in nfa.moves]
    for s, moves in enumerate(nfa.moves):
        for chars, to in moves:
            back[to].append((chars, s))
        for to in nfa.free[s]:
            free[to].append(s)
    mirror = object.__new__(Nfa)
    mirror.moves, mirror.free, mirror.level, mirror.start = back, free, {nfa.start: FULL}, -1
    first = mirror.closed(list(nfa.level))
    order, rows = explored(first, lambda states: [(mirror.move(states, b), 0) for b in range(256)])
    return [[to if order[to] else -1 for to, _ in r] for r in rows], [bool(mirror.of(s)) for s in order]


def minimised(step: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no text can tell apart, by refining a partition; state 0 stays state 0."""
    label = np.unique(out, axis=0, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([label, label[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == label.max():
            break
        label = finer
    _, one = np.unique(label, return_index=True)
    new = np.argsort(np.argsort(one))  # numbered by their first state
    keep = np.sort(one)
    return new[label][step[keep]], out[keep]


def product(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Reachable states of the rules' automata run side by side; outputs are digits to base 3."""
    sizes = [len(step) for step, _ in parts]
    if np.prod([float(n) for n in sizes]) > 2**62:
        raise ValueError("too many rules for one automaton")
    found = {0: 0}
    todo, steps, outs = np.zeros(1, np.int64), [], []
    while len(todo):
        key, out, weight, rest = 0, 0, 1, todo
        for r, (step, told) in enumerate(parts):
            rest, own = np.divmod(rest, sizes[r])
            key = key + step[own] * weight
            out = out + told[own] * 3**r
            weight *= sizes[r]
        steps.append(key)
        outs.append(out)
        fresh = [k for k in dict.fromkeys(key.reshape(-1).tolist()) if k not in found]
        for k in fresh:
            found[k] = len(found)
        todo = np.array(fresh, np.int64)
    keys, number = np.array(list(found)), np.arange(len(found))
    order = np.argsort(keys)
    table = np.concatenate(steps)
    return number[order][np.searchsorted(keys[order], table)], np.concatenate(outs)


class Automaton:
    """The compiled rules; `matches` lists what they find in bytes."""

    def __init__(self, rules: list[Rule]):
        nfas = [Nfa(r) for r in rules]
        sets = sorted({s for n in nfas for s in n.sets()}, key=sorted)
        kinds: dict[tuple, int] = {}
        self.rules = list(rules)
        self.byte_class = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
        samples = [int(np.argmax(self.byte_class == k)) for k in range(len(kinds))]
        step, out = minimised(*product([minimised(*searcher(n, r, samples)) for n, r in zip(nfas, rules)]))
        self.states, self.classes = step.shape
        #: by state * classes + class: the next state * classes, and the code of what ended
        self.step = (step * self.classes).astype(np.int32).reshape(-1)
        self.out = out.astype(np.int32).reshape(-1)
        self.back = [reverse(n) for n in nfas]

    def scan(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position, code) where matches end before that position; the text must end in SEPARATOR."""
        step, told = self.step.astype(np.int64), self.out != 0
        state = 0
        for at in range(0, len(data), STEPS * LANES):
            block = self.byte_class[data[at : at + STEPS * LANES]]
            lanes = -(-len(block) // STEPS)
            # positions after the end are the separator's class: they leave the initial state as it is
            padded = np.full(lanes * STEPS, self.byte_class[SEPARATOR], np.uint8)
            padded[: len(block)] = block
            chars = np.ascontiguousarray(padded.reshape(lanes, STEPS).T)
            codes = np.empty((STEPS, lanes), np.int64)
            begin = np.zeros(lanes, np.int64)
            begin[0] = state
            now = begin
            for j in range(STEPS):
                np.add(now, chars[j], out=codes[j])
                now = step.take(codes[j])
            while True:
                last = step.take(codes[-1])
                want = np.concatenate([[state], last[:-1]])
                lane = np.flatnonzero(want != begin)
                if not len(lane):
                    break
                begin[lane] = want[lane]
                now = want[lane]
                for j in range(STEPS):
                    code = now + chars[j, lane]
                    met = code == codes[j, lane]
                    if met.any():
                        lane, code = lane[~met], code[~met]
                        if not len(lane):
                            break
                    codes[j, lane] = code
                    now = step.take(code)
            state = int(step[codes[(len(block) - 1) % STEPS, (len(block) - 1) // STEPS]])
            j, lane = np.nonzero(told.take(codes))
            where = lane * STEPS + j
            for i in np.argsort(where):
                if where[i] < len(block):
                    yield at + int(where[i]), int(self.out[codes[j[i], lane[i]]])

    def matches(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(rule number, start, end) of each reported match, by end; separators cut the text."""
        before = [0] * len(self.rules)
        for end, code in self.scan(data):
            for r in range(len(self.rules)):
                code, level = divmod(code, 3)
                if level:
                    start = self.started(r, data, end, before[r])
                    before[r] = end
                    if level == FULL:
                        yield r, start, end

    def started(self, r: int, data: np.ndarray, end: int, least: int) -> int:
        """Where the match of rule r that ends here starts: the farthest end of a reversed match."""
        table, ends = self.back[r]
        state, start = 0, end
        for stop in range(end, least, -4096):  # long matches are read piece by piece
            low = max(least, stop - 4096)
            for i, byte in enumerate(data[low:stop][::-1].tolist()):
                state = table[state][byte]
                if state < 0:
                    return start
                if ends[state]:
                    start = stop - 1 - i
        return start
