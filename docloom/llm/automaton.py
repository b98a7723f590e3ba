"""Regular expressions over bytes, compiled to one minimal deterministic automaton.

Understood: literals, ``\\xHH`` and escaped signs, classes without negation, groups, ``(?i:...)``, ``|``, and the counts
``? * + {m} {m,} {m,n}``. Steps: parse, Thompson's construction, subset construction over classes of bytes that no rule
tells apart, and minimisation by refinement of partitions. ``accepts[state]`` has bit k set where rule k ends.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def parse(pattern: str):
    """A tree of ("set", bytes), ("cat", parts), ("or", parts) and ("many", part, least, most or None)."""
    at = 0

    def either(fold: bool):
        nonlocal at
        parts = [chain(fold)]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(chain(fold))
        return parts[0] if len(parts) == 1 else ("or", parts)

    def chain(fold: bool):
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(counted(fold))
        return ("cat", parts)

    def counted(fold: bool):
        nonlocal at
        part = single(fold)
        while at < len(pattern) and pattern[at] in "?*+{":
            sign = pattern[at]
            if sign == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at + 1 : end].partition(",")
                part = ("many", part, int(low), int(high) if high else None if comma else int(low))
                at = end + 1
            else:
                part = ("many", part, int(sign == "+"), 1 if sign == "?" else None)
                at += 1
        return part

    def byte() -> int:
        nonlocal at
        if pattern[at] == "\\":
            if pattern[at + 1] == "x":
                at += 4
                return int(pattern[at - 2 : at], 16)
            at += 1
        at += 1
        return ord(pattern[at - 1])

    def single(fold: bool):
        nonlocal at
        if pattern[at] == "(":
            inner = pattern.startswith("(?i:", at)
            at += 4 if inner else 1
            out = either(fold or inner)
            at += 1
            return out
        found = set()
        if pattern[at] == "[":
            at += 1
            while pattern[at] != "]":
                low = byte()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    found.update(range(low, byte() + 1))
                else:
                    found.add(low)
            at += 1
        else:
            found.add(byte())
        if fold:
            found |= {ord(c) for b in found if chr(b).isalpha() for c in (chr(b).lower(), chr(b).upper())}
        return ("set", frozenset(found))

    out = either(False)
    if at != len(pattern):
        raise ValueError(f"cannot parse {pattern!r} at {at}")
    return out


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []  # moves without a byte
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int, back: bool) -> int:
        """Lay out ``tree`` from ``start``; returns the state after it. ``back``: read from right to left."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            own = self.state()
            self.free[start].append(own)
            self.moves[own] = (tree[1], end)
            return end
        if kind == "cat":
            for part in reversed(tree[1]) if back else tree[1]:
                start = self.add(part, start, back)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(part, own, back)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start, back)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop, back)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start, back)
            self.free[start].append(end)
        return end


class Automaton:
    """``moves[state, classes[byte]]`` is the next state, ``accepts[state]`` the bits of the rules that end there.

    ``search``: rules may begin anywhere, so one pass sees the end of every match. Otherwise matches begin at the first
    byte, and state ``dead`` is one that no match leaves; ``back`` reads them from right to left.
    """

    def __init__(self, patterns: list[str], *, search: bool = False, back: bool = False):
        nfa = _Nfa()
        first = nfa.state()
        ends = {}
        for k, pattern in enumerate(patterns):
            own = nfa.state()
            nfa.free[first].append(own)
            ends[nfa.add(parse(pattern), own, back)] = 1 << k
        sets = {m[0] for m in nfa.moves if m}
        looks = [tuple(b in s for s in sets) for b in range(256)]
        names = {x: i for i, x in enumerate(dict.fromkeys(looks))}
        self.classes = np.array([names[x] for x in looks], np.uint8)
        some = {names[x]: b for b, x in enumerate(looks)}

        def close(states) -> frozenset:
            todo = list(states)
            out = set(todo)
            while todo:
                for x in nfa.free[todo.pop()]:
                    if x not in out:
                        out.add(x)
                        todo.append(x)
            return frozenset(x for x in out if nfa.moves[x] or x in ends)

        start = close([first])
        number, todo, table = {start: 0}, [start], []
        while todo:
            now = todo.pop(0)
            row = []
            for c in range(len(names)):
                to = close(nfa.moves[x][1] for x in now if nfa.moves[x] and some[c] in nfa.moves[x][0])
                if search:
                    to |= start
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
        accepts = [0] * len(number)
        for states, i in number.items():
            for x in states:
                accepts[i] |= ends.get(x, 0)
        self.subsets = len(number)
        self.moves, self.accepts = _minimal(np.array(table), np.array(accepts))
        dead = [i for i in range(len(self.moves)) if (self.moves[i] == i).all() and not self.accepts[i]]
        self.dead = dead[0] if dead else -1
        self._rows = [[int(self.moves[s, self.classes[b]]) for b in range(256)] for s in range(len(self.moves))]
        self._ends = [int(x) for x in self.accepts]

    def longest(self, data: bytes, at: int, stop: int) -> int:
        """Where the longest match from ``at`` ends, at ``stop`` or before; -1 if there is none."""
        state, found, rows, ends, dead = 0, -1, self._rows, self._ends, self.dead
        for i in range(at, stop):
            state = rows[state][data[i]]
            if state == dead:
                break
            if ends[state]:
                found = i + 1
        return found

    def earliest(self, data: bytes, end: int, stop: int) -> int:
        """For a backward automaton: the first start, at ``stop`` or after, of a match that ends at ``end``; -1 if none."""
        state, found, rows, ends, dead = 0, -1, self._rows, self._ends, self.dead
        for i in range(end - 1, stop - 1, -1):
            state = rows[state][data[i]]
            if state == dead:
                break
            if ends[state]:
                found = i
        return found


def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart; state 0 stays the start."""
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        look = np.concatenate([group[:, None], group[table]], axis=1)
        fresh = np.unique(look, axis=0, return_inverse=True)[1].ravel()
        if fresh.max() == group.max():
            break
        group = fresh
    order = {}
    for g in fresh:  # number groups as they first appear, so that the start is 0
        order.setdefault(int(g), len(order))
    group = np.array([order[int(g)] for g in fresh])
    one = np.array([int(np.flatnonzero(group == k)[0]) for k in range(len(order))])
    return group[table[one]].astype(np.int32), accepts[one]


def ends_in_one_pass(auto: Automaton, data: np.ndarray, lane: int = 512) -> dict[int, np.ndarray]:
    """For each rule of a searching automaton, the places right after a byte where a match ends.

    The bytes lie in lanes that step together. A lane first takes the start for the state it begins in; lanes whose
    true first state turns out to be another step again until they meet the states noted before, which takes a few
    bytes, as only the inside of a match is remembered.
    """
    n = len(data)
    many = -(-n // lane)
    padded = np.zeros(many * lane, np.uint8)
    padded[:n] = data
    classes = np.ascontiguousarray(auto.classes[padded].reshape(many, lane).T).astype(np.int32)
    width = auto.moves.shape[1]
    moves = (auto.moves * width).astype(np.int32).ravel()  # states are kept times the width
    seen = np.empty((lane, many), np.int32)
    state = np.zeros(many, np.int32)
    for j in range(lane):
        state = moves[state + classes[j]]
        seen[j] = state
    begun = np.zeros(many, np.int32)
    while True:
        true = np.concatenate([[0], seen[-1][:-1]]).astype(np.int32)
        wrong = np.flatnonzero(true != begun)
        if not len(wrong):
            break
        begun[wrong] = true[wrong]
        state = true[wrong]
        for j in range(lane):
            state = moves[state + classes[j, wrong]]
            differ = state != seen[j, wrong]
            if not differ.all():
                wrong, state = wrong[differ], state[differ]
                if not len(wrong):
                    break
            seen[j, wrong] = state
    hit = np.zeros(len(moves), auto.accepts.dtype)
    hit[:: width] = auto.accepts
    marks = hit[seen]
    step, row = np.nonzero(marks)
    place = row.astype(np.int64) * lane + step
    order = np.argsort(place, kind="stable")
    place, bits = place[order], marks[step, row][order]
    inside = place < n
    place, bits = place[inside], bits[inside]
    out: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(0, np.int64))
    for k in range(int(auto.accepts.max()).bit_length()):
        out[k] = place[(bits >> k & 1).astype(bool)] + 1
    return out
