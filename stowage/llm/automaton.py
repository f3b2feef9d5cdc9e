"""Regular expressions over bytes as one minimal deterministic automaton.

The expressions of all rules are parsed, joined into one nondeterministic automaton, made deterministic by
subset construction and minimised by partition refinement. The result is a transition array over classes of
bytes that no rule tells apart. Supported: literals, escapes, classes, groups, `|`, `?`, `*`, `+`, `{m}`,
`{m,}`, `{m,n}`, and ASCII letters in either case by a flag.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Node = tuple  # ("bytes", frozenset) | ("seq", [Node]) | ("or", [Node]) | ("many", Node, least, most or None)


def parse(pattern: str, either_case: bool = False) -> Node:
    """The syntax tree of an expression."""
    at = 0

    def one(c: str) -> frozenset[int]:
        return frozenset({ord(c), ord(c.swapcase())}) if either_case and c.isalpha() else frozenset({ord(c)})

    def escaped() -> str:
        nonlocal at
        at += 1
        if pattern[at] == "x":
            at += 3
            return chr(int(pattern[at - 2 : at], 16))
        at += 1
        return {"n": "\n", "t": "\t", "r": "\r"}.get(pattern[at - 1], pattern[at - 1])

    def in_class() -> frozenset[int]:
        nonlocal at
        at += 1
        inverted = pattern[at] == "^"
        at += inverted
        found: set[int] = set()
        while pattern[at] != "]":
            low = high = escaped() if pattern[at] == "\\" else pattern[(at := at + 1) - 1]
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = escaped() if pattern[at] == "\\" else pattern[(at := at + 1) - 1]
            for c in range(ord(low), ord(high) + 1):
                found |= one(chr(c))
        at += 1
        return frozenset(range(256)) - found if inverted else frozenset(found)

    def alternatives() -> Node:
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence() -> Node:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            c = pattern[at]
            if c == "(":
                at += 1
                part = alternatives()
                at += 1
            elif c == "[":
                part = ("bytes", in_class())
            elif c == "\\":
                part = ("bytes", one(escaped()))
            else:
                at += 1
                part = ("bytes", one(c))
            while at < len(pattern) and pattern[at] in "?*+{":
                if pattern[at] == "{":
                    end = pattern.index("}", at)
                    low, comma, high = pattern[at + 1 : end].partition(",")
                    part, at = ("many", part, int(low), int(high) if high else None if comma else int(low)), end + 1
                else:
                    part, at = ("many", part, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]]), at + 1
            parts.append(part)
        return ("seq", parts)

    tree = alternatives()
    if at != len(pattern):
        raise ValueError(f"cannot read {pattern!r} from {at}")
    return tree


def reverse(node: Node) -> Node:
    """The tree of the reversed strings."""
    kind, inner, *rest = node
    if kind == "bytes":
        return node
    if kind == "many":
        return (kind, reverse(inner), *rest)
    return (kind, [reverse(x) for x in (reversed(inner) if kind == "seq" else inner)])


@dataclass
class Automaton:
    """step[state * width + classes[byte]] is the next state times width; state 0 is the start.

    accepts[state] has bit k set if rule k ends there. In an anchored automaton `dead` is the state that
    nothing leaves and no rule accepts.
    """

    classes: np.ndarray
    step: np.ndarray
    width: int
    accepts: np.ndarray
    dead: int


def compiled(trees: list[Node], search: bool) -> Automaton:
    """The minimal automaton of several rules; with search, a match may begin anywhere in the text."""
    edges: list[list[tuple[frozenset[int], int]]] = [[]]
    empty: list[list[int]] = [[]]

    def state() -> int:
        edges.append([])
        empty.append([])
        return len(edges) - 1

    def build(node: Node, start: int) -> int:
        kind, inner, *rest = node
        if kind == "bytes":
            edges[start].append((inner, end := state()))
            return end
        if kind == "seq":
            for x in inner:
                start = build(x, start)
            return start
        if kind == "or":
            end = state()
            for x in inner:
                empty[start].append(begin := state())
                empty[build(x, begin)].append(end)
            return end
        least, most = rest
        for _ in range(least):
            start = build(inner, start)
        if most is None:
            empty[start].append(loop := state())
            empty[build(inner, loop)].append(loop)
            return loop
        ends = [start]
        for _ in range(most - least):
            ends.append(start := build(inner, start))
        end = state()
        for x in ends:
            empty[x].append(end)
        return end

    final: dict[int, int] = {}
    for k, tree in enumerate(trees):
        empty[0].append(begin := state())
        final[build(tree, begin)] = 1 << k

    sets = {s for moves in edges for s, _ in moves}
    of: dict[tuple, int] = {}
    classes = np.array([of.setdefault(tuple(b in s for s in sets), len(of)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(of))]

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    first = closed({0})
    number, queue, table = {first: 0}, [first], []
    for here in queue:  # grows while it is read
        row = []
        for byte in sample:
            there = {t for s in here for moves, t in edges[s] if byte in moves} | ({0} if search else set())
            row.append(number.setdefault(after := closed(there), len(number)))
            if len(number) > len(queue):
                queue.append(after)
        table.append(row)
    accepts = [sum(final.get(s, 0) for s in here) for here in queue]

    step = np.array(table)
    group = np.unique(accepts, return_inverse=True)[1]
    while True:  # split groups until all states of a group go to the same groups
        after = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if after.max() == group.max():
            break
        group = after
    order = np.full(group.max() + 1, -1)
    order[group[0]] = 0
    rest = [g for g in range(len(order)) if g != group[0]]
    order[rest] = np.arange(1, len(order))
    group = order[group]
    width = len(of)
    least = np.zeros((len(order), width), np.int64)
    least[group] = group[step]
    bits = np.zeros(len(order), np.int64)
    bits[group] = accepts
    stays = [s for s in range(len(order)) if (least[s] == s).all() and not bits[s]]
    return Automaton(classes, (least * width).astype(np.int32).reshape(-1), width, bits, (stays or [-1])[0])


def scan(found: Automaton, texts: list[bytes], lanes: int = 4096) -> list[list[tuple[int, int]]]:
    """One pass over the bytes of all texts at once: for each text the (end, rules) of every accepting byte, in order.

    Texts run side by side in lanes, the longest first, so that a step of all lanes is a few array operations.
    """
    events: list[list[tuple[int, int]]] = [[] for _ in texts]
    order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: -len(texts[k]))
    for begin in range(0, len(order), lanes):
        chosen = order[begin : begin + lanes]
        sizes = np.array([len(texts[k]) for k in chosen])
        data = found.classes[np.frombuffer(b"".join(texts[k] for k in chosen), np.uint8)]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ends_at = np.flatnonzero(found.accepts)
        marked = np.zeros(len(found.step), bool)
        marked[ends_at * found.width] = True
        state = np.zeros(len(chosen), np.int32)
        place = starts.copy()
        live, left = len(chosen), sizes[::-1]
        for at in range(int(sizes[0])):
            live = len(chosen) - int(np.searchsorted(left, at, side="right"))
            state = found.step[state[:live] + data[place[:live]]]
            place[:live] += 1
            hit = marked[state]
            if hit.any():
                for k in np.flatnonzero(hit):
                    events[chosen[k]].append((at + 1, int(found.accepts[state[k] // found.width])))
    return events


def longest(found: Automaton, text: bytes, at: int, stop: int, by: int = 1) -> int:
    """Where the longest match of an anchored automaton ends that begins at `at` and goes towards `stop`; -1 if none."""
    state, width, step, classes, accepts, dead = 0, found.width, found.step, found.classes, found.accepts, found.dead * found.width
    end = at if accepts[0] else -1
    while at != stop:
        state = step[state + classes[text[at if by > 0 else at - 1]]]
        if state == dead:
            break
        at += by
        if accepts[state // width]:
            end = at
    return end
