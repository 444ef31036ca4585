"""Matching of foreign patterns in bounded time.

Patterns that users send with their requests are data; a backtracking engine may take exponential time on some of them, and one
such pattern would hold an executor.  Here a pattern whose backtracking is bounded (fixed widths, few alternatives) runs in `re`; any
other is turned into an automaton whose sets of states are kept as they come up.  The text is read once backwards, to
mark where matches begin, and forwards from each match, for where it ends.  Spans are those of `re.finditer`.

What has no automaton (look-around, back-references, atomic groups) or more than `NODES` states counts as a pattern that does not
compile.  Reading on past matches may meet the same text again and again; after `STEPS` steps a character (and some) the pattern
gives no spans for that text.  Both are rules of the pattern and the text, not of the clock.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

try:
    from re import _constants as sc
    from re import _parser as parser
except ImportError:   # before 3.11
    import sre_constants as sc
    import sre_parse as parser

NODES, STEPS, KEPT = 4000, 16, 50_000
#: Ways to match at one place up to which `re` is used.
WAYS = 64


class Unsupported(ValueError):
    """The pattern has no automaton here."""


def _variants(c: str) -> set[str]:
    """The character in either case."""
    forms = {c, c.lower(), c.upper(), c.lower().upper(), c.upper().lower()}
    return {f for f in forms if len(f) == 1}


def _category(name, ascii_only: bool) -> Callable[[str], bool]:
    kind = str(name).rsplit("_", 1)[-1].lower()
    plain = {"digit": str.isdecimal, "space": str.isspace, "word": lambda c: c.isalnum() or c == "_"}.get(kind)
    if plain is None:
        raise Unsupported(str(name))
    test = (lambda c: c.isascii() and plain(c)) if ascii_only else plain
    return (lambda c: not test(c)) if "NOT_" in str(name) else test


def _member(items, flags: int) -> Callable[[str], bool]:
    """Membership in a set of the parser's items."""
    negate, singles, ranges, kinds = False, set(), [], []
    for op, arg in items:
        if op is sc.NEGATE:
            negate = True
        elif op is sc.LITERAL:
            singles.add(chr(arg))
        elif op is sc.RANGE:
            ranges.append((chr(arg[0]), chr(arg[1])))
        elif op is sc.CATEGORY:
            kinds.append(_category(arg, bool(flags & re.A)))
        else:
            raise Unsupported(str(op))
    either = bool(flags & re.I)

    def test(c: str) -> bool:
        forms = _variants(c) if either else (c,)
        found = any(f in singles or any(a <= f <= b for a, b in ranges) for f in forms) or any(k(c) for k in kinds)
        return found != negate

    return test


class _Nodes:
    """States of a pattern: ("read", test, next), ("fork", nexts in order of preference), ("at", kind, next), ("end",)."""

    def __init__(self, tree, flags: int, backwards: bool) -> None:
        self.nodes: list[tuple] = [("end",)]
        self.backwards = backwards
        self.asserts = False
        self.start = self.sequence(tree, flags, 0)

    def add(self, *node) -> int:
        if len(self.nodes) >= NODES:
            raise Unsupported("too many states")
        self.nodes.append(node)
        return len(self.nodes) - 1

    def sequence(self, items, flags: int, then: int) -> int:
        items = list(items)
        for op, arg in items if self.backwards else reversed(items):
            then = self.item(op, arg, flags, then)
        return then

    def item(self, op, arg, flags: int, then: int) -> int:
        if op is sc.LITERAL:
            return self.add("read", _member([(op, arg)], flags), then)
        if op is sc.NOT_LITERAL:
            return self.add("read", _member([(sc.NEGATE, None), (sc.LITERAL, arg)], flags), then)
        if op is sc.ANY:
            return self.add("read", (lambda c: True) if flags & re.S else (lambda c: c != "\n"), then)
        if op is sc.IN:
            return self.add("read", _member(arg, flags), then)
        if op is sc.BRANCH:
            return self.add("fork", [self.sequence(tree, flags, then) for tree in arg[1]])
        if op is sc.SUBPATTERN:
            return self.sequence(arg[3], (flags | arg[1]) & ~arg[2], then)
        if op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            return self.repeat(arg, flags, then, op is sc.MAX_REPEAT)
        if op is sc.AT:
            self.asserts = True
            return self.add("at", str(arg) + (" MULTI" if flags & re.M else "") + (" ASCII" if flags & re.A else ""), then)
        raise Unsupported(str(op))

    def repeat(self, arg, flags: int, then: int, greedy: bool) -> int:
        low, high, tree = arg
        order = (lambda more, done: [more, done]) if greedy else (lambda more, done: [done, more])
        if high is sc.MAXREPEAT:
            loop = self.add("fork", [])
            body = self.sequence(tree, flags, loop)
            self.nodes[loop][1].extend(order(body, then))
            then = loop
        else:
            optional = then      # what is left out, is left out up to the end
            for _ in range(high - low):
                optional = self.add("fork", order(self.sequence(tree, flags, optional), then))
            then = optional
        for _ in range(low):
            then = self.sequence(tree, flags, then)
        return then


def _holds(kind: str, text: str, i: int) -> bool:
    n = len(text)
    if "BOUNDARY" in kind:
        def word(k):
            return 0 <= k < n and (text[k].isalnum() or text[k] == "_") and (text[k].isascii() or "ASCII" not in kind)

        return (word(i - 1) != word(i)) != ("NON_" in kind)
    if "BEGINNING" in kind:
        return i == 0 or "MULTI" in kind and "STRING" not in kind and text[i - 1] == "\n"
    if "END" in kind:
        if i == n:
            return True
        return "STRING" not in kind and text[i] == "\n" and (i == n - 1 or "MULTI" in kind)
    raise Unsupported(kind)


class Automaton:
    """Sets of states reached, worked out once each."""

    def __init__(self, nodes: _Nodes, ordered: bool) -> None:
        self.nodes, self.start, self.ordered = nodes.nodes, nodes.start, ordered
        self.kinds = sorted({n[1] for n in self.nodes if n[0] == "at"})
        self.kept: dict[tuple, tuple[bool, tuple[int, ...]]] = {}

    def context(self, text: str, i: int) -> int:
        """Which assertions hold at a place, as bits."""
        return sum(1 << k for k, kind in enumerate(self.kinds) if _holds(kind, text, i))

    def step(self, states: tuple[int, ...], context: int, c: str) -> tuple[bool, tuple[int, ...]]:
        """Whether a match ends at this place, and the states after the next character.

        Ordered states are by preference: what stands behind an end is given up.
        """
        key = states, context, c
        found = self.kept.get(key)
        if found is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            found = self.kept[key] = self._work(states, context, c)
        return found

    def _work(self, states, context, c):
        seen, out, ended = set(), {}, False
        stack = list(reversed(states))
        while stack:
            s = stack.pop()
            if s in seen:
                continue
            seen.add(s)
            node = self.nodes[s]
            if node[0] == "end":
                ended = True
                if self.ordered:
                    break
            elif node[0] == "fork":
                stack.extend(reversed(node[1]))
            elif node[0] == "at":
                if context >> self.kinds.index(node[1]) & 1:
                    stack.append(node[2])
            elif c and node[1](c):
                out[node[2]] = None
        return ended, tuple(out) if self.ordered else tuple(sorted(out))


class Pattern:
    """A compiled pattern with an automaton in each direction."""

    def __init__(self, pattern: str) -> None:
        tree = parser.parse(pattern)
        flags = tree.state.flags
        self.plain = re.compile(pattern) if ways(tree) <= WAYS else None
        if not self.plain:
            self.ahead = Automaton(_Nodes(tree, flags, False), True)
            self.back = Automaton(_Nodes(tree, flags, True), False)

    def begins(self, text: str) -> bytearray:
        """1 where some match begins."""
        auto, n = self.back, len(text)
        out, states = bytearray(n + 1), ()
        fixed = not auto.kinds
        for i in range(n, -1, -1):
            if auto.start not in states:
                states = tuple(sorted((*states, auto.start)))
            ended, states = auto.step(states, 0 if fixed else auto.context(text, i), text[i - 1] if i else "")
            out[i] = ended
        return out

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Non-empty matches, leftmost first, as in `re`; none once the steps are used up."""
        if self.plain:
            yield from (m.span() for m in self.plain.finditer(text) if m.end() > m.start())
            return
        found, left, at = [], STEPS * len(text) + 10_000, 0
        begins, auto, n = self.begins(text), self.ahead, len(text)
        fixed = not auto.kinds
        while (at := begins.find(1, at)) >= 0:
            end = None
            for empty in (True, False):      # a match of nothing at first, then one that must not be empty
                states, i = (auto.start,), at
                while states and i <= n:
                    if empty or i > at:
                        ended, following = auto.step(states, 0 if fixed else auto.context(text, i), text[i] if i < n else "")
                    else:
                        ended, following = False, self._past_end(states, text, i)
                    if ended:
                        end = i
                    states, i, left = following, i + 1, left - 1
                    if left < 0:
                        return
                if end is not None and end > at:
                    break
            if end is not None and end > at:
                found.append((at, end))
                at = end
            else:
                at += 1
        yield from found

    def _past_end(self, states: tuple[int, ...], text: str, i: int) -> tuple[int, ...]:
        """States after the character at `i`, as if no match ended before it."""
        auto = self.ahead
        stack, seen, out = list(reversed(states)), set(), {}
        context, c = auto.context(text, i), text[i] if i < len(text) else ""
        while stack:
            s = stack.pop()
            if s in seen:
                continue
            seen.add(s)
            node = auto.nodes[s]
            if node[0] == "fork":
                stack.extend(reversed(node[1]))
            elif node[0] == "at" and context >> auto.kinds.index(node[1]) & 1:
                stack.append(node[2])
            elif node[0] == "read" and c and node[1](c):
                out[node[2]] = None
        return tuple(out)


def ways(items) -> float:
    """An upper bound of the ways in which a pattern can match at one place; infinite where it does not end."""
    total = 1.0
    for op, arg in items:
        if op is sc.BRANCH:
            total *= sum(ways(t) for t in arg[1])
        elif op is sc.SUBPATTERN:
            total *= ways(arg[3])
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            low, high, tree = arg
            if high is sc.MAXREPEAT:
                return float("inf")
            inner = ways(tree)
            total *= (high - low + 1) * (inner ** min(high, 64) if inner > 1 else 1)
        elif op not in (sc.LITERAL, sc.NOT_LITERAL, sc.ANY, sc.IN, sc.AT):
            raise Unsupported(str(op))
        if total > WAYS:
            return float("inf")
    return total


@lru_cache(maxsize=1024)
def compiled(pattern: str) -> Pattern | None:
    """The pattern, or None where it does not compile or has no automaton."""
    try:
        return Pattern(pattern)
    except (re.error, Unsupported, OverflowError, RecursionError):
        return None
