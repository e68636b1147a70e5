"""A weighted Earley parser over token classes, one token at a time.

A rule is `lhs -> symbols` with a weight; weights add up and the parse with the
highest sum is kept.  Symbols that are no left-hand side are terminals and match
one token class; `SOLID` matches any class but `WS`, and `REST`, as the last
symbol of a rule, all tokens up to the end, one at least.  Rules must not be
empty; left recursion makes a list linear.

The state after some tokens is a `Prefix`.  Prefixes form a tree that all parses
share: tokens with the same classes take the same way, and where no rule waits
for a token any longer, what is left of the text needs no look.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

#: Prefixes longer than this are not shared.
SHARED_DEPTH = 200

Tree = tuple  # rule number, first token, end token (None: the end of the text), child trees


class Prefix:
    __slots__ = ("depth", "waiting", "scan", "accepted", "rest", "cut", "children", "known")

    def __init__(self, depth: int):
        self.depth = depth
        self.waiting: dict[str, list[tuple]] = defaultdict(list)  # symbol -> items that wait for it
        self.scan: dict[str, list[tuple]] = defaultdict(list)  # class -> items that take it
        self.accepted: tuple[float, Tree] | None = None  # the best parse of these tokens alone
        self.rest: tuple[float, Tree] | None = None  # the best parse whose REST began before
        self.cut: tuple[float, Tree] | None = None  # the best parse if other tokens follow that nothing waits for
        self.children: dict[str, Prefix] = {}
        self.known: dict[bool, object] = {}  # room for what a user makes of the best parse, by whether the text ends here

    def best(self, ended: bool) -> tuple[float, Tree] | None:
        return _better(self.accepted, self.rest) if ended else self.cut


def _better(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None or (b is not None and b[0] > a[0]) else a


class Grammar:
    def __init__(self, start: str, rules: list[tuple[str, str, float]], most_prefixes: int = 100_000):
        self.start = start
        self.rules = [(lhs, tuple(rhs.split()), weight) for lhs, rhs, weight in rules]
        self.by_lhs: dict[str, list[int]] = defaultdict(list)
        for k, (lhs, _, _) in enumerate(self.rules):
            self.by_lhs[lhs].append(k)
        self.by_lhs = dict(self.by_lhs)
        self.most = most_prefixes
        self.clear()

    def clear(self) -> None:
        self.n_prefixes = 0
        self.root = Prefix(0)
        self._close(self.root, [(k, 0, self.root, self.rules[k][2], ()) for k in self.by_lhs[self.start]])

    def begin(self) -> Prefix:
        """The prefix of no token; the shared tree starts anew when it has grown too large."""
        if self.n_prefixes > self.most:
            self.clear()
        return self.root

    def step(self, at: Prefix, token: str) -> Prefix | None:
        """The prefix one token on; None if nothing waits for the token (`at.best(False)` then is the parse)."""
        child = at.children.get(token)
        if child is not None:
            return child
        takers = at.scan.get(token, ())
        if token != "WS":
            takers = [*takers, *at.scan.get("SOLID", ())]
        if not takers:
            return None
        child = Prefix(at.depth + 1)
        child.rest = at.cut
        self._close(child, [(k, dot + 1, origin, score, kids) for k, dot, origin, score, kids in takers])
        if child.depth <= SHARED_DEPTH:
            at.children[token] = child
            self.n_prefixes += 1
        return child

    def _close(self, at: Prefix, seeds: list[tuple]) -> None:
        """Complete and predict from the items that begin a prefix."""
        chart: dict[tuple, tuple] = {}
        done: dict[tuple, float] = {}
        agenda: list[tuple] = []

        def put(k: int, dot: int, origin: Prefix, score: float, kids: tuple) -> None:
            key = (k, dot, origin.depth)
            old = chart.get(key)
            if old is None or score > old[3]:
                chart[key] = (k, dot, origin, score, kids)
                agenda.append(key)

        for seed in seeds:
            put(*seed)
        waiting: dict[str, dict[tuple, None]] = defaultdict(dict)
        while agenda:
            key = agenda.pop()
            k, dot, origin, score, kids = chart[key]
            lhs, rhs, _ = self.rules[k]
            if dot < len(rhs):
                symbol = rhs[dot]
                if symbol in self.by_lhs:
                    waiting[symbol][key] = None
                    for p in self.by_lhs[symbol]:
                        if (p, 0, at.depth) not in chart:
                            put(p, 0, at, self.rules[p][2], ())
                continue
            known = done.get((lhs, origin.depth))
            if known is not None and known >= score:
                continue
            done[lhs, origin.depth] = score
            tree = (k, origin.depth, at.depth, kids)
            if lhs == self.start and origin.depth == 0:
                at.accepted = _better(at.accepted, (score, tree))
            waiters = [chart[w] for w in waiting[lhs]] if origin is at else origin.waiting.get(lhs, ())
            for w, w_dot, w_origin, w_score, w_kids in waiters:
                put(w, w_dot + 1, w_origin, w_score + score, (*w_kids, tree))
        at.cut = at.rest
        for symbol, keys in waiting.items():
            at.waiting[symbol] = [chart[key] for key in keys]
        for item in chart.values():
            rhs = self.rules[item[0]][1]
            if item[1] < len(rhs) and rhs[item[1]] not in self.by_lhs:
                if rhs[item[1]] == "REST":
                    self._finish(at, item)
                else:
                    at.scan[rhs[item[1]]].append(item)

    def _finish(self, at: Prefix, item: tuple) -> None:
        """Take all that follows as the REST of an item, and complete what its rule completes."""
        todo = [item]
        while todo:
            k, _, origin, score, kids = todo.pop()
            tree = (k, origin.depth, None, kids)
            if self.rules[k][0] == self.start and origin.depth == 0:
                at.cut = _better(at.cut, (score, tree))
            todo += [(w, dot, up, more + score, (*up_kids, tree)) for w, dot, up, more, up_kids in origin.waiting.get(self.rules[k][0], ()) if dot + 1 == len(self.rules[w][1])]

    def parse(self, tokens: Iterable[str]) -> tuple[float, Tree] | None:
        """Score and tree of the best parse."""
        at = self.begin()
        for token in tokens:
            nxt = self.step(at, token)
            if nxt is None:
                return at.best(False)
            at = nxt
        return at.best(True)

    def spans(self, tree: Tree, names: frozenset[str]) -> dict[str, tuple[int, int]]:
        """First token and end token of the given symbols in a tree; of several, the first."""
        found: dict[str, tuple[int, int]] = {}
        for k, i, j, _ in self.subtrees(tree, names, inner=True):
            found.setdefault(self.rules[k][0], (i, j))
        return found

    def subtrees(self, tree: Tree, names: frozenset[str], inner: bool = False) -> list[Tree]:
        """The subtrees of the given symbols in order; inner: also those inside of such subtrees."""
        found, stack = [], [tree]
        while stack:
            sub = stack.pop()
            if self.rules[sub[0]][0] in names:
                found.append(sub)
                if not inner:
                    continue
            stack.extend(reversed(sub[3]))
        return found
