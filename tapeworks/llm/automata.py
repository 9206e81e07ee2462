"""Probabilistic automata by state merging: a prefix tree of examples whose statistically alike states are merged.

The tree is never built: it grows from the root in rounds. In a round the examples run through the states kept so far to the arcs that lead out
of them, and what follows there is counted (`arrivals`, which parts of the examples can do apart, for counts are added up). Then every such arc
is led to the kept state that it resembles, or to a new one, and so takes its examples on into the next round, until no arc is left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from math import inf, log, log2, sqrt

#: Symbols that a smoothed distribution allows for: printable ASCII and the end.
SYMBOLS = 96
SMOOTH = 0.02
#: Follows an example's last symbol; no example holds it.
END = "\0"
#: States that an automaton keeps; further arcs lead to the nearest of them.
STATES = 64
#: Fewer examples than FEW on an arc make no state of their own.
FEW, WIDE = 3, 4

#: (state, symbol of an arc that leads nowhere yet, else empty, the next one or two symbols) -> examples that come there.
Counts = dict[tuple[int, str, str], int]
#: Of a state the next states by symbol; ~t is a next state t that was set after the last round.
Steps = list[dict[str, int]]


class Automaton:
    """next[s][c] is the state after c, seen[s][c] how often; ends[s] strings end in s, visits[s] pass it."""

    def __init__(self, following: Steps, seen: list[dict[str, int]]):
        self.next = following
        self.ends = [s.get(END, 0) for s in seen]
        self.visits = [sum(s.values()) for s in seen]
        self.seen = [{c: n for c, n in s.items() if c != END} for s in seen]
        self.costs: list[tuple[dict[str, tuple[float, int]], float, float]] = []

    def bits(self, text: str, most: float = inf) -> float:
        """-log2 likelihood, or infinity beyond `most`; an unseen symbol costs the smoothing share and leaves the state."""
        s, total, costs = 0, 0.0, self.costs or self.weigh()
        for c in text:
            known, unseen, _ = costs[s]
            if (step := known.get(c)) is None:
                total += unseen
            else:
                total += step[0]
                s = step[1]
            if total > most:
                return inf
        return total + costs[s][2]

    def bits_without(self, text: str) -> float:
        """bits of an example by the counts of all other examples."""
        s, path = 0, []
        for c in text:
            path.append((s, c))
            s = self.next[s][c]
        passed, took = Counter(p for p, _ in path), Counter(path)
        passed[s] += 1
        whole = {p: self.visits[p] - n + SMOOTH * SYMBOLS for p, n in passed.items()}
        return sum(-n * log2((self.seen[p][c] - n + SMOOTH) / whole[p]) for (p, c), n in took.items()) - log2((self.ends[s] - 1 + SMOOTH) / whole[s])

    def weigh(self) -> list:
        """Each state's symbols with their bits and next states, the bits of an unseen one and of the end."""
        self.costs = []
        for after, seen, ends, visits in zip(self.next, self.seen, self.ends, self.visits):
            whole = visits + SMOOTH * SYMBOLS
            known = {c: (-log2((n + SMOOTH) / whole), after[c]) for c, n in seen.items()}
            self.costs.append((known, -log2(SMOOTH / whole), -log2((ends + SMOOTH) / whole)))
        return self.costs


def arrivals(examples: Iterable[str], steps: Steps, counts: Counts) -> None:
    """Count where the examples come to beyond the steps that are new, and what follows there. Without any step they come to the root."""
    begin = not steps[0]
    for text in examples:
        text += END
        s, i = 0, 0
        if begin:
            key = (0, "", text[:2])
            counts[key] = counts.get(key, 0) + 1
        else:  # what lies before the first new step has been counted
            for c in text:
                i += 1
                if (t := steps[s].get(c)) is None:
                    break
                if t < 0:
                    s = ~t
                    break
                s = t
            if t is None:
                continue
        for c in text[i:-1]:
            i += 1
            if (t := steps[s].get(c)) is None:
                key = (s, c, text[i : i + 2])
            else:
                s = t if t >= 0 else ~t
                key = (s, "", text[i : i + 2])
            counts[key] = counts.get(key, 0) + 1
            if t is None:
                break


class _Tails:
    """How often each symbol, and each pair of symbols, follows a state."""

    def __init__(self):
        self.visits, self.first, self.second = 0, {}, {}

    def add(self, window: str, n: int) -> None:
        self.visits += n
        c = window[0]
        self.first[c] = self.first.get(c, 0) + n
        if c != END:
            after = self.second.setdefault(c, {})
            after[window[1]] = after.get(window[1], 0) + n

    def fold(self, other: _Tails) -> None:
        self.visits += other.visits
        for c, n in other.first.items():
            self.first[c] = self.first.get(c, 0) + n
        for c, seen in other.second.items():
            after = self.second.setdefault(c, {})
            for d, n in seen.items():
                after[d] = after.get(d, 0) + n

    def bits(self, other: _Tails) -> float:
        """What the other's next symbols cost here."""
        whole = log2(self.visits + SMOOTH * SYMBOLS)
        return sum(n * (whole - log2(self.first.get(c, 0) + SMOOTH)) for c, n in other.first.items())


def _near(x: dict[str, int], n: int, y: dict[str, int], m: int) -> bool:
    """The likelihood ratio of one distribution against two, below what it exceeds by chance (WIDE deviations of chi square, and a bit for few symbols)."""
    g, kinds = 0.0, x.keys() | y.keys()
    for c in kinds:
        i, j = x.get(c, 0), y.get(c, 0)
        both = (i + j) / (n + m)
        g += (i * log(i / n / both) if i else 0.0) + (j * log(j / m / both) if j else 0.0)
    free = len(kinds) - 1
    return 2 * g <= free + WIDE * sqrt(2 * free) + 6


def _alike(x: _Tails, y: _Tails) -> bool:
    if y.visits < FEW:
        return True
    if not _near(x.first, x.visits, y.first, y.visits):
        return False
    return all(_near(x.second[c], x.first[c], y.second[c], y.first[c]) for c in x.second.keys() & y.second.keys())


class Inference:
    """An automaton in the making: `steps` is what a round's `arrivals` need, `settle` takes what they counted."""

    def __init__(self, states: int = STATES):
        self.steps: Steps = [{}]
        self.states, self.done = states, False
        self.tails = [_Tails()]

    def settle(self, counts: Iterable[tuple[int, str, str, int]]) -> None:
        """Lead each arc that examples came to to a state: of those alike the one under which its next symbols are likeliest, else a new one."""
        arcs: dict[tuple[int, str], _Tails] = {}
        for s, c, window, n in counts:
            (arcs.setdefault((s, c), _Tails()) if c else self.tails[s]).add(window, n)
        self.steps = [{c: t if t >= 0 else ~t for c, t in after.items()} for after in self.steps]
        for (s, c), arc in sorted(arcs.items(), key=lambda a: (-a[1].visits, a[0])):
            like = [k for k, kept in enumerate(self.tails) if _alike(kept, arc)]
            if not like and len(self.tails) < self.states:
                self.steps[s][c] = ~len(self.tails)
                self.tails.append(arc)
                self.steps.append({})
                continue
            k = min(like or range(len(self.tails)), key=lambda k: (self.tails[k].bits(arc), k))
            self.tails[k].fold(arc)
            self.steps[s][c] = ~k
        self.done = not arcs

    def automaton(self) -> Automaton:
        return Automaton(self.steps, [t.first for t in self.tails])


def infer_all(kinds: Iterable[str], count: Callable[[dict[str, Steps]], Iterable[tuple[str, int, str, str, int]]]) -> dict[str, Automaton]:
    """The automata of some kinds of examples; count gives a round's sums of `arrivals`, rows (kind, state, symbol, window, n), by steps of the kinds."""
    made = {k: Inference() for k in kinds}
    while todo := {k: m.steps for k, m in made.items() if not m.done}:
        rows: dict[str, list] = {k: [] for k in todo}
        for kind, *row in count(todo):
            rows[kind].append(row)
        for kind in todo:
            made[kind].settle(rows[kind])
    return {k: m.automaton() for k, m in made.items()}


def infer(examples: list[str]) -> Automaton:
    """The automaton of a list of examples."""

    def count(steps: dict[str, Steps]):
        counts: Counts = {}
        arrivals(examples, steps[""], counts)
        return [("", *key, n) for key, n in counts.items()]

    return infer_all([""], count)[""]
