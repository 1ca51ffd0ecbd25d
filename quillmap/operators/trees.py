"""The cheapest script that turns one schema tree into another.

A tree is the set of its paths. A script maps nodes of the old tree to nodes of the new one, one to one; it costs ``added``
and ``removed`` for nodes that aren't mapped, ``renamed`` for a mapped node under the mapped parent whose label differs,
``moved`` for one under another parent, and nothing for one that goes with its parent. A node in both trees is mapped to
itself, which is never dearer. Others may be mapped if their values agree, objects if something below them agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Costs of a script's steps. Alike are nodes whose values agree with a node that is mapped otherwise.
COSTS = {"added": 1.0, "removed": 1.0, "renamed": 0.5, "moved": 0.75, "carried": 0.0, "retyped": 0.25, "alike": 0.0}
#: Ways of mapping objects that are all tried; beyond, single changes of the best are tried until none helps.
WAYS = 256

Pair = tuple[str, str]


def parent(path: str) -> str:
    return path.rpartition(".")[0]


def label(path: str) -> str:
    return path.rpartition(".")[2]


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row and column numbers of the one-to-one choice with the greatest sum of gains (all at least 0), by shortest paths."""
    if gain.shape[0] > gain.shape[1]:
        return sorted((r, c) for c, r in assignment(gain.T))
    n, m = gain.shape
    cost = gain.max(initial=0.0) - gain
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, n)
    for row in range(n):
        owner[m] = row
        at, low, seen, back = m, np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.full(m + 1, m)
        while owner[at] != n:
            seen[at] = True
            r = owner[at]
            through = cost[r] - u[r] - v[:m]
            better = ~seen[:m] & (through < low[:m])
            low[:m][better], back[:m][better] = through[better], at
            ahead = int(np.where(seen[:m], np.inf, low[:m]).argmin())
            step = low[ahead]
            u[owner[seen]] += step
            v[seen] -= step
            low[~seen] -= step
            at = ahead
        while at != m:
            owner[at] = owner[back[at]]
            at = back[at]
        owner[m] = n
    return sorted((int(owner[c]), c) for c in range(m) if owner[c] != n)


def _groups(pairs: list[Pair]) -> list[list[Pair]]:
    """The pairs in groups that share no node."""
    group: dict[str, str] = {}

    def find(x: str) -> str:
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    for a, b in pairs:
        group[find("o" + a)] = find("n" + b)
    out: dict[str, list[Pair]] = {}
    for p in pairs:
        out.setdefault(find("o" + p[0]), []).append(p)
    return list(out.values())


def _step(a: str, b: str, objects: dict[str, str]) -> str:
    if parent(a) != parent(b) and objects.get(parent(a)) != parent(b):
        return "moved"
    return "carried" if label(a) == label(b) else "renamed"


def _leaves(groups: list[list[Pair]], objects: dict[str, str]) -> tuple[float, list[Pair]]:
    """What the best one-to-one mapping of leaves saves against removing and adding them, and the mapping."""
    saved, chosen = 0.0, []
    for pairs in groups:
        rows, columns = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
        gain = np.zeros((len(rows), len(columns)))
        for a, b in pairs:
            gain[rows.index(a), columns.index(b)] = 2 - COSTS[_step(a, b, objects)]
        best = [(0, 0)] if gain.size == 1 else [(r, c) for r, c in assignment(gain) if gain[r, c] > 0]
        saved += sum(gain[r, c] for r, c in best)
        chosen += [(rows[r], columns[c]) for r, c in best]
    return saved, chosen


def _mappings(pairs: list[Pair], taken: tuple[Pair, ...] = ()) -> Iterator[tuple[Pair, ...]]:
    """All sets of pairs that are one to one."""
    if not pairs:
        yield taken
        return
    (a, b), rest = pairs[0], pairs[1:]
    yield from _mappings([p for p in rest if p[0] != a and p[1] != b], (*taken, (a, b)))
    yield from _mappings(rest, taken)


def edit_script(old: dict[str, list[str]], new: dict[str, list[str]], agree: list[Pair]) -> list[tuple[str, str, str, float, bool]]:
    """The cheapest script ``step, old_path, new_path, cost, leaf``; unchanged nodes have no step.

    ``old``, ``new``: the kinds of each path; nodes in both may be left out if their kinds are equal. ``agree``: the pairs
    of old and new leaves that aren't in both trees and hold equal values. Of equally cheap scripts the first by path is
    taken. With more than WAYS ways to map objects the script is the best that no single object's change makes cheaper.
    """
    gone, came = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    agree = sorted(set(agree))
    groups = _groups(agree)
    above = lambda path: {path[:i] for i, c in enumerate(path) if c == "."}
    is_object = {p for p in gone if "object" in old[p]}, {p for p in came if "object" in new[p]}
    may = sorted({(x, y) for a, b in agree for x in above(a) & is_object[0] for y in above(b) & is_object[1]})

    def total(pairs: tuple[Pair, ...]) -> tuple[float, list[Pair]]:
        objects = dict(pairs)
        saved, leaves = _leaves(groups, objects)
        return saved + sum(2 - COSTS[_step(a, b, objects)] for a, b in pairs), leaves

    best: tuple[float, tuple[Pair, ...], list[Pair]] = (-1.0, (), [])
    for n, pairs in enumerate(_mappings(may)):
        saved, leaves = total(pairs)
        if saved > best[0] + 1e-9:
            best = (saved, pairs, leaves)
        if n >= WAYS:
            best = _improved(best, may, total)
            break
    _, objects, leaves = best
    mapped = {**dict(objects), **dict(leaves)}
    steps = []
    for a, b in sorted(mapped.items()):
        step = _step(a, b, dict(objects))
        steps.append((step, a, b, COSTS[step], (a, b) not in objects))
    steps += [("alike", a, b, COSTS["alike"], True) for a, b in agree if mapped.get(a) != b]
    taken = set(mapped.values())
    steps += [("removed", a, "", COSTS["removed"], a not in is_object[0]) for a in gone if a not in mapped]
    steps += [("added", "", b, COSTS["added"], b not in is_object[1]) for b in came if b not in taken]
    return steps + [("retyped", p, p, COSTS["retyped"], True) for p in sorted(old.keys() & new.keys()) if old[p] and new[p] and old[p] != new[p]]


def _improved(best, may: list[Pair], total):
    """Adds each pair of objects in place of those it rules out, or takes it away, as long as that saves more."""
    while True:
        held = best
        for pair in may:
            rest = tuple(p for p in best[1] if p[0] != pair[0] and p[1] != pair[1])
            for pairs in ((*rest, pair), tuple(p for p in best[1] if p != pair)):
                saved, leaves = total(pairs)
                if saved > best[0] + 1e-9:
                    best = (saved, pairs, leaves)
        if best is held:
            return best
