"""Edit distance between unordered schema trees.

A schema tree has a label and a kind on every node; children are unordered.
The distance is the constrained one (a node maps to a node of the same depth
below mapped parents), which for unordered trees is a minimum-cost assignment
of children at every level and so is polynomial.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

INF = float("inf")


@dataclass
class Node:
    """`values` counts hashes of the values seen below the node, as rename evidence."""

    label: str
    kinds: frozenset[str] = frozenset()
    values: Counter = field(default_factory=Counter)
    children: list["Node"] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


@dataclass(frozen=True)
class Edit:
    """`op` is add, delete, rename, retype or move; paths name nodes from the root."""

    op: str
    old: tuple[str, ...]
    new: tuple[str, ...]


def carried(a: Node, b: Node) -> float:
    """Share of the smaller value bag that is found in the other one."""
    n = min(sum(a.values.values()), sum(b.values.values()))
    return sum((a.values & b.values).values()) / n if n else 0.0


def relabel_cost(a: Node, b: Node) -> float:
    """0 for an equal label, plus 0.25 for another kind; a rename costs less the
    more values carry on, and is as dear as delete and add when under half do."""
    if a.label == b.label:
        return 0.25 if a.kinds and b.kinds and a.kinds != b.kinds else 0.0
    share = carried(a, b)
    return 0.5 + (1.0 - share) if share >= 0.5 else INF


def assign(cost: list[list[float]]) -> list[int]:
    """Column of each row in a minimum-cost perfect matching of a square matrix.

    Shortest augmenting paths with potentials, O(n^3).
    """
    n = len(cost)
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        match[n], j0 = i, n
        dist, back, done = [INF] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while True:
            done[j0] = True
            i0, best, j1 = match[j0], INF, n
            for j in range(n):
                if not done[j]:
                    d = cost[i0][j] - u[i0] - v[j]
                    if d < dist[j]:
                        dist[j], back[j] = d, j0
                    if dist[j] < best:
                        best, j1 = dist[j], j
            for j in range(n + 1):
                if done[j]:
                    u[match[j]] += best
                    v[j] -= best
                else:
                    dist[j] -= best
            j0 = j1
            if match[j0] == n:
                break
        while j0 != n:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    row = [0] * n
    for j in range(n):
        row[match[j]] = j
    return row


def compare(a: Node, b: Node, path_a: tuple[str, ...] = (), path_b: tuple[str, ...] = (), mapped: list[tuple] | None = None) -> tuple[float, list[Edit]]:
    """Cost and script that turn the children of `a` into those of `b`, `a` mapped to `b`.

    `mapped` collects the (old, new) paths of all nodes that the script keeps.

    Children of one label are mapped to each other before the rest is assigned:
    that costs at most a retype, which no other mapping undercuts.
    """
    rest_a, rest_b, pairs = [], list(b.children), []
    by_label = {}
    for c in rest_b:
        by_label.setdefault(c.label, c)
    for c in a.children:
        d = by_label.pop(c.label, None)
        if d is None:
            rest_a.append(c)
        else:
            pairs.append((c, d))
            rest_b = [x for x in rest_b if x is not d]
    total, script = 0.0, []
    deleted, added = [], []
    n, m = len(rest_a), len(rest_b)
    if n and m:
        big = 1e6
        subs = [[compare(x, y, (*path_a, x.label), (*path_b, y.label)) if relabel_cost(x, y) < INF else None for y in rest_b] for x in rest_a]
        cost = [[0.0] * (n + m) for _ in range(n + m)]
        for i in range(n + m):
            for j in range(n + m):
                if i < n and j < m:
                    cost[i][j] = relabel_cost(rest_a[i], rest_b[j]) + subs[i][j][0] if subs[i][j] else big
                elif i < n:
                    cost[i][j] = rest_a[i].size() if j - m == i else big
                elif j < m:
                    cost[i][j] = rest_b[j].size() if i - n == j else big
        where = assign(cost)
        taken = set()
        for i in range(n):
            j = where[i]
            if j < m and subs[i][j]:
                pairs.append((rest_a[i], rest_b[j]))
                taken.add(j)
            else:
                deleted.append(rest_a[i])
        added = [y for j, y in enumerate(rest_b) if j not in taken]
    else:
        deleted, added = rest_a, rest_b
    for x, y in pairs:
        old, new = (*path_a, x.label), (*path_b, y.label)
        total += relabel_cost(x, y)
        if x.label != y.label:
            script.append(Edit("rename", old, new))
        elif x.kinds and y.kinds and x.kinds != y.kinds:
            script.append(Edit("retype", old, new))
        if mapped is not None:
            mapped.append((old, new))
        c, s = compare(x, y, old, new, mapped)
        total += c
        script += s
    for x in deleted:
        total += x.size()
        script.append(Edit("delete", (*path_a, x.label), ()))
    for y in added:
        total += y.size()
        script.append(Edit("add", (), (*path_b, y.label)))
    return total, script


def at_path(root: Node, path: tuple[str, ...]) -> Node:
    for label in path:
        root = next(c for c in root.children if c.label == label)
    return root


def is_moved(a: Node, b: Node) -> bool:
    """Whether `b` under another parent is `a`: label and kinds are the same and its values carry on."""
    return a.label == b.label and a.kinds == b.kinds and (carried(a, b) >= 0.5 or not (a.values or b.values))


def edit_script(a: Node, b: Node, mapped: list[tuple] | None = None) -> tuple[float, list[Edit]]:
    """Minimum-cost script from schema `a` to `b`, with moves.

    A node deleted under one parent whose like is added under another one is a
    move: one unit instead of two. Subtrees are looked through, so a node inside
    of an added or deleted one may have moved too.
    """
    mapped = [] if mapped is None else mapped
    cost, script = compare(a, b, mapped=mapped)
    gone: dict[str, list[tuple]] = {}
    for e in script:
        if e.op == "delete":
            for path in _below(a, e.old):
                gone.setdefault(path[-1], []).append(path)
    moves, used = [], set()
    for e in script:
        if e.op == "add":
            for path in _below(b, e.new):
                node = at_path(b, path)
                old = next((g for g in gone.get(path[-1], []) if g not in used and g[:-1] != path[:-1] and is_moved(at_path(a, g), node)), None)
                if old is not None:
                    used.add(old)
                    cost -= 1
                    moves.append(Edit("move", old, path))
                    mapped.append((old, path))
    taken = {m.old for m in moves} | {m.new for m in moves}
    return cost, [e for e in script if (e.old or e.new) not in taken or e.op not in ("delete", "add")] + moves


def _below(root: Node, path: tuple[str, ...]) -> list[tuple[str, ...]]:
    """`path` and the paths of all nodes below it."""
    out = [path]
    for c in at_path(root, path).children:
        out += _below(root, (*path, c.label))
    return out
