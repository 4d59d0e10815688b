"""Variant matrices, sample removal and universal bridges of path graphs."""

from __future__ import annotations

from plait.kernels import structure as T
from plait.operators.trees import Tree
from plait.plans.progressive import PathDag


def _closed(g: PathDag) -> tuple[list[list[int]], int, int]:
    """Successors with a virtual source and sink behind the last node."""
    n = len(g.labels)
    succ: list[list[int]] = [[] for _ in range(n + 2)]
    for a, b in sorted(g.edges):
        succ[a].append(b)
    heads = {b for _, b in g.edges}
    succ[n] = [v for v in range(n) if v not in heads]
    for v in range(n):
        if not succ[v]:
            succ[v] = [n + 1]
    return succ, n, n + 1


def variant_matrix(g: PathDag, kinds: tuple[str, ...] = ("SNP", "indel", "MNV", "SV"), structural: int = 50) -> list[tuple[int, int, str, dict[str, str]]]:
    """(entrance, exit, kind, allele by path) for every innermost superbubble of the kinds asked for.
    ``?`` is a path that does not pass, ``-`` an empty allele; several passes are joined by commas."""
    succ, source, sink = _closed(g)
    pairs = [(s, t) for s, t in T.superbubbles(succ) if s != source and t != sink and succ[s] != [t]]
    place = {v: i for i, v in enumerate(_order(succ))}
    around = T.nesting(pairs, place)
    inner = [i for i in range(len(pairs)) if i not in set(around)]
    out = []
    for i, (lo, hi) in zip(inner, T.lengths(succ, [pairs[i] for i in inner])):
        s, t = pairs[i]
        kind = T.variant_class(lo, hi, structural)
        if kind not in kinds:
            continue
        alleles = {}
        for name, path in g.paths.items():
            got, start = [], None
            for k, v in enumerate(path):
                if v == s:
                    start = k
                elif v == t and start is not None:
                    got.append("".join(g.labels[x] for x in path[start + 1 : k]) or "-")
                    start = None
            alleles[name] = ",".join(got) if got else "?"
        out.append((s, t, kind, alleles))
    return sorted(out, key=lambda r: place[r[0]])


def _order(succ: list[list[int]]) -> list[int]:
    left = [0] * len(succ)
    for out in succ:
        for b in out:
            left[b] += 1
    order = [v for v in range(len(succ)) if not left[v]]
    for v in order:
        for w in succ[v]:
            left[w] -= 1
            if not left[w]:
                order.append(w)
    return order


def without_samples(g: PathDag, tree: Tree, gone: set[str]) -> tuple[PathDag, Tree]:
    """The graph without these paths and what only they covered, and the tree without their leaves."""
    paths = {n: p for n, p in g.paths.items() if n not in gone}
    kept = sorted({v for p in paths.values() for v in p})
    to = {v: i for i, v in enumerate(kept)}
    edges = {(to[a], to[b]) for a, b in g.edges if a in to and b in to}
    return PathDag([g.labels[v] for v in kept], edges, {n: [to[v] for v in p] for n, p in paths.items()}), tree.pruned(set(paths)).compacted()


def universal_bridges(g: PathDag) -> list[tuple[int, int, dict[str, tuple[int, int]]]]:
    """(src, dst, place by path) of bridges that every path crosses; a place is the first and last step at
    which the path stands on the source."""
    edges = sorted(g.edges)
    out = []
    for i in T.bridges(len(g.labels), edges):
        a, b = edges[i]
        at = {n: [k for k in range(len(p) - 1) if p[k] == a and p[k + 1] == b] for n, p in g.paths.items()}
        if all(at.values()):
            out.append((a, b, {n: (k[0], k[-1]) for n, k in at.items()}))
    return out
