"""Progressive alignment of a bounded set of sequences along a guide tree.

Each node of the tree joins two graphs: matches between their paths are chained over reachability, what
lies between aligned by the kernel that fits, and the graphs fused along the alignment. Subtrees go
smallest first; different groups of sequences are different tasks.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from plait.kernels import align as K
from plait.kernels import chain as C
from plait.operators.trees import Tree, in_order
from plait.plans import anchored
from plait.sources import newick


@dataclass
class PathDag:
    """A DAG with the paths that walk it."""

    labels: list[str] = field(default_factory=list)
    edges: set[tuple[int, int]] = field(default_factory=set)
    paths: dict[str, list[int]] = field(default_factory=dict)

    @classmethod
    def leaf(cls, name: str, seq: str) -> PathDag:
        return cls(list(seq), {(i, i + 1) for i in range(len(seq) - 1)}, {name: list(range(len(seq)))})

    def dag(self, keep: list[int] | None = None) -> tuple[K.Dag, list[int]]:
        """The DAG on ``keep`` (all nodes by default), and what its nodes are here."""
        nodes = list(range(len(self.labels))) if keep is None else keep
        at = {v: i for i, v in enumerate(nodes)}
        succ: list[list[int]] = [[] for _ in nodes]
        for a, b in sorted(self.edges):
            if a in at and b in at:
                succ[at[a]].append(at[b])
        return K.Dag([self.labels[v] for v in nodes], succ), nodes

    def side(self) -> anchored.Side:
        return anchored.Side(self.labels, self.edges, self.paths)

    def spelled(self, name: str) -> str:
        return "".join(self.labels[v] for v in self.paths[name])


def fuse(a: PathDag, b: PathDag, aligned: list[K.Pair]) -> PathDag:
    """b merged into a: aligned nodes of one label become one."""
    to: dict[int, int] = {y: x for x, y in aligned if x is not None and y is not None and a.labels[x] == b.labels[y]}
    labels = list(a.labels)
    for v, label in enumerate(b.labels):
        if v not in to:
            to[v] = len(labels)
            labels.append(label)
    return PathDag(labels, a.edges | {(to[x], to[y]) for x, y in b.edges}, a.paths | {n: [to[v] for v in p] for n, p in b.paths.items()})


def unique_anchors(a: str, b: str, k: int) -> list[tuple[int, int, int, int, float]]:
    """Strings of length k that each sequence holds once, as anchors that neighbours on a diagonal extend."""

    def once(s: str) -> dict[str, int]:
        seen: dict[str, list[int]] = defaultdict(list)
        for i in range(len(s) - k + 1):
            seen[s[i : i + k]].append(i)
        return {w: at[0] for w, at in seen.items() if len(at) == 1}

    one, two = once(a), once(b)
    hits = sorted((one[w], two[w]) for w in one.keys() & two.keys())
    by_diagonal: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for x, y in hits:
        by_diagonal[x - y].append((x, y))
    out = []
    for run in by_diagonal.values():
        start = last = run[0]
        for x, y in [*run[1:], (None, None)]:
            if x is not None and x <= last[0] + k:
                last = (x, y)
                continue
            n = last[0] + k - start[0]
            out.append((start[0], start[0] + n, start[1], start[1] + n, float(n)))
            start = last = (x, y)
    return sorted(out)


def pairwise(a: str, b: str, k: int = 6, scoring: K.Scoring = K.Scoring(), opens=(1.25, 50, 5000), extends=(2.5, 0.1, 0.0015)) -> tuple[list[K.Pair], int, float]:
    """(alignment, anchors, chain score) of two sequences: chained anchors, and the gaps between them."""
    found = unique_anchors(a, b, k)
    score, chain = C.sparse_affine(found, opens, extends)
    out: list[K.Pair] = []
    i = j = 0
    for b1, e1, b2, e2, _ in [*(found[t] for t in chain), (len(a), len(a), len(b), len(b), 0.0)]:
        x, y = a[i:b1], b[j:b2]
        if x or y:
            _, gap = K.align_gap(K.chain(x), K.chain(y), scoring) if not (x and y) else ("", K.needleman_wunsch(x, y, scoring.useful(max(len(x), len(y))))[1])
            out += K.translated(gap, list(range(i, b1)), list(range(j, b2)))
        out += zip(range(b1, e1), range(b2, e2))
        i, j = e1, e2
    return out, len(chain), score


def align(sequences: dict[str, str], tree: Tree | None = None, scoring: K.Scoring = K.Scoring(), how: anchored.Anchoring = anchored.Anchoring()) -> PathDag:
    """The graph of all sequences, joined along ``tree`` (in order by default)."""
    if not sequences:
        return PathDag()
    tree = newick.parse(in_order(list(sequences))) if tree is None else tree
    tree = tree.pruned(set(sequences)).compacted().binarized()
    at: dict[int, PathDag] = {}
    for n in tree.small_first():
        if not tree.children[n]:
            at[n] = PathDag.leaf(tree.label[n], sequences[tree.label[n]])
            continue
        a, b = (at.pop(c) for c in tree.children[n])
        aligned, _ = anchored.align(a.side(), b.side(), scoring, how) if a.labels and b.labels else ([], 0.0)
        at[n] = fuse(a, b, aligned)
    return at[tree.root]
