"""Guide trees. A tree is small (a name per sequence), so it lives on the driver as :class:`Tree`; the
table operators take trees that are data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait import model
from plait.runtime import shared_dir


@dataclass
class Tree:
    """Parents, children in order, labels and lengths of edges to parents, by node."""

    parent: list[int | None] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    label: list[str] = field(default_factory=list)
    distance: list[float | None] = field(default_factory=list)

    def add(self, parent: int | None, label: str = "", distance: float | None = None) -> int:
        node = len(self.parent)
        self.parent.append(parent)
        self.children.append([])
        self.label.append(label)
        self.distance.append(distance)
        if parent is not None:
            self.children[parent].append(node)
        return node

    @property
    def root(self) -> int:
        return self.parent.index(None)

    def leaves(self) -> list[int]:
        return [n for n in self.preorder() if not self.children[n]]

    def preorder(self) -> list[int]:
        if not self.parent:
            return []
        out, todo = [], [self.root]
        while todo:
            n = todo.pop()
            out.append(n)
            todo += reversed(self.children[n])
        return out

    def postorder(self) -> list[int]:
        out, todo = [], [self.root] if self.parent else []
        while todo:
            n = todo.pop()
            out.append(n)
            todo += self.children[n]
        return out[::-1]

    def small_first(self) -> list[int]:
        """Postorder by size of subtree: all nodes with fewer leaves come before those with more."""
        size = [0] * len(self.parent)
        post = self.postorder()
        for n in post:
            size[n] = sum(size[c] for c in self.children[n]) or 1
        place = {n: i for i, n in enumerate(post)}
        return sorted(post, key=lambda n: (size[n], place[n]))

    def copy_from(self, keep, joined=None) -> Tree:
        """The tree on nodes for which ``keep`` holds; lengths of left-out nodes on the way add up."""
        out, to = Tree(), {}
        for n in self.preorder():
            if not keep(n):
                continue
            up, length = self.parent[n], self.distance[n]
            while up is not None and up not in to:
                if self.distance[up] is not None or length is not None:
                    length = (length or 0.0) + (self.distance[up] or 0.0)
                up = self.parent[up]
            to[n] = out.add(to.get(up), self.label[n], length if up is not None else None)
        return out

    def pruned(self, labels: set[str]) -> Tree:
        """Only the named leaves and their ancestors up to the last common one."""
        count = [0] * len(self.parent)
        for n in self.postorder():
            count[n] = sum(count[c] for c in self.children[n]) + (not self.children[n] and self.label[n] in labels)
        total = count[self.root] if self.parent else 0
        top = self.root if self.parent else None
        while top is not None and (below := [c for c in self.children[top] if count[c] == total]) and total:
            top = below[0]
        above = set()
        n = self.parent[top] if top is not None else None
        while n is not None:
            above.add(n)
            n = self.parent[n]
        return self.copy_from(lambda n: count[n] > 0 and n not in above)

    def compacted(self) -> Tree:
        """Without nodes of a single child; their lengths go to the child."""
        return self.copy_from(lambda n: len(self.children[n]) != 1)

    def binarized(self) -> Tree:
        """Nodes of more than two children become left-deep ladders of new nodes ``label#k``."""
        out = Tree()

        def build(n: int, parent: int | None, distance: float | None) -> list[tuple[int, int | None, float | None]]:
            kids = self.children[n]
            me = out.add(parent, self.label[n], distance)
            todo = []
            at = me
            k = 0
            rest = list(kids)
            while len(rest) > 2:  # the last child beside the ladder of those before
                todo.append((rest.pop(), at, None))
                inner = out.add(at, f"{self.label[n]}#{k}" if self.label[n] else "", 0.0 if any(self.distance[c] is not None for c in kids) else None)
                # the ladder comes first
                at, k = inner, k + 1
            todo += [(c, at, None) for c in reversed(rest)]
            return [(c, p, self.distance[c]) for c, p, _ in todo]

        if self.parent:
            todo = build(self.root, None, self.distance[self.root])
            while todo:
                n, p, d = todo.pop()
                todo += build(n, p, d)
        return out

    def polytomized(self) -> Tree:
        """Inner edges of length zero are contracted."""
        gone = {n for n in range(len(self.parent)) if self.parent[n] is not None and self.children[n] and self.distance[n] == 0.0}
        return self.copy_from(lambda n: n not in gone)

    def copy_expanded(self, copies: dict[str, int]) -> Tree:
        """Leaves with several copies become nodes above ``label/1``, ``label/2`` and so on; leaves without
        any go, and so do nodes that bear none."""
        count = [0] * len(self.parent)
        for n in self.postorder():
            count[n] = sum(count[c] for c in self.children[n]) if self.children[n] else copies.get(self.label[n], 0)
        out = self.copy_from(lambda n: count[n] > 0)
        for n in range(len(out.parent)):
            if not out.children[n] and copies.get(out.label[n], 0) > 1:
                for k in range(copies[out.label[n]]):
                    out.add(n, f"{out.label[n]}/{k + 1}", None if out.distance[n] is None else 0.0)
        return out

    def lca(self, a: int, b: int) -> int:
        up = {a}
        n = a
        while (n := self.parent[n]) is not None:
            up.add(n)
        while b not in up:
            b = self.parent[b]
        return b

    def depths(self) -> list[float]:
        """Distance of each node from the root; unit edges if no edge has a length."""
        unit = all(d is None for n, d in enumerate(self.distance) if self.parent[n] is not None)
        out = [0.0] * len(self.parent)
        for n in self.preorder():
            if self.parent[n] is not None:
                out[n] = out[self.parent[n]] + (1.0 if unit else self.distance[n] or 0.0)
        return out

    def pair_distance(self, a: int, b: int) -> float:
        d = self.depths()
        return d[a] + d[b] - 2 * d[self.lca(a, b)]

    def bipartitions(self) -> dict[frozenset[str], int]:
        """Splits of the leaf labels by inner edges, as the side with the first label, with the height (in
        edges, the longest way down) of the lower node."""
        everyone = frozenset(self.label[n] for n in self.leaves())
        if not everyone:
            return {}
        anchor, below, height, out = min(everyone), {}, {}, {}
        for n in self.postorder():
            kids = self.children[n]
            below[n] = frozenset().union(*(below[c] for c in kids)) if kids else frozenset((self.label[n],))
            height[n] = 1 + max(height[c] for c in kids) if kids else 0
            if kids and self.parent[n] is not None and 1 < len(below[n]) < len(everyone) - 1:
                side = below[n] if anchor in below[n] else everyone - below[n]
                out[side] = max(out.get(side, 0), height[n])
        return out

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, self.parent[n], self.children[self.parent[n]].index(n) if self.parent[n] is not None else 0, self.label[n], self.distance[n]) for n in range(len(self.parent))]
        return spark.createDataFrame(rows, model.TREE)


def in_order(names: list[str]) -> str:
    """The left-deep Newick tree that aligns sequences in the order given."""
    if not names:
        raise ValueError("a tree needs a name")
    quoted = [f'"{n}"' for n in names]
    text = quoted[0]
    for q in quoted[1:]:
        text = f"({text},{q})"
    return text + ";"


def compare(a: Tree, b: Tree) -> list[tuple[str, int, int, int]]:
    """(split, height, minor side, found) for the splits of each tree: 1 if the other tree has it too."""
    one, two = a.bipartitions(), b.bipartitions()
    n = len(a.leaves())
    rows = []
    for name, own, other in (("first", one, two), ("second", two, one)):
        rows += [(name, h, min(len(s), n - len(s)), int(s in other)) for s, h in own.items()]
    return sorted(rows)


def ancestors(tree: DataFrame) -> DataFrame:
    """(node_id, ancestor, edges, distance) closure of a tree table, each node its own ancestor at zero.
    Doubles its reach every round, so a tree of depth d takes log2(d) joins; a cycle is an error."""
    shared_dir(tree.sparkSession)
    one = tree.where("parent_id is not null").select("node_id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("edges"), F.coalesce("distance", F.lit(0.0)).alias("distance"))
    out = tree.select("node_id", F.col("node_id").alias("ancestor"), F.lit(0).alias("edges"), F.lit(0.0).alias("distance"))
    most, span = tree.count(), 1
    reach = one.checkpoint()
    known = out.union(one).checkpoint()  # ways of at most ``span`` edges
    while reach.limit(1).count():
        if span > most:
            raise ValueError("the parents of a tree form a cycle")
        on = known.where("edges > 0").select(F.col("node_id").alias("ancestor"), F.col("ancestor").alias("up"), F.col("edges").alias("more"), F.col("distance").alias("far"))
        reach = reach.join(on, "ancestor").select("node_id", F.col("up").alias("ancestor"), (F.col("edges") + F.col("more")).alias("edges"), (F.col("distance") + F.col("far")).alias("distance")).where(F.col("edges") > span)
        known = known.union(reach).checkpoint()
        span *= 2
        reach = known.where(F.col("edges") == span).checkpoint()
    return known


def leaf_sets(tree: DataFrame, closure: DataFrame) -> DataFrame:
    """(ancestor, leaf): the leaves under every node."""
    inner = tree.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    leaves = tree.select("node_id").join(inner, "node_id", "left_anti")
    return closure.join(leaves, "node_id", "left_semi").select("ancestor", F.col("node_id").alias("leaf"))


#: Leaves of a salt of a node with many of them.
PAIR_LEAVES = 2000


def leaf_pair_distances(tree: DataFrame, closure: DataFrame) -> DataFrame:
    """(a, b, distance) of all pairs of leaves, a < b, over their lowest common ancestor: a pair meets there
    alone, where it comes up from different children. The leaves under the children of one node are dealt
    over salts, so no node's pairs are one task's."""
    inner = tree.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    up = closure.join(inner, "node_id", "left_anti").select(F.col("node_id").alias("leaf"), F.col("ancestor").alias("via"), "distance")
    parent = tree.where("parent_id is not null").select(F.col("node_id").alias("via"), F.col("parent_id").alias("at"), F.coalesce("distance", F.lit(0.0)).alias("more"))
    up = up.join(parent, "via").select("leaf", "at", "via", (F.col("distance") + F.col("more")).alias("distance"))
    shared_dir(tree.sparkSession)
    up = up.checkpoint()
    salts = up.groupBy("at").agg(F.ceil(F.count("*") / PAIR_LEAVES).alias("salts"))
    up = up.join(salts, "at")
    a = up.select(F.col("leaf").alias("a"), "at", F.col("via").alias("va"), F.col("distance").alias("da"), F.pmod(F.xxhash64("leaf"), F.col("salts")).alias("salt"))
    b = up.select(F.col("leaf").alias("b"), "at", F.col("via").alias("vb"), F.col("distance").alias("db"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    return a.join(b, ["at", "salt"]).where("a < b and va != vb").select("a", "b", (F.col("da") + F.col("db")).alias("distance"))
