"""Evolution of tandem-repeat arrays down a tree, with the truth kept.

Every base remembers the base of the root that it descends from, so that true alignments follow from
shared origins. Random numbers are numpy's; a run is repeatable by its seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from plait.operators.trees import Tree

BASES = np.array(list("ACGT"))


@dataclass(frozen=True)
class Rates:
    """Expected events per unit of tree length."""

    substitutions: float = 0.01
    point_indels: float = 0.002
    monomer_indels: float = 0.001
    unit_indels: float = 0.001
    indel_decay: float = 0.5
    unit_shape: float = 1.8


def pareto_mean(shape: float, most: int = 100_000) -> float:
    """Mean of a discrete Pareto variable (probability as k^-shape - (k+1)^-shape), cut at ``most``."""
    return float(np.sum(np.arange(1, most + 1, dtype=float) ** -shape))


def pareto_sample(rng: np.random.Generator, shape: float, most: int) -> int:
    return int(min(most, np.floor(rng.random() ** (-1.0 / shape))))


def pareto_shape(mean: float) -> float:
    """The shape whose discrete Pareto variable has this mean, by bisection."""
    low, high = 1.0001, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if pareto_mean(mid) > mean else (low, mid)
    return (low + high) / 2


def repeat_array(rng: np.random.Generator, monomer: int, monomers: int, units: int, divergence: float = 0.2) -> str:
    """An array of ``units`` copies of a unit of ``monomers`` diverged monomers."""
    base = rng.integers(0, 4, monomer)
    unit = []
    for _ in range(monomers):
        m = base.copy()
        hit = rng.random(monomer) < divergence
        m[hit] = (m[hit] + rng.integers(1, 4, hit.sum())) % 4
        unit.append(m)
    return "".join(BASES[np.tile(np.concatenate(unit), units)])


def _evolve(rng: np.random.Generator, base: np.ndarray, origin: np.ndarray, length: float, r: Rates, monomer: int, unit: int) -> tuple[np.ndarray, np.ndarray, int]:
    fresh = -1

    def cut_or_copy(size: int) -> None:
        """Lose or double a stretch at a random place."""
        nonlocal base, origin
        if len(base) <= size:
            return
        at = int(rng.integers(0, len(base) - size + 1))
        if rng.random() < 0.5:
            base, origin = np.delete(base, np.s_[at : at + size]), np.delete(origin, np.s_[at : at + size])
        else:  # copies are new bases
            base = np.insert(base, at + size, base[at : at + size])
            origin = np.insert(origin, at + size, np.full(size, fresh))

    for _ in range(rng.poisson(r.unit_indels * length * max(1, len(base) // unit))):
        cut_or_copy(unit * pareto_sample(rng, r.unit_shape, max(1, len(base) // unit)))
    for _ in range(rng.poisson(r.monomer_indels * length * max(1, len(base) // monomer))):
        cut_or_copy(monomer)
    for _ in range(rng.poisson(r.point_indels * length * len(base))):
        size = int(rng.geometric(r.indel_decay))
        at = int(rng.integers(0, len(base) + 1))
        if rng.random() < 0.5:
            base, origin = np.delete(base, np.s_[at : at + size]), np.delete(origin, np.s_[at : at + size])
        else:
            base = np.insert(base, at, rng.integers(0, 4, size))
            origin = np.insert(origin, at, np.full(size, fresh))
    hit = rng.random(len(base)) < 1 - np.exp(-r.substitutions * length)
    base = base.copy()
    base[hit] = (base[hit] + rng.integers(1, 4, hit.sum())) % 4
    return base, origin, fresh


def simulate(tree: Tree, root: str, rates: Rates = Rates(), monomer: int = 20, monomers: int = 3, seed: int = 0) -> dict[str, tuple[str, list[int]]]:
    """(sequence, origin of each base in the root or -1) for every leaf."""
    rng = np.random.default_rng(seed)
    code = np.searchsorted(BASES, np.array(list(root)))
    state = {tree.root: (code, np.arange(len(root)))}
    out = {}
    for n in tree.preorder():
        if n != tree.root:
            b, o = state[tree.parent[n]]
            b, o, _ = _evolve(rng, b, o, tree.distance[n] or 1.0, rates, monomer, monomer * monomers)
            state[n] = b, o
        if not tree.children[n]:
            b, o = state[n]
            out[tree.label[n]] = "".join(BASES[b]), o.tolist()
    return out


def true_pairs(a: list[int], b: list[int]) -> set[tuple[int, int]]:
    """Base pairs of one origin."""
    at = {o: i for i, o in enumerate(a) if o >= 0}
    return {(at[o], j) for j, o in enumerate(b) if o >= 0 and o in at}


def compare(alignment, a: list[int], b: list[int]) -> dict[str, float]:
    """Match rate, completeness and accuracy of an alignment against the truth."""
    truth = true_pairs(a, b)
    got = {p for p in alignment if None not in p}
    right = len(got & truth)
    return {
        "match_rate": 2 * right / (len(a) + len(b)) if a or b else 1.0,
        "completeness": right / len(truth) if truth else 1.0,
        "accuracy": right / len(got) if got else 1.0,
    }
