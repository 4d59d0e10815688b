"""Tables of the sequence-graph model. Identifiers are longs; a gap is a null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

SEQUENCE = "name string, seq string"
NODE = "node_id long, label string"
EDGE = "src long, dst long"
STEP = "path_id string, step long, node_id long"
TREE = "node_id long, parent_id long, ord int, label string, distance double"
ALIGNMENT = "aln_id string, pos long, n1 long, n2 long"
MATCH_WALK = "set_id long, side int, walk int, nodes array<long>"
MATCH_SET = "set_id long, count1 long, count2 long, full_length long"


@dataclass
class PathGraph:
    """A graph of labelled nodes with the paths that are walked through it."""

    nodes: DataFrame
    edges: DataFrame
    steps: DataFrame
