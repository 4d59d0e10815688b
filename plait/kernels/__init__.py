"""Order-dependent programs over arrays: each takes one bounded group (a gap, a chain, a component)."""
