"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from plait import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The others are compared by the driver.
SOME = ["seq_base_counts", "kmer_counts", "shared_unique_kmers", "match_score_filter", "saturating_sums", "leaf_graph_build", "graph_compact_unipaths", "graph_fuse_edges", "chain_mask", "induced_matches", "explicit_cigars", "score_alignments", "induced_identity", "truth_metrics", "tree_leaf_pair_distance", "anchor_chain_affine", "partition_max_weight", "minimal_rare_matches", "remove_samples", "all_pairs_consumed"]


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: "" if v is None else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, db, name):
    got = core.queries()[name](spark, DATA)
    want = db.execute(core.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry(spark):
    got = entry.entry(spark).collect()
    assert got and all(sum(int(n) for n in _numbers(r.cigar, "=XD")) == r.n1 and sum(int(n) for n in _numbers(r.cigar, "=XI")) == r.n2 for r in got)


def _numbers(cigar, ops):
    import re

    return [n for n, op in re.findall(r"(\d+)([=XID])", cigar) if op in ops]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
