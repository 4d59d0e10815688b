from plait.llm import line_dedup


def brute(rows):
    """rows: (doc_id, text) in order of id."""
    seen, out = set(), {}
    for i, t in rows:
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not "".join(w).strip(" \t\r"):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone))
    return out


def test_equals_brute_force(spark):
    import random

    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice("abcd ") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 14)))) for i in range(120)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, lines int, gone int")
    got = line_dedup.dedup(df.repartition(5))
    assert got.columns == ["doc_id", "text", "lines", "gone", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == brute(rows)


def test_edges(spark, edge_docs):
    more = spark.createDataFrame([(90, "x\ny\nz", 1), (90, "x\ny\nz", 1), (91, "x\ny\nz\n", 1), (None, "q\nx\ny\nz", 1), (92, "\n\n\n\n", 1), (93, "\n\n\n", 1)], edge_docs.schema)
    got = line_dedup.dedup(edge_docs.union(more)).collect()
    assert len(got) == edge_docs.count() + 6
    by = {r.doc_id: r for r in got}
    assert by[90].text == "x\ny\nz" and by[91].text == "" and by[92].text == "\n\n\n\n" and by[93].n_removed == 0
    assert [r.text for r in got if r.doc_id is None and r.text.startswith("q")] == ["q"]
    assert by[0].text is None and by[0].n_lines == 0
    assert line_dedup.dedup(edge_docs.limit(0)).count() == 0


def test_no_python(spark, edge_docs):
    plan = line_dedup.dedup(edge_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rows = [(i, "\n".join("abcde"[(i + j) % 5] for j in range(8))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(line_dedup.dedup(df).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(line_dedup.dedup(df).collect()) == one
