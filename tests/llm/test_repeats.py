import random
from functools import partial

import numpy as np
import pytest

from murmurlake.llm import substring_tree, suffix_array


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(40, 130))] for _ in range(6)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 150))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            a = rng.randrange(0, max(1, len(p) - 50))
            at = rng.randrange(0, len(t) + 1)
            t[at:at] = p[a:] if rng.random() < 0.7 else p[: rng.randrange(1, len(p))]
        rows.append((i * 3, rng.choice([" ", "\n"]).join(t)))
        if rng.random() < 0.15:
            rows.append((i * 3 + 1, rows[-1][1]))
    rows += [(500, "ha " * 400), (501, "ha " * 120), (502, "ho ha " * 90), (503, None), (504, ""), (505, " \t")]
    rng.shuffle(rows)
    return rows


def brute(rows, window=50):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for j in range(len(ws) - window + 1):
            if first[tuple(ws[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(ws), len(gone), b" ".join(w for j, w in enumerate(ws) if j not in gone).decode())
    return out


@pytest.mark.parametrize("most", [2000, 2])
def test_trees_equal_brute_force(spark, most):
    rows = corpus(4)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, prefix int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_tree.without_repeats(df, finder=partial(substring_tree.tree_hits, most=most)).collect()}
    assert got == brute(rows)


def test_trees_empty_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert substring_tree.without_repeats(spark.createDataFrame([], schema)).count() == 0
    t = " ".join(f"a{i}" for i in range(60))
    got = substring_tree.without_repeats(spark.createDataFrame([(1, t), (1, t), (2, t), (2, "b"), (None, "c")], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 1, 0), (1, 60, 0), (1, 60, 0), (2, 1, 0), (2, 60, 60)]


@pytest.mark.parametrize("ranges, at_once, most", [(1, 20_000, 2), (1, 9, 50_000), (7, 20_000, 2), (5, 4, 2), (7, 9, 50_000)])
def test_arrays_equal_brute_force(spark, ranges, at_once, most):
    rows = corpus(9)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, selector string")
    name, batch = "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ranges))
    spark.conf.set(batch, str(min(at_once, 2000)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_tree.without_repeats(df, finder=partial(suffix_array.array_hits, at_once=at_once, most=most)).collect()}
    finally:
        spark.conf.set(name, before)
        spark.conf.set(batch, "2000")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(rows)


def test_arrays_empty_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert suffix_array.without_repeats(spark.createDataFrame([], schema)).count() == 0
    t = " ".join(f"a{i}" for i in range(60))
    rows = [(1, t), (1, t + " x"), (2, "b " + t), (None, "c"), (None, "d " + t), (3, None)]
    got = suffix_array.without_repeats(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 1, 0), (0, 61, 0), (1, 60, 60), (1, 61, 60), (2, 61, 60), (3, 0, 0)]


def test_nodes_are_those_of_the_tree():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 3, (400, 6)).astype(">u4")
    group = np.sort(rng.integers(0, 5, 400))
    whole = np.array([hash(tuple(w)) for w in words.tolist()])
    order, node = substring_tree.subtree_nodes(group, words, whole, 4, 10)
    got: dict[int, set] = {}
    for i, n in zip(order.tolist(), node.tolist(), strict=True):
        got.setdefault(n, set()).add((group[i], tuple(words[i].tolist())))
    assert all(len(x) == 1 for x in got.values())
    assert len(got) == len({(g, tuple(w)) for g, w in zip(group.tolist(), words.tolist(), strict=True)})
