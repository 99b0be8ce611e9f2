import random
from collections import defaultdict

import numpy as np
import pytest

from murmurlake.llm import minhash
from murmurlake.llm.common import WordHashes


def brute(rows, k):
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    by = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            by[s].append(i)
    for a in ids:
        seen = defaultdict(int)
        for s in sets[a]:
            for b in by[s]:
                if b > a:
                    seen[b] += 1
        for b, n in seen.items():
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def chained(rng, n_base=30):
    words = ["ab", "cd", "Ef", "gh", "x", "yy", "zed", "lo", "mid", "hi"]
    rows, i = [], 0
    for _ in range(n_base):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 9)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(t)))
            i += 1
            if rng.random() < 0.3:
                base = t  # chains
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, k):
    rows = chained(random.Random(k)) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "One"), (9005, "oNE"), (9006, "x " * 3000)]
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in rows], "doc_id long, text string, n_shingles string, component_id long")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, k=k).collect()}
    assert got == brute(rows, k)


def test_small_blocks_give_the_same(spark):
    rows = chained(random.Random(7), 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, k=2, block=3).collect()}
    assert got == brute(rows, 2)


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = minhash.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r")], schema)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(1, None, False), (1, None, False), (None, None, True), (2, 2, True)], key=str)


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[200:1200])
    agree = (minhash.sketch(a, 960) == minhash.sketch(b, 960)).mean()
    assert abs(agree - 800 / 1200) < 0.06
    assert (minhash.sketch(pool[:1], 240) != np.uint64(2**64 - 1)).all()


def test_shingles_of_few_words():
    h = WordHashes()
    assert len(minhash.shingles([b"a"], 2, h)) == 1
    assert len(minhash.shingles([b"a", b"b", b"a", b"b"], 2, h)) == 2
    assert len(minhash.shingles([], 2, h)) == 0
