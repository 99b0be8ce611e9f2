import numpy as np

from murmurlake.llm import embedding_dedup


def brute(rows, cosine):
    ok = {}
    for i, e, lab in rows:
        if e is not None and lab is not None and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.array(e, dtype=np.float64)
            ok[i] = (lab, v / np.linalg.norm(v))
    ids, links = list(ok), {i: set() for i, *_ in rows}
    for a in ids:
        for b in ids:
            if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= cosine:
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres, rows = rng.normal(size=(40, 16)), []
    for i in range(500):
        v = centres[rng.integers(40)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] + [0.0] * 14, 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for block in (4096, 20):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, block=block, per_cell=8).collect()}
        assert got == brute(rows, 0.98)


def test_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = embedding_dedup.near_vectors(spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(4, 1, 4, True), (5, 1, 4, False)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    c, x, y = rng.normal(size=(9, 5)), rng.normal(size=(60, 5)), rng.normal(size=(60, 5))
    _, lower = embedding_dedup.bounds(x, c)
    near, _ = embedding_dedup.bounds(y, c)
    d = ((x[:, None] - y[None]) ** 2).sum(2)
    assert (lower[:, near] <= d + 1e-9).all()


def test_traversal_is_by_rising_sum_and_each_codebook_counts():
    rng = np.random.default_rng(5)
    books = rng.normal(size=(9, 4)), rng.normal(size=(7, 4))
    for v in rng.normal(size=(40, 8)):
        a, b = (embedding_dedup.bounds(x[None], c)[1][0] for x, c in zip((v[:4], v[4:]), books, strict=True))
        cells = list(embedding_dedup.multi_sequence(a, b, 0.9))
        sums = [a[i] + b[j] for i, j in cells]
        assert sums == sorted(sums) and sorted(cells) == [(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.9]
        assert sorted(i * 7 + j for i, j in cells) == embedding_dedup.visited(a, b, 0.9).tolist()
        for other in (embedding_dedup.multi_sequence(np.zeros(9), b, 0.9), embedding_dedup.multi_sequence(a, np.zeros(7), 0.9)):
            assert set(cells) < set(other)


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, [1.0, 0.0], 1, "x"), (3, [1.0, 0.01], 1, "y"), (None, [1.0, 0.0], 1, "z"), (7, [0.0, 1.0], 1, "w")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, stretch string")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(-1, 1, None, True), (3, 1, None, False), (7, 0, 7, True)]
