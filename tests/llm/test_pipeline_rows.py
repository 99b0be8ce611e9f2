import corpus_pipeline as p

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(name, n=80):
    return " ".join(f"{name}{i}" for i in range(n))


def left(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)
    return sorted(((r.doc_id, r.text, r.source) for r in p.near_copies_out(spark, docs, "").collect()), key=str)


def test_repeated_ids_lose_only_copies(spark):
    a, b, c = text("a"), text("b"), text("c")
    assert left(spark, [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, c, "x"), (5, c, "x"), (6, c + " more", "y")]) == sorted([(1, a, "x"), (5, b, "x"), (5, c, "x")], key=str)


def test_null_ids_are_judged_by_their_texts(spark):
    a, b, c = text("a"), text("b"), text("c")
    rows = [(None, a, "x"), (None, b, "x"), (None, c, "x"), (None, c, "w"), (7, a + " more", "x"), (8, text("d"), "x"), (None, None, "x"), (None, "", "x"), (9, " ", "x")]
    want = [(None, a, "x"), (None, b, "x"), (None, c, "w"), (8, text("d"), "x"), (None, None, "x"), (None, "", "x"), (9, " ", "x")]
    assert left(spark, rows) == sorted(want, key=str)
