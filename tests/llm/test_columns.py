"""Columns of the caller that are named like inner ones, null ids, repeated rows: each operator gives every row a result."""

import pytest

from murmurlake.llm import fingerprint, minhash, mixing, packing, substring_tree, suffix_array, toxicity
from murmurlake.llm.queries import tokenizer_path

NAMES = ("id", "b", "tag", "selector", "path", "path2", "runs", "hits", "key", "keys", "g", "comp", "n", "leader", "items", "rep", "th", "head", "h", "side", "size", "has", "level", "weight", "salt", "part", "length", "piece", "first", "at", "row", "words")


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"ord{i}" for i in range(70))
    rows = [(1, long, "a"), (2, long + " slut", "b"), (2, long + " slut", "b"), (None, long, None), (None, None, "a"), (3, "", "a"), (4, "kort text", "b")]
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))


def test_repeats(docs):
    for module in (substring_tree, suffix_array):
        got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in module.without_repeats(docs).collect())
        assert got == [(0, 0, 0), (0, 70, 0), (1, 70, 70), (2, 71, 70), (2, 71, 70), (3, 0, 0), (4, 2, 0)]


def test_near_copies(docs):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, k=2).collect())
    assert got == [(0, 0, None, True), (0, 69, None, True), (1, 69, None, False), (2, 70, None, False), (2, 70, None, False), (3, 0, 3, True), (4, 1, 4, True)]


def test_mixing_keeps_columns(docs):
    mixed = mixing.mix(docs)
    assert mixed.count() == 7 and set(docs.columns) <= set(mixed.columns)
    assert {r.has for r in mixed.collect()} == {"x"} and {r.source: r.source_size for r in mixed.collect()} == {"a": 70, "b": 144, None: 70}


def test_packing(docs):
    out = packing.pack_documents(docs, tokenizer_path(), capacity=64, digest=True).collect()
    assert {r.doc_id for r in out} == {None, 1, 2, 3, 4} and sum(r.piece == 0 for r in out) == 7
    for s in {r.sequence_id for r in out}:
        places = sorted((r.offset, r.length) for r in out if r.sequence_id == s)
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(n for _, n in places) <= 64


def test_fingerprints_and_toxicity(spark, docs):
    assert fingerprint.fingerprint_with_neighbours(docs).count() == 7
    lex = toxicity.learn(spark.createDataFrame([], "row long, text string, toxic int"))
    assert toxicity.score_texts(docs, lex, keep=("row", "words")).columns == ["doc_id", "row", "words", "score", "predicted"]
