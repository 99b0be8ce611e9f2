import corpus_pipeline as p

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_clean_documents(spark, tmp_path):
    words = [f"v{i}" for i in range(400)]
    clean = [(i, " ".join(words[j % 400] + str(i) for j in range(120)), "en", "ab"[i % 2], 0) for i in range(12)]
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [*clean, (50, clean[0][1], "en", "a", 0), (51, clean[1][1] + " more", "en", "a", 0), (60, passage + " one", "en", "b", 0), (61, "two " + passage + " three four five " + " ".join(f"u{i}" for i in range(60)), "en", "b", 0), (70, "you idiot moron scum", "en", "a", 0), (71, None, None, None, None)]
    docs = spark.createDataFrame([(i, t, l, s, len(t) if t else None) for i, t, l, s, _ in rows], DOCS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    a = p.toxic_out(spark, docs, sf)
    assert {r.doc_id for r in a.collect()} == {r[0] for r in rows} - {70}
    b = p.near_copies_out(spark, a, sf)
    assert {r.doc_id for r in b.collect()} == {r[0] for r in rows} - {70, 50, 51}
    c = {r.doc_id: r for r in p.passages_out(spark, b, sf).collect()}
    assert all(c[i].text == t for i, t, *_ in clean) and c[60].text == rows[14][1] and c[61].text.startswith("two three four") and c[71].text == ""
    d = p.mixed(spark, spark.createDataFrame(list(c.values())), sf)
    assert d.columns == list(p.COLUMNS)
    e = p.packed(spark, d, sf).collect()
    assert {r.doc_id for r in e} <= set(c) and all(r.length <= 2048 for r in e)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], DOCS)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
