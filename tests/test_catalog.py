import pytest

from murmurlake import catalog
from murmurlake.operators import spans
from murmurlake.samples import SENTENCES
from murmurlake.sources import readers
from murmurlake.plans import deidentify


def small_documents(spark, folder):
    rows = [(1, "Chen ring 070-123 45 67."), (2, "plain words  only"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
    return dict(rows)


def test_segments_of_every_document(spark, tmp_path):
    texts = small_documents(spark, tmp_path) | {-1 - i: t for i, t in enumerate(SENTENCES)}
    got = {}
    for r in catalog.pii_render_segments(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.seg_start, r.text))
    assert {i: "".join(t for _, t in sorted(x)) for i, x in got.items()} == {i: t for i, t in texts.items() if t}


TEXT = "Erik Andersson i Upplands Väsby har adhd och bipolär sjukdom, fick CONCERTA. Ann-Britt i Malmö, ADD; vi add, erik, Malmöbo, Eriks."


def test_lists_find_whole_words(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = sorted((r.span_start, r.text, r.category) for r in spans.listed_spans(docs).collect())
    want = [("Erik", "person"), ("Andersson", "person"), ("Upplands Väsby", "plats"), ("adhd", "diagnos"), ("bipolär sjukdom", "diagnos"), ("CONCERTA", "medicin"), ("Ann-Britt", "person"), ("Malmö", "plats"), ("ADD", "diagnos")]
    assert got == sorted((TEXT.index(t), t, c) for t, c in want)


def test_no_chain_of_terms_in_a_list():
    for x in spans.TERM_LISTS:
        long = [t.split() for t in x.terms() if " " in t]
        assert not {t[-1] for t in long} & {t[0] for t in long}


def test_listed_terms_are_masked(spark, tmp_path):
    spark.createDataFrame([(1, TEXT)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    masked = {r.doc_id: r.masked_text for r in catalog.pii_masked_text(spark, str(tmp_path)).collect()}[1]
    assert masked == "Person 1 Person 2 i Plats 1 har Diagnos 1 och Diagnos 2, fick Medicin 1. Person 3 i Plats 2, Diagnos 3; vi add, erik, Malmöbo, Eriks."
    direct = deidentify.deidentified(spark.createDataFrame([(1, TEXT)], "doc_id long, text string")).first()
    assert direct.masked_text == masked
    places = [r.text for r in catalog.QUERIES["pii_place_spans"](spark, str(tmp_path)).collect() if r.doc_id == 1]
    assert sorted(places) == ["Malmö", "Upplands Väsby"]


def test_every_query_but_three_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"chunk_count", "live_batch_chunks", "live_finalised"}
    assert not set(catalog.ORACLE_SQL) - set(catalog.QUERIES)


def test_segments_agree_over_a_meeting(spark):
    rows = spark.createDataFrame([(1, 0, "Moa Berg kom."), (1, 1, None), (1, 2, "Berg, Moa och Moa Berg."), (2, 0, "Moa")], "meeting_id long, idx int, text string")
    got = {(r.doc_id, r.para): r.masked_text for r in deidentify.deidentified_segments(rows).collect()}
    assert got == {(1, 0): "Person 1 Person 2 kom.", (1, 1): "", (1, 2): "Person 2, Person 1 och Person 1 Person 2.", (2, 0): "Person 1"}


def test_exports(spark):
    docs = spark.createDataFrame([(1, "Moa\nskrev till a@b.se")], "doc_id long, text string")
    paras = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 21)], "doc_id long, para int, p_start int, p_end int")
    assert deidentify.exported(docs).first().content == "Person 1\nskrev till E-post 1"
    lines, _ = readers.docx_paragraphs(bytes(deidentify.exported(docs, paras, "docx").first().content))
    assert lines == ["Person 1", "skrev till E-post 1"]
    with pytest.raises(ValueError):
        deidentify.exported(docs, paras, "pdf")


def test_sizes_halfway_between_decimals(spark, tmp_path):
    """Prices whose sizes are 9.25, 8.25 and 5.25 MB; none at all."""
    import duckdb

    prices = [99993.08, 89183.02, 56752.83, 1001.91, 499993.18, None]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = db.sql(catalog.ORACLE_SQL["short_times_and_sizes"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["short_times_and_sizes"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {"9.2 MB", "8.2 MB", "5.2 MB"} < {r[2] for r in got}
