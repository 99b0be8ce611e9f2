import random

import pytest

from murmurlake.operators import masking, spans
from murmurlake.samples import SENTENCES

RULES = {r.name: r for r in spans.RULES}


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


#: What each of murmurlake.samples.SENTENCES gives, in its order.
FOUND = [
    [("personnummer", "640823-3234", 1.0)], [("personnummer", "196408233234", 1.0)], [("personnummer", "640823-3231", 0.6)], [("personnummer", "050614-2345", 0.6), ("telefon", "050614-2345", 0.9)], [], [],
    [("telefon", "073-555 01 23", 0.9)], [], [("personnummer", "0712012345", 0.6), ("telefon", "0712012345", 0.9)], [("icd10", "F84.1", 0.85), ("icd10", "G40", 0.85)], [("icd10", "QX12", 0.85)], [("lagenhet", "lgh 1203", 0.9), ("gatuadress", "Lindgatan 7", 0.85)],
    [("gatuadress", "Ekvägen 14C", 0.85)], [("gatuadress", "Södra Hamngatan 22", 0.85)], [], [("skolnamn", "Ängsskolan", 0.8)], [("skolnamn", "Bergagymnasiets", 0.8)], [],
    [("url", "https://vattenbruk.se/nytt", 0.95), ("url", "www.hamn.example", 0.95)], [("ip_adress", "10.20.30.40", 0.9)], [],
    [("gatuadress", "Lundgatan 3 i", 0.85), ("epost", "chen.lund@lund.se", 1.0), ("telefon", "070-555 12 34", 0.9)], [("skolnamn", "Bergaskolan", 0.8)], [],
    [], [], [],
]


def test_rules_find_exactly(spark):
    docs, found = docs_of(spark, *SENTENCES), {}
    for name, rule in RULES.items():
        for r in spans.rule_spans(docs, rule).collect():
            assert SENTENCES[r.doc_id][r.span_start : r.span_end] == r.text
            found.setdefault(r.doc_id, []).append((name, r.text, round(r.score, 2)))
    wanted = {i: sorted(w) for i, w in enumerate(FOUND) if w}
    wanted[10] = []  # QX12: two letters before the digits are no code
    assert {i: sorted(w) for i, w in found.items()} == {i: w for i, w in wanted.items() if w}


def test_terms(spark):
    docs = docs_of(spark, "Gruppen kallas blå havet på Rum 12.", "blåsa", "Svaret blev GAD igår", "hon sa gad och teg", "Ann-Brittas ur", "Berg satt på ett berg")
    hit = lambda terms, ci: sorted((r.doc_id, r.text) for r in spans.term_spans(docs, terms, "egen", ignore_case=ci).collect())
    by_list = lambda terms: sorted((r.doc_id, r.text) for r in spans.token_term_spans(docs, spark.createDataFrame([(t,) for t in terms], "term string"), "person", 0.5).collect())
    assert hit(["BLÅ HAVET", "Rum 12"], True) == [(0, "Rum 12")]  # only ASCII letters are folded
    assert hit(["blå HAVET", "Rum 12"], True) == [(0, "Rum 12"), (0, "blå havet")]
    assert hit(["blå", " "], True) == [(0, "blå")]
    for terms in (["GAD"], ["Ann", "Ann-Britt"], ["Berg"], ["blå", "blå havet"]):
        assert hit(terms, False) == by_list(terms)
    assert by_list(["GAD"]) == [(2, "GAD")] and by_list(["Ann", "Ann-Britt"]) == [] and by_list(["Berg"]) == [(5, "Berg")]
    assert hit([], False) == by_list([" "]) == []
    with pytest.raises(ValueError):
        spans.token_term_spans(docs, spark.createDataFrame([("a",), ("b",)], "term string"), "person", 0.5, max_terms=1)


def test_names_with_hyphens(spark):
    docs = docs_of(spark, "Ann-Britt gick", "Karl-Ann-Britt och Ann", "Ann-Brittas")
    terms = spark.createDataFrame([("Ann",), ("Ann-Britt",), ("Britt",)], "term string")
    got = sorted((r.doc_id, r.span_start, r.text) for r in spans.token_term_spans(docs, terms, "person", 0.5).collect())
    assert got == [(0, 0, "Ann-Britt"), (1, 5, "Ann-Britt"), (1, 19, "Ann")]


def test_rows_resolve_as_spans_do(spark):
    """Random spans: within a row, by a shuffle, and by trying every span against all kept."""
    rng = random.Random(5)
    rows = []
    for doc in range(40):
        for d in range(rng.randrange(0, 25)):
            s = rng.randrange(0, 60)
            e = s + rng.randrange(0, 12)
            rows.append((doc, s, e, "x" * (e - s), rng.choice(["person", "plats"]), rng.choice(list(spans.PRIORITY)), 1.0, d % 4, d))
    want = {}
    for doc in range(40):
        kept = []
        for r in sorted((r for r in rows if r[0] == doc and r[2] > r[1]), key=lambda r: (-spans.PRIORITY[r[5]], -(r[2] - r[1]), r[1], r[7], r[8])):
            if all(r[2] <= k[1] or k[2] <= r[1] for k in kept):
                kept.append(r)
        want[doc] = sorted((k[1], k[2], k[4]) for k in kept)
    names = ["doc_id", "span_start", "span_end", "text", "category", "source", "score", "detector_ord", "emit_ord"]
    for doc in range(40):
        got = masking.without_overlaps([dict(zip(names, r, strict=True)) for r in rows if r[0] == doc])
        assert [(k["span_start"], k["span_end"], k["category"]) for k in got] == want[doc]
    schema = "doc_id long, span_start int, span_end int, text string, category string, source string, score float, detector_ord int, emit_ord int"
    got = {}
    for r in masking.resolve(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.doc_id, []).append((r.span_start, r.span_end, r.category))
    assert {d: sorted(x) for d, x in got.items()} == {d: x for d, x in want.items() if x}


def test_analysed_rows(spark):
    text = "Anna såg Anna och  Erik; anna@ex.se, ring 073-555 01 23."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = masking.analysed(docs)
    assert {r.doc_id: (r.masked_text, r.n_spans) for r in masking.spliced(rows).collect()} == {1: ("Person 1 såg Person 1 och  Person 2; E-post 1, ring Telefon 1.", 5), 2: (None, 0), 3: ("", 0)}
    assert masking.spliced(masking.analysed(docs, {"epost"})).where("doc_id = 1").first().masked_text == text.replace("anna@ex.se", "E-post 1")
    same = masking.masked(docs, masking.pseudonyms(masking.resolve(spans.candidates(docs)))).where("doc_id = 1").first()
    assert same.masked_text == masking.spliced(rows).where("doc_id = 1").first().masked_text
    assert masking.analysed(docs.limit(0)).count() == 0
    own = masking.spliced(masking.analysed(docs, {"egen"}, terms=["SÅG"])).where("doc_id = 1").first()
    assert own.n_spans == 0  # å is no ASCII letter
    assert [r.original for r in masking.audit(docs, masking.spans_of(rows)).orderBy("span_start").collect()] == ["Anna", "Anna", "Erik", "anna@ex.se", "073-555 01 23"]


def test_tagger(spark):
    docs = docs_of(spark, "Lisa Berg-Krok kom", "inget", " ", "Nils, Olof")
    got = sorted((r.doc_id, r.text, r.source) for r in spans.model_spans(docs).collect())
    assert got == [(0, "Lisa Berg-Krok", "model"), (3, "Nils", "model"), (3, "Olof", "model")]
    first = lambda tokens: [[0.0, 9.0], *[[0.0, 1.0] if i == 0 else [1.0, 1.0] for i, _ in enumerate(tokens)], [0.0, 9.0]]
    tags = spans.token_tags(docs_of(spark, "a b c d e"), logits=first, window=2).orderBy("ord").collect()
    assert [(r.ord, r.s) for r in tags] == [(0, 0), (2, 4), (4, 8)]  # each window's first token; ties go to the first label
    gated = spans.candidates(docs, {"epost"}, tagger={}).where("source = 'model'")
    assert gated.count() == 0 and spans.candidates(docs, {"person"}, tagger={}).where("source = 'model'").count() == 3
    with pytest.raises(ValueError):
        spans.candidates(docs, use_ai=True)


def test_manual_spans_are_checked(spark):
    docs = docs_of(spark, "abcdef")
    schema = "doc_id long, span_start int, span_end int, category string, custom string"
    r = spans.manual_spans(docs, spark.createDataFrame([(0, 1, 3, "egen", " ")], schema)).first()
    assert (r.text, r.custom) == ("bc", None)
    for bad in ((0, 3, 3), (0, 2, 9), (0, -1, 2)):
        with pytest.raises(Exception, match="no such range"):
            spans.manual_spans(docs, spark.createDataFrame([(*bad, "egen", None)], schema)).collect()


def span_rows(spark, rows):
    schema = "doc_id long, span_start int, span_end int, text string, category string, source string, score float, detector_ord int, emit_ord int"
    return spark.createDataFrame([(1, s, e, t, c, src, 1.0, d, 0) for d, (s, e, t, c, src) in enumerate(rows)], schema)


def test_resolve(spark):
    got = masking.resolve(span_rows(spark, [(0, 11, "x" * 11, "person", "model"), (0, 11, "x" * 11, "personnummer", "rule")])).collect()
    assert [r.category for r in got] == ["personnummer"]
    chain = span_rows(spark, [(0, 10, "a" * 10, "epost", "rule"), (8, 20, "b" * 12, "egen", "dictionary"), (18, 25, "c" * 7, "person", "model")])
    assert [r.span_start for r in masking.resolve(chain).orderBy("span_id").collect()] == [0, 18]
    assert masking.resolve(chain, {"plats"}).count() == 0


def test_pseudonyms_and_masks(spark):
    text = "Moa ringde Moa sen Olle."
    found = span_rows(spark, [(0, 3, "Moa", "person", "model"), (11, 14, "Moa", "person", "model"), (19, 23, "Olle", "person", "model")])
    kept = masking.resolve(found)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "fri")], "doc_id long, text string")
    out = {r.doc_id: (r.masked_text, r.n_spans) for r in masking.masked(docs, masking.pseudonyms(kept)).collect()}
    assert out == {1: ("Person 1 ringde Person 1 sen Person 2.", 3), 2: (None, 0), 3: ("fri", 0)}
    rejected = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, span_id int")
    assert [r.replacement for r in masking.pseudonyms(masking.accepted(kept, rejected)).collect()] == ["Person 1"]


def test_manual_replaces_what_it_overlaps(spark):
    found = span_rows(spark, [(0, 5, "aaaaa", "person", "model"), (5, 9, "bbbb", "plats", "rule")])
    manual = spark.createDataFrame([(1, 3, 5, "aa", "egen")], "doc_id long, span_start int, span_end int, text string, category string")
    got = masking.resolve(spans.with_manual(found, manual)).orderBy("span_start").collect()
    assert [(r.span_start, r.source) for r in got] == [(3, "manual"), (5, "rule")]


def test_segments_cover_the_text(spark):
    text = "Skriv  till\nkaj@exempel.se el. 073-555 01 23"
    docs = docs_of(spark, text)
    segs = masking.render_segments(masking.analysed(docs)).orderBy("seg_start").collect()
    assert "".join(r.text for r in segs) == text
    assert sum(r.span_id is not None for r in segs) == 2


@pytest.mark.parametrize("raw, want", [('Svar: ["Moa Ek", "Kiruna"] slut', ["Moa Ek", "Kiruna"]), ('["Moa Ek", "Kiruna", "Alved', ["Moa Ek", "Kiruna"])])
def test_salvage(spark, raw, want):
    rows = spans.proposals_of(spark.createDataFrame([(1, raw)], "doc_id long, raw string")).collect()
    assert [r.proposal for r in rows] == want


def test_token_spans_join(spark):
    docs = docs_of(spark, "Per-Olof åt", "Saras mormor", "Ulla Ek-Dal sov", "Ida, Max")
    tags = [(0, 0, 2, 3), (0, 1, 4, 7), (1, 0, 0, 4), (2, 0, 0, 4), (2, 1, 5, 7), (2, 2, 8, 11), (3, 0, 0, 3), (3, 1, 5, 8)]
    tags[0] = (0, 0, 0, 2)
    df = spark.createDataFrame([(d, o, "person", s, e) for d, o, s, e in tags], "doc_id long, ord int, category string, s int, e int")
    got = sorted((r.doc_id, r.text) for r in spans.joined_token_spans(docs, df).collect())
    assert got == [(0, "Per-Olof"), (1, "Saras"), (2, "Ulla Ek-Dal"), (3, "Ida"), (3, "Max")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert masking.masked(docs, masking.pseudonyms(masking.resolve(spans.all_rules(docs)))).count() == 0
