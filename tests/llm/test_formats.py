import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurlake.llm import chat_format, fingerprint, html_extract, mixing, packing, toxicity
from murmurlake.llm.queries import tokenizer_path


def test_layouts_become_turns(spark):
    want = [("user", "Hi <b>"), ("assistant", "### user: </turn>\n\\h x")]
    u, a = want[0][1], want[1][1]
    records = [
        {"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": a}]},
        {"conversations": [{"from": "human", "value": u}, {"from": "gpt", "value": a}]},
        {"prompt": u, "completion": a},
        {"instruction": u, "output": a},
        {"instruction": u, "input": "", "output": a},
        {"question": u, "answer": a},
        {"turns": [{"turn": 2, "role": "assistant", "text": a}, {"turn": 1, "role": "user", "text": u}]},
    ]
    rows = [(i, json.dumps(r), "x") for i, r in enumerate(records)] + [(90, "{broken", "x"), (91, None, "x"), (92, '{"other": 1}', "x")]
    df = chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, "id long, record string, turns_of string")))
    got = {r.id: r for r in df.collect()}
    for i in range(len(records)):
        assert [(t.role, t.text) for t in got[i].read_turns] == want, records[i]
        assert got[i].loss_text == a and got[i].formatted.count("</turn>") == 2 and got[i].formatted.count("### ") == 2
    assert all(got[i].layout is None and got[i].turns is None for i in (90, 91, 92))


def test_layouts_of_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "human", "a: <b>"), (1, "gpt", "#c"), (None, None, None)], "conv_id long, from string, value string")
    got = {r.conv_id: (r.layout, r.formatted) for r in chat_format.format_rows(rows).collect()}
    assert got[1] == ("from and value", "### assistant: \\hc</turn>\n### user: a\\c \\lb></turn>\n") and got[None][1] == "### : </turn>\n"
    with pytest.raises(ValueError):
        chat_format.format_rows(rows.withColumn("more", F.lit(1)))
    record = '{"messages": [{"role": "user", "content": "hi"}]}'
    df = spark.createDataFrame([(record, 7, 8, 9)] * 2, "record string, v int, turns int, layout int")
    out = chat_format.format_chats(df)
    assert [(r.v, r.layout, r.turns[0].text) for r in out.collect()] == [(7, "messages", "hi")] * 2
    assert chat_format.format_chats(df.limit(0)).count() == 0 and chat_format.format_rows(rows.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "\\b\\\\h#", "a:b <c> # \\l", "### x: y</turn>\n", "å\U0001f600:"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.unescaped(chat_format.escaped(F.col("t"))).alias("u"))
    assert all(r.t == r.u for r in df.collect())


def test_mix(spark):
    rows = [(i, "w " * (i % 7 + 1), "abc"[i % 3] if i % 11 else None) for i in range(600)] + [(900, None, "z"), (901, "", "z")]
    df = mixing.mix(spark.createDataFrame([(i, t, s, 5) for i, t, s in rows], "doc_id long, text string, source string, target int"))
    got = df.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    by = {r.source: (r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in by.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s for s, t in by.values())
    for s, (_, t) in by.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 0.25 * t + 8
    again = {(r.doc_id, r.taken) for r in got}
    assert again == {(r.doc_id, r.taken) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()}
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert mixing.repeated(df).count() == sum(r.taken // r.size for r in got if r.size)


def test_plans_use_the_histogram_up():
    rng = np.random.default_rng(2)
    for cap, n in ((2048, 20_000), (64, 500), (10, 3)):
        counts = np.bincount(rng.integers(1, cap + 1, n), minlength=cap + 1)
        (plan, fitted), used = packing.plan_sequences(counts), np.zeros(cap + 1, dtype=int)
        assert 0 <= fitted <= sum(t for _, t in plan)
        for pattern, times in plan:
            assert sum(pattern) <= cap and times > 0
            np.add.at(used, list(pattern), times)
        assert (used == counts).all()
        lower = -(-int((counts * np.arange(cap + 1)).sum()) // cap)
        assert sum(t for _, t in plan) <= 1.06 * lower + 1


def test_fitted_counts_are_those_of_least_squares():
    rng = np.random.default_rng(6)
    for _ in range(20):
        cap = 12
        counts = np.bincount(rng.integers(1, cap + 1, 60), minlength=cap + 1).astype(float)
        patterns = packing.fitting_patterns(counts)
        weight = np.arange(cap + 1) / (cap + 1)
        a = np.array([[p.count(n) for p in patterns] for n in range(cap + 1)], dtype=float)
        error = lambda x: (weight * (a @ x - counts) ** 2).sum()  # noqa: E731, B023
        x, step = np.zeros(len(patterns)), 1 / np.linalg.norm(a.T @ (weight[:, None] * a), 2)
        for _ in range(20_000):  # projected gradient
            x = np.maximum(x - step * (a.T @ (weight * (a @ x - counts))), 0)
        got = packing.nnls_counts(patterns, counts)
        assert (got >= 0).all() and error(got) <= error(x) * 1.05 + 0.05


def test_packed_pieces(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    rows = [(1, "It's a test, don't."), (2, None), (3, ""), (4, "A b. " * 90), (5, "café " * 30), (6, "<|endoftext|> x"), (6, "<|endoftext|> x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, capacity=32).collect()
    ids = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.length == len(r.ids) // 4 <= 32
        if r.doc_id != 6:
            assert r.start == len(ids.get(r.doc_id, []))
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    for i, x in dict(rows).items():
        want = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert ids[i] == (want * 2 if i == 6 else want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 32
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_every_length_is_dealt_over_parts(spark):
    """As on a large corpus: each of the 2048 lengths has more pieces than one part is to have."""
    pieces = spark.range(3 * 2048).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 2048 + 1).alias("length"))
    got = packing.assign_sequences(pieces, 2048, least=1).select("doc_id", "length", "sequence_id", "offset").toPandas().sort_values(["sequence_id", "offset"])
    end = got["offset"] + got["length"]
    assert got["doc_id"].nunique() == len(got) == 3 * 2048 and (got["length"] == got["doc_id"] % 2048 + 1).all() and end.max() <= 2048
    assert (got["offset"] == end.groupby(got["sequence_id"]).shift(fill_value=0)).all()


def test_main_text(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body class='with-ads'><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use</div>"
        "<main><article><h1>T &amp; x</h1><p>One<br>two &nbsp; three <a href='>'>link</a><p>Is.<script>var a='</p>';</script><form><input>go</form><aside>side</aside><div>Four<!-- no --></div>"
        "<section id=comments><p>bah</p></section></article></main><footer>f</footer></body></html>"
    )
    plain = "<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div>" + "<p>" + "word " * 40 + "</p><p>Short.</p><div class=footer>end</div>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", plain), (5, "u", "<div>"), (6, "u", "<p>" + "x " * 50_000)]
    got = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == "T & x\n\nOne two three link\n\nIs.\n\nFour" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[5].text == ""
    assert got[4].text == ("word " * 40).strip() + "\n\nShort."
    assert got[6].n_chars == 99_999


def test_toxicity_holds_on_held_out_rows(spark):
    import duckdb

    rows = duckdb.sql("SELECT d.doc_id, d.text, l.toxic FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' l USING (doc_id)").fetchall()
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    lex = toxicity.learn(spark.createDataFrame([(i, t or "", y) for i, t, y in rows if not held(i)], "row long, text string, toxic int"))
    a = lex.automaton()
    out = [(lex.score(lex.features(t or "", a)) >= 0.3, bool(y)) for i, t, y in rows if held(i)]
    hit, false, missed = (sum(p and y for p, y in out), sum(p and not y for p, y in out), sum(y and not p for p, y in out))
    assert hit / (hit + missed) > 0.85 and hit / (hit + false) > 0.85


def test_toxicity_folding_and_edges(spark):
    assert toxicity.folded("1D10T! іdiot ​Mor­or") == " idiot idiot moror "
    lex = toxicity.learn(spark.createDataFrame([], "row long, text string, toxic int"))
    a = lex.automaton()
    assert lex.features("a trash can", a)[0] == 0 and lex.features("idiot", a)[0] > 0
    df = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (3, "you idiot moron", 3.0), (3, "you idiot moron", 3.0)], "doc_id long, text string, score double")
    got = [(r.doc_id, r.predicted) for r in toxicity.score_texts(df, lex).collect()]
    assert sorted(got) == [(1, 0), (2, 0), (3, 1), (3, 1)]


def test_likeness_is_near_weighted_jaccard(spark):
    rng = np.random.default_rng(4)
    rows, counts = [], []
    for i in range(60):
        c = {f"w{j}": int(n) for j, n in enumerate(rng.integers(0, 4, 80)) if n}
        if i % 2 and rng.random() < 0.8:
            c = {w: n + int(rng.random() < 0.1) for w, n in counts[-1].items() if rng.random() < 0.9}
        counts.append(c)
        rows.append((i, " ".join(w for w, n in c.items() for _ in range(n))))
    got = {r.doc_id: r.near_next for r in fingerprint.fingerprint_with_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    errors = []
    for i in range(59):
        a, b = counts[i], counts[i + 1]
        terms = a.keys() | b.keys()
        exact = sum(min(a.get(t, 0), b.get(t, 0)) for t in terms) / sum(max(a.get(t, 0), b.get(t, 0)) for t in terms)
        errors.append(got[i] - exact)
    assert np.sqrt(np.square(errors).mean()) < 0.09 and abs(np.mean(errors)) < 0.04 and np.abs(errors).max() < 0.3


def test_fingerprints(spark):
    rows = [(1, "a b c d e f g h " * 3), (2, "x y z w " * 5), (3, None), (4, ""), (7, "a b c d e f g h " * 3), (7, "q"), (None, "n m")]
    got = fingerprint.fingerprint_with_neighbours(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and by[1][0].fingerprint in {r.fingerprint for r in by[7]} and by[3][0].near_next == 1.0 and by[1][0].near_next < 0.2
    text, following = rows[0][1], rows[1][1]
    cut = len(text) // 4
    assert by[1][0].edited_sha256 == hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()
    assert fingerprint.fingerprint_with_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
