import base64
import codecs
import json
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurlake import catalog_base as base
from murmurlake.functions import signal, text
from murmurlake.operators import align, chunking, gazetteer, jobs, recognition, transcript
from murmurlake.sources import readers, writers
from murmurlake.streaming import live

ROWS = "meeting_id long, idx int, start double, end double, speaker string, text string"


def test_dominant_speaker(spark):
    seg = spark.createDataFrame([(1, 0, 0.5, 3.0), (1, 1, 28.0, 33.0), (1, 2, 90.0, 91.0), (1, 3, 40.0, 44.0), (1, 4, 50.0, 52.0)], "meeting_id long, idx int, start double, end double")
    turns = spark.createDataFrame([(1, 0.0, 30.5, 7), (1, 30.5, 42.0, 3), (1, 42.0, 44.0, 1), (1, 50.0, 51.0, 3), (1, 51.0, 52.0, 7)], "meeting_id long, start double, end double, speaker int")
    got = align.dominant_speaker(seg, turns).orderBy("idx").collect()
    assert [r.cluster for r in got] == [7, 3, None, 1, 3]  # the lowest of equals: 3 before 7, 1 before 3
    assert [r.speaker for r in align.numbered_speakers(align.dominant_speaker(seg, turns)).orderBy("idx").collect()] == ["TALARE_1", "TALARE_2", None, "TALARE_3", "TALARE_2"]


def test_echo(spark):
    same, other = "nästa vecka ses alla igen här", "jag tar med fika och gamla papper då"
    rows = [(1, 0, 20.0, 22.5, "Mötet", same), (1, 1, 25.4, 27.0, "Jag", same), (1, 2, 23.0, 24.0, "Jag", "alla ses"), (1, 3, 21.0, 23.0, "Jag", other), (1, 4, 25.6, 27.0, "Jag", same)]
    got = align.without_echo(spark.createDataFrame(rows, ROWS)).orderBy("idx").collect()
    assert [r.idx for r in got] == [0, 2, 3, 4]  # 4 begins 3.1 s after what it repeats


def test_rendering(spark):
    rows = spark.createDataFrame([(1, 0, 0.25, 7.125, "TALARE_4", "Nu."), (1, 1, 7.125, 9.0, None, "Va?"), (1, 2, 9.0, 4000.0, "TALARE_4", "Sen.")], ROWS)
    named = transcript.with_names(rows)
    assert transcript.as_text(named).first().transcript == "TALARE_4: Nu.\nVa?\nSen."
    assert transcript.as_srt(named).first().srt.startswith("1\n00:00:00,250 --> 00:00:07,125\nTALARE_4: Nu.\n\n2\n")
    assert "00:00:09.000 --> 01:06:40.000" in transcript.as_vtt(named).first().vtt
    new = spark.createDataFrame([(1, 0, "***")], "meeting_id long, idx int, new_text string")
    assert "TALARE_4: ***\n" in transcript.as_srt(transcript.with_names(transcript.with_texts(rows, new))).first().srt
    assert [r.grp for r in align.speaker_groups(rows).orderBy("idx").collect()] == [0, 1, 2]


def test_times_and_sizes(spark):
    row = spark.range(1).select(text.clock(F.lit(59.6)), text.clock(F.lit(3725.0)), text.short_time(F.lit(125.9)), text.size_label(F.lit(5 * 1048576)), text.size_label(F.lit(0)), text.titlecase(F.lit("ANNA-karin de la"))).first()
    assert list(row) == ["01:00", "1:02:05", "2:05", "5.0 MB", "", "Anna-Karin De La"]


def test_chunks():
    whole = "\n".join("ö" * (i % 9 + 1) for i in range(70))
    parts = chunking.split_lines(whole, 33)
    assert len(parts) > 9 and all(len(p.encode()) <= 33 and p.strip("\n") == p for p in parts) and "\n".join(parts) == whole
    assert all(len(f"{a}\n{b.split(chr(10))[0]}".encode()) > 33 for a, b in zip(parts, parts[1:], strict=False))  # none could have taken one line more
    assert chunking.split_lines("", 9) == [""] and chunking.split_lines("\r\n\nett", 9) == ["ett"]
    assert chunking.split_lines("aö" * 3, 4) == ["aöa", "öa\ufffd", "\ufffd"]


def test_summary_of_parts(spark):
    docs = spark.createDataFrame([(1, "kort"), (2, "\n".join(["rad " * 5] * 20)), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.summary for r in chunking.summarized(docs, "S", generate=lambda p, n: f" {n}:{p[-60:]} ", most=60).collect()}
    tail = "<|im_end|>\n<|im_start|>assistant\n"
    assert got[1].startswith(" 1024:") and got[1].strip(" ").endswith("\n\nkort" + tail) and got[3].strip(" ").endswith(":\n\n" + tail)
    parts = {r.doc_id: r.summary for r in chunking.summarized(docs, "S", generate=lambda p, n: f" {n} {'[Del 1]' + chr(10) + '512 False' + chr(10) * 2 + '[Del 2]' in p} ", most=60).collect()}
    assert parts == {1: " 1024 False ", 2: " 1024 True ", 3: " 1024 False "}
    asked = {r.doc_id: r.answer for r in chunking.answered(docs, "Vem?", generate=lambda p, n: f"{n}", most=60).collect()}
    assert asked == {1: "512", 2: "512", 3: "512"}
    made = chunking.proposed_actions(docs.where("doc_id = 1"), generate=lambda p, n: "- Ring Moa\n- [ ] Boka rum\n").collect()
    assert [r.action for r in made] == ["Ring Moa", "Boka rum"]
    for bad in (("custom", " "), ("okänd", "")):
        with pytest.raises(ValueError):
            chunking.structure_of(*bad)


def test_folders_and_due(spark):
    row = spark.range(1).select(jobs.moved(F.lit("a/b/c"), "/a/b/", "x"), jobs.moved(F.lit("a/bc"), "a/b", "x"), jobs.moved(F.lit("a/b/c"), "a/b", ""), F.array_join(jobs.ancestors(F.lit(" a / /b/c")), ",")).first()
    assert list(row) == ["x/c", "a/bc", "c", "a,a/b,a/b/c"]
    due = spark.createDataFrame([(d,) for d in (None, "snart", "2024-02-30", "2024-01-01", "2024-01-10", "2024-01-17", "2024-01-18")], "d string")
    assert [r[0] for r in due.select(jobs.due_state(F.col("d"), F.lit("2024-01-10").cast("date"))).collect()] == ["none", "text", "text", "overdue", "today", "soon", "future"]


def test_gazetteer(spark):
    rows = spark.createDataFrame([("ANNA-karin", "1 200"), ("A B", "9000"), ("Bo", "10"), ("eva", "501")], "term string, count string")
    assert [r.term for r in gazetteer.clean_terms(rows).collect()] == ["Anna-Karin", "Eva"]
    places = spark.createDataFrame([("Ystad och Svarte", "9 000"), ("Lund", "90000"), ("Byn", "12")], "name string, population string")
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    assert [r.term for r in gazetteer.localities(places, terms("Lund"), terms("x")).collect()] == ["Svarte", "Ystad"]


def test_signal(spark):
    t = np.arange(16_000) / 16_000
    ref = 0.4 * np.sin(2 * np.pi * 310 * t) + 0.2 * np.sin(2 * np.pi * 730 * t)
    mic = 0.5 * np.concatenate((np.zeros(64), ref[:-64]))
    out = signal.cancelled(mic, ref)
    assert np.square(out[9000:]).sum() < 0.1 * np.square(mic[9000:]).sum()
    assert (signal.cancelled(mic, np.zeros(16_000)) == mic).all()
    parts = [(mic[:4000], ref[:4000]), (mic[:900], ref[:900]), (mic[:100], np.zeros(100)), (np.zeros(0), ref)]
    for (m, r), got in zip(parts, signal.cancelled_each([m for m, _ in parts], [r for _, r in parts]), strict=True):
        assert np.allclose(got, signal.cancelled(m, r)) and len(got) == len(m)
    row = spark.createDataFrame([([0.5, 0.75, -1.0], [0.75])], "a array<float>, b array<float>").select(signal.mix(F.col("a"), F.col("b")), signal.rms(F.col("b")), signal.peak(F.col("a")), signal.downmix(F.col("a"), 2, True)).first()
    assert list(row) == [[1.0, 0.75, -1.0], 0.75, 1.0, [0.625, -1.0]]
    assert len(signal.resample_linear(np.ones(480), 48_000, 16_000)) == 160 and len(signal.resample_sinc(np.ones(480), 48_000)) == 160


def test_utf8_tails():
    """Every cut of a text, against a decoder: as many bytes are lacking as complete the character that was cut."""
    whole = "å vid ∑ och 𝄞!".encode()
    for n in range(len(whole) + 1):
        done = len(codecs.getincrementaldecoder("utf-8")().decode(whole[:n]).encode())
        following = next(m for m in range(n, len(whole) + 1) if m == n == done or m > n and len(codecs.getincrementaldecoder("utf-8")().decode(whole[:m]).encode()) > done) if done < n else n
        assert signal.tail_bytes(whole[:n]) == following - n
    assert signal.tail_bytes(bytes([0x85] * 7)) == signal.tail_bytes(b"ok" + bytes([0xFE])) == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(writers.docx_bytes(["Hej & hå", "", "två"]))
    (tmp_path / "b.txt").write_text("rad\nrad")
    got = {r.path[-6:]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "Hej & hå\n\ntvå\n" and len(got["a.docx"].paras) == 3 and not got["a.docx"].has_tables
    assert got["/b.txt"].text == "rad\nrad"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "s.wav").write_bytes(writers.wav_bytes([0.0, 0.5, -2.0]))
    r = readers.read_wav(spark, str(tmp_path / "w")).first()
    assert r.rate == 16_000 and [round(x, 2) for x in r.samples] == [0.0, 0.5, -1.0]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text('{"version":1,"id":"a","jobType":"file","title":"t","createdAt":"x","updatedAt":"y","actions":[{"text":"gör","done":false}]}')
    (tmp_path / "j" / "2.json").write_text('{"id":"b"}')
    (tmp_path / "j" / "3.json").write_text("{broken")
    assert [r.id for r in readers.read_jobs(spark, str(tmp_path / "j")).collect()] == ["a"]
    assert readers.read_tasks(spark, str(tmp_path / "none.json")).count() == 0


def test_stored_jobs_reach_the_operators(spark, tmp_path):
    stored = {
        "version": 1, "id": "a1", "jobType": "transcribe", "title": "Möte", "createdAt": "2024-01-01", "updatedAt": "2024-01-02", "category": "Skola", "summaryDraft": "Kort om fönster",
        "followup": "Ring Moa", "actions": [{"text": "gör", "done": True, "assignee": "Olle", "due": ""}], "participants": [{"name": "Kim", "role": "rektor"}],
        "transcript": {"utterances": [{"start": 0.0, "end": 1.0, "speaker": "S", "text": "vi byter lampor", "words": []}], "language": "sv", "model": "m", "diarized": False}, "transcriptionPending": False,
    }
    (tmp_path / "a1.json").write_text(json.dumps(stored))
    found = jobs.from_stored(readers.read_jobs(spark, str(tmp_path)))
    row = jobs.listing(found).first()
    assert (row.id, row.updated_at, row.n_actions, row.n_done) == ("a1", "2024-01-02", 1, 1)
    for query in ("fönster", "ring moa", "OLLE", "rektor", "lampor", "skola"):
        assert jobs.matching(found, query).count() == 1, query
    assert jobs.matching(found, "saknas").count() == 0 and jobs.matching(found, " ").count() == 1
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.project").write_text(json.dumps({"version": 1, "transcript": stored["transcript"], "speaker_labels": {"S": "Kim"}}))
    project = readers.read_project(spark, str(tmp_path / "p")).first()
    assert project.speaker_labels == {"S": "Kim"} and project.transcript.utterances[0].text == "vi byter lampor"
    (tmp_path / "p" / "y.project").write_text("{}")
    with pytest.raises(Exception, match="no project file"):
        readers.read_project(spark, str(tmp_path / "p" / "y.project")).collect()


def test_audio_files_have_a_status(spark, tmp_path):
    def wav(name, width, raw):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1), w.setsampwidth(width), w.setframerate(8000), w.writeframes(raw)

    wav("a.wav", 3, bytes([0, 0, 0x40, 0, 0, 0xC0]))
    wav("b.wav", 1, bytes([128, 255]))
    (tmp_path / "c.wav").write_bytes(b"no sound")
    (tmp_path / "d.ogg").write_bytes(b"x")
    got = {r.path[-5:]: r for r in readers.read_audio(spark, str(tmp_path)).collect()}
    assert got["a.wav"].samples == [0.5, -0.5] and [round(x, 2) for x in got["b.wav"].samples] == [0.0, 0.99]
    assert got["c.wav"].status.startswith("unreadable") and got["d.ogg"].status == "no decoder for this format" and got["d.ogg"].rate is None
    assert readers.read_wav(spark, str(tmp_path)).count() == 2
    more = readers.read_audio(spark, str(tmp_path), {"ogg": lambda data: (1000, [0.25] * len(data))}).where("path LIKE '%ogg'").first()
    assert (more.status, more.rate, more.samples) == ("ok", 1000, [0.25])


def test_catalogue_and_recordings(spark, tmp_path):
    (tmp_path / "qwen2.5-3b.gguf").write_bytes(b"x")
    assert [r.id for r in readers.model_catalogue(spark, str(tmp_path)).where("downloaded").collect()] == ["qwen2.5-3b"]
    assert readers.model_catalogue(spark).count() == 8
    rows = spark.createDataFrame([(1, 1, [0.5]), (1, 0, [0.25, -1.0])], "id long, seq int, samples array<double>")
    r = readers.encoded_recordings(rows).first()
    assert r.samples == [0.25, -1.0, 0.5] and np.frombuffer(base64.b64decode(r.payload), "<f4").tolist() == r.samples


def test_registers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Skolenhetsnamn;Status\nInternationella Skolan Bro;Aktiv\nAnpassad grundskola;Aktiv\nNorra Friskolan;Vilande\nSkolan i Ån;\nEnord;Aktiv\n")
    assert [r.term for r in gazetteer.schools(gazetteer.read_register(spark, str(tmp_path / "a.csv"))).collect()] == ["Internationella Skolan Bro", "Skolan i Ån"]
    (tmp_path / "b.json").write_text('{"n": 1, "Rader": [{"namn": "Lilla Skolan Ek", "Status": null}], "Andra": [{"namn": "Nej Nej"}]}')
    assert [r.term for r in gazetteer.schools(gazetteer.read_register(spark, str(tmp_path / "b.json"))).collect()] == ["Lilla Skolan Ek"]
    (tmp_path / "c.csv").write_text("ort,folkmangd\nA,1\n")
    assert gazetteer.read_register(spark, str(tmp_path / "c.csv")).columns == ["ort", "folkmangd"]
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Förnamn</t></si><si><t>Antal</t></si><si><r><t>MO</t></r><r><t>A</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>2023</t></is></c></row><row><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="B3" t="s"><v>2</v></c><c r="C3"><v>700</v></c></row></sheetData></worksheet>')
    terms = gazetteer.read_workbook(spark, str(tmp_path / "d.xlsx")).withColumnRenamed("name", "term")
    assert [r.term for r in gazetteer.clean_terms(gazetteer.both_lists(terms, terms)).collect()] == ["Moa"]
    lines = gazetteer.list_lines(gazetteer.clean_terms(terms), ["# a", "# b"])
    assert [r.value for r in lines.collect()] == ["# a", "# b", "", "Moa"]


def test_actions_change_by_index(spark):
    df = spark.createDataFrame([(1, "2024-01-01", [("a", False, "", ""), ("b", False, "", "")]), (2, "2024-01-01", None)], "id long, updated_at string, actions array<struct<text:string,done:boolean,assignee:string,due:string>>")
    of = lambda rows, i: next((r.updated_at, [(a.text, a.done, a.due) for a in r.actions or []]) for r in rows.collect() if r.id == i)
    assert of(jobs.action_set(df, 1, 1, "now", text="c", done=True, due="2024-02-02"), 1) == ("now", [("a", False, ""), ("c", True, "2024-02-02")])
    for idx in (2, -1):
        with pytest.raises(Exception, match="there is no action"):
            jobs.action_set(df, 1, idx, "now", text="x").collect()
        assert of(jobs.action_deleted(df, 1, idx, "now"), 1)[0] == "2024-01-01"
    assert of(jobs.action_added(df, 2, "now", text="n"), 2) == ("now", [("n", False, "")])
    assert of(jobs.action_deleted(df, 1, 0, "now"), 1) == ("now", [("b", False, "")])
    with pytest.raises(Exception, match="there is no job"):
        jobs.job_by_id(df, 9).collect()


def test_forced_cuts_and_every_cut():
    """Against the definition, sample by sample: quietest frame from 2.5 s on once there are 6 s, at 11 s if there are as many."""
    rng = np.random.default_rng(3)
    for seconds in (20, 8, 6, 5):
        x, rate = rng.normal(size=seconds * 100), 100
        at = live.cut_point(x, rate)
        if seconds < 6:
            assert at is None
        elif seconds >= 11:
            assert at == 1100
        else:
            frames = [(float(np.sqrt(np.mean(x[i : i + 3] ** 2))), i) for i in range(250, len(x) - 2, 3)]
            assert at == min(frames)[1]


def test_batch_chunks_equal_one_pass(spark):
    df = spark.createDataFrame(_pieces(), "source string, start_s double, samples array<double>, rate int")
    df = df.unionByName(spark.createDataFrame([("long", 0.0, np.random.default_rng(1).normal(size=4000).tolist(), 100), ("long", 90.0, [0.5] * 300, 100)], df.schema))
    want = []
    for source in ("long", "meeting", "mic"):
        c = live.Chunker()
        for r in df.where(F.col("source") == source).orderBy("start_s").collect():
            want += [(source, round(s, 6), len(x)) for s, x in c.push(r.start_s, r.samples, r.rate)]
        want += [(source, round(s, 6), len(x)) for s, x in c.flush()]
    got = sorted((r.source, round(r.start_s, 6), len(r.samples)) for r in live.batch_chunks(df).collect())
    assert got == sorted(want) and ("long", 0.0, 1100) in got


def _quiet(spark):
    """Pieces of which a task, or an Arrow batch, gives no chunk: silence, and what is too short to flush."""
    rows = [(f"s{i}", 0.0, [0.0] * 800 if i % 2 else [0.5] * 50, 100) for i in range(6)]
    return spark.createDataFrame(rows, "source string, start_s double, samples array<double>, rate int")


def test_nothing_found_in_a_task(spark):
    quiet, loud = _quiet(spark), spark.createDataFrame([("loud", 0.0, [0.5] * 300, 100)], "source string, start_s double, samples array<double>, rate int")
    assert live.batch_chunks(quiet).collect() == []
    assert [(r.source, r.start_s, len(r.samples)) for r in live.batch_chunks(quiet.union(loud)).collect()] == [("loud", 0.0, 300)]


def test_stop_and_recovery(spark):
    df = spark.createDataFrame(_pieces(), "source string, start_s double, samples array<double>, rate int")
    both = live.both_sources(df.where("source = 'mic'"), df.where("source = 'meeting'"))
    assert both.count() == df.count()
    heard = live.recognised(live.batch_chunks(both), live.energy_stub)
    late = live.finalised(heard.limit(1), both, live.energy_stub, behind_s=11.0)
    assert late.count() == heard.count() and live.finalised(heard.limit(1), both, live.energy_stub, behind_s=9.0).count() == 1

    def fails(samples):
        if len(samples) > 700:
            raise RuntimeError("too long")
        return live.energy_stub(samples)

    some = live.recognised(live.batch_chunks(both), fails)
    sizes = [len(r.samples) for r in live.batch_chunks(both).collect()]
    assert some.where("failed").count() == sum(n > 700 for n in sizes) and some.count() == len(sizes)
    assert live.stop_figures(both).first().duration_s == 40.0
    stubs = live.pending_stubs(spark.createDataFrame([(1, "t", "a.wav", "2024")], "id long, title string, audio_path string, created_at string"))
    done = spark.createDataFrame([(1, "text", "2025"), (9, "x", "y")], "id long, transcript string, updated_at string")
    twice = live.recovered(live.recovered(stubs, done), done).collect()
    assert [(r.transcript, r.transcription_pending, r.updated_at) for r in twice] == [("text", False, "2025")]


def test_stop_with_quiet_tasks(spark):
    quiet, loud = _quiet(spark), spark.createDataFrame([("loud", 0.0, [0.5] * 300, 100)], "source string, start_s double, samples array<double>, rate int")
    late = lambda rows: [(r.source, r.start, r.end) for r in live.finalised(None, rows, live.energy_stub, behind_s=12.0).collect()]
    assert late(quiet) == [] and late(quiet.union(loud)) == [("loud", 0.0, 3.0)]


def test_slices_of_pieces_equal_whole_ones(spark, monkeypatch):
    """Gaps, overlaps, short and equal starts: the chunks of slices are those of whole pieces."""
    rng = np.random.default_rng(5)
    rows = [(f"s{k}", at, (rng.normal(size=n) * 0.3).tolist(), 10) for k in range(3) for at, n in ((0.0, 500 + k), (45.0, 70), (52.0, 333), (200.0, 61), (201.0, 900), (300.0, 0))]
    df = spark.createDataFrame([*rows, ("none", 0.0, [], 10)], "source string, start_s double, samples array<double>, rate int")
    want = []
    for k in range(3):
        c = live.Chunker()
        want += [(f"s{k}", s, x.tolist()) for _, at, x, rate in rows[k * 6 : k * 6 + 6] for s, x in c.push(at, x, rate)]
        want += [(f"s{k}", s, x.tolist()) for s, x in c.flush()]
    for most in (1, 37, 110, 1 << 20):
        monkeypatch.setattr(live, "SLICE", most)
        assert sorted(map(tuple, live.batch_chunks(df).collect())) == sorted(want)


def test_no_users_values_are_gathered(spark, tmp_path):
    """A user's recording comes in slices of bounded length, and these give the chunks of the whole pieces, signals in order of the event."""
    events = [(i, u, float(i * 37 % 101)) for u in (1, 2, None) for i in range(400 if u == 1 else 41)] + [(None, 1, 9.0), (6, 3, 50.0), (7, 4, None)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    slices = base.recordings(spark, str(tmp_path), 16)
    assert slices.selectExpr("max(size(samples))").first()[0] == 16
    whole = []
    for u in (1, 2, None, 3):
        a, b = ([v / 100.0 for i, w, v in sorted(x for x in events if x[0] is not None and x[1] == u) if i % 2 == odd] for odd in (0, 1))
        x = a + b + a[::-1] + b[::-1]
        whole += [(None if u is None else str(u), 0.0, x, 2), (None if u is None else str(u), len(x) / 2, x, 2)]
    df = spark.createDataFrame(whole, "source string, start_s double, samples array<double>, rate int")
    of = lambda rows: sorted(((r.source or "", r.start_s, r.samples) for r in live.batch_chunks(rows).collect()))
    assert of(slices) == of(df) and len(of(df)) > 80


def test_lag_is_told_once(spark, tmp_path):
    rows = [("mic", float(i), float(i) + (40.0 if i > 3 else 1.0)) for i in range(8)] + [("meeting", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "source string, start_s double, now_s double")
    for i in range(2):
        df.where(F.col("start_s") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.lag_warnings(stream).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.source for r in spark.table("late").collect()] == ["mic"]


def test_voices_and_words(spark):
    x = [0.1] * 10 + [0.0] * 10 + [0.9] * 8 + [0.0] * 2 + [0.9] * 4 + [0.0] * 20 + [0.5] * 1
    turns = align.diarised(spark.createDataFrame([(1, x, 10)], "meeting_id long, samples array<double>, rate int")).orderBy("start").collect()
    assert [(round(r.start, 1), round(r.end, 1), r.speaker) for r in turns] == [(0.0, 1.0, 0), (2.0, 3.4, 1)]
    negative = align.diarised(spark.createDataFrame([(1, x, 10)], "meeting_id long, samples array<double>, rate int"), lambda x, r: [(1.0, 2.0, -1), (0.0, 1.0, 3)]).collect()
    assert [(r.start, r.speaker) for r in negative] == [(0.0, 3), (1.0, 0)]
    heard = recognition.transcribed(spark.createDataFrame([(1, [0.0] * 16, 8), (2, [], 8)], "meeting_id long, samples array<double>, rate int"), language="sv").collect()
    assert [(r.start, r.end, r.text) for r in heard] == [(0.0, 2.0, "sv 16")]


def test_word_cues(spark):
    words = lambda *ws: [(w, s, e) for w, s, e in ws]
    rows = [(1, 0, "A", "A", [(0.0, 1.0, "Hej"), (1.0, 2.0, "du")]), (1, 1, None, None, []), (1, 2, "A", "A", [(3.0, 4.0, "Ja")])]
    df = spark.createDataFrame(rows, "meeting_id long, idx int, speaker string, name string, words array<struct<start:double,end:double,text:string>>")
    vtt = transcript.as_word_vtt(df).first().vtt
    assert "A: Hej" in vtt and "\ndu\n" in vtt and "A: Ja" in vtt and words() == []  # a row of nobody lies between


def test_edits_drop_words(spark):
    schema = "meeting_id long, idx int, speaker string, text string, words array<struct<start:double,end:double,text:string>>"
    df = spark.createDataFrame([(1, 0, "A", "det är bra", [(0.0, 1.0, "det")]), (1, 1, "A", "nej", [(1.0, 2.0, "nej")])], schema)
    got = {r.idx: (r.text, r.changed, len(r.words)) for r in transcript.with_corrections(df, "bra=>dåligt").collect()}
    assert got == {0: ("det är dåligt", True, 0), 1: ("nej", False, 1)}
    with pytest.raises(ValueError):
        transcript.payload(F.lit("x"), "p", masked=False)


def _pieces():
    rng = np.random.default_rng(0)
    rows = []
    for source in ("mic", "meeting"):
        x = rng.normal(size=100 * 40) * np.repeat(rng.choice([0.0, 0.5], 40), 100)
        rows += [(source, i * 1.0, x[i * 100 : i * 100 + 100].tolist(), 100) for i in range(40)]
    return rows


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(_pieces(), "source string, start_s double, samples array<double>, rate int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.read_capture(spark, str(tmp_path / "in"))
    q = live.live_chunks(stream).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r.source, round(r.start_s, 6), len(r.samples)) for r in rows)
    least, most = (key(live.batch_chunks(df, flush=f).collect()) for f in (False, True))  # the stream may have flushed by then
    got = key(spark.table("chunks").collect())
    assert least and set(least) <= set(got) <= set(most) and len(got) == len(set(got))
