from murmurlake.operators import recognition


def test_words():
    tokens = [(0.0, 0.1, b"[_BEG_]"), (0.1, 0.2, b" H"), (0.2, 0.3, b"\xc3"), (0.3, 0.4, b"\xb6r"), (0.4, 0.5, b" "), (0.5, 0.6, b" du")]
    assert recognition.words_of(tokens) == [(0.1, 0.4, "Hör"), (0.5, 0.6, "du")]
    assert recognition.words_of([(0.0, 0.1, b"\xb6r")]) == []


def test_torn_characters(spark):
    rows = [(1, 0, 0, 150, bytearray(b"h\xc3")), (1, 1, 150, 300, bytearray(b"\xb6r")), (1, 2, 300, 310, bytearray(b"  "))]
    got = recognition.mended_segments(spark.createDataFrame(rows, "meeting_id long, idx int, t0 int, t1 int, bytes binary")).orderBy("idx").collect()
    assert [(r.text, r.end) for r in got] == [("hö", 1.5), ("r", 3.0)]


def test_tokens_in_a_table(spark):
    rows = [(1, 0, 1, 30, 60, bytearray(b" d")), (1, 0, 0, 0, 30, bytearray(b" Hej")), (1, 0, 2, 60, 70, bytearray(b"u"))]
    got = recognition.assembled_words(spark.createDataFrame(rows, "meeting_id long, idx int, ord int, t0 int, t1 int, bytes binary")).first()
    assert [(w.text, w.start, w.end) for w in got.words] == [("Hej", 0.0, 0.3), ("du", 0.3, 0.7)]


def test_participants_terms_profiles(spark):
    speakers = spark.createDataFrame([(1, 0, "Anna"), (1, 1, " erik"), (1, 2, "ERIK"), (1, 3, "")], "meeting_id long, ord int, name string")
    have = spark.createDataFrame([(1, "ANNA ")], "meeting_id long, name string")
    assert [r.name for r in recognition.seeded_participants(speakers, have).collect()] == ["erik"]
    lines = spark.createDataFrame([("öl, ål;\nZ,ål",)], "value string")
    assert [r.term for r in recognition.own_terms(lines).collect()] == ["Z", "ål", "öl"]
    assert recognition.profiles(spark, ("person", "tid")).where("profile = 'allt'").count() == 2
    assert recognition.templates(spark).count() == 3
