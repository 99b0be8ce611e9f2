import random

from murmurlake.llm import toxicity


def labelled(n_toxic, n_clean):
    r = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    text = lambda bad: " ".join([*r.sample(plain, 12), *(r.sample(["grubble", "snarfing"], 1) if r.random() < bad else [])])
    return [(text(0.8), 1) for _ in range(n_toxic)] + [(text(0.03), 0) for _ in range(n_clean)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "row long, text string, toxic int")


def test_scores_do_not_depend_on_the_sampled_ratio(spark):
    rows = labelled(600, 4800)
    whole = toxicity.learn(frame(spark, rows))
    part = toxicity.learn(frame(spark, [*rows[:300], *rows[600:1100]]), (4800 / 500, 2.0))
    a, b = whole.automaton(), part.automaton()
    for text in ("word1 word2 word3", "word1 grubble word3", "snarfing word5 word6 word7"):
        assert abs(whole.score(whole.features(text, a)) - part.score(part.features(text, b))) < 0.08, text


def test_sample_says_what_it_stands_for(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(labelled(200, 1000))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    known = {r.toxic: r["count"] for r in labels.where(~toxicity.held_out()).groupBy("toxic").count().collect()}
    got, weights = toxicity.training_rows(docs, labels, most_toxic=40, most_clean=60)
    assert got.count() == 100 and weights == (known[0] / 60, known[1] / 40)
    assert toxicity.training_rows(docs, labels)[1] == (1.0, 1.0)


def test_folding_closes_disguises_up():
    for text in ("a$$", "a55", "A5S", "a s $ s"):
        assert toxicity.folded(text).replace(" ", "")[:2] == "as", text
    assert toxicity.folded("you s.t.u.p.i.d one") == " you stupid one "
    assert toxicity.folded("stuuuupid!!! m-o-r-o-n") == " stupid moron "
    assert toxicity.folded("I am a b c") == " i am a b c "


def test_automaton_equals_a_plain_search():
    r = random.Random(8)
    lex = toxicity.Lexicon({" bad ": 2.0, " rot": 1.5, " rotten ": 3.0, " ill": 1.0}, ("bad luck", "ill at ease"), (0.0, 1.0, 1.0))

    def plain(text):
        t = toxicity.folded(text)
        free = [(i, i + len(p) + 2) for p in lex.phrases for i in range(len(t)) if t.startswith(f" {p} ", i)]
        total, last = 0.0, -1
        for i in range(len(t)):
            fit = sorted((x for x in lex.terms if t.startswith(x, i)), key=len, reverse=True)
            for x in fit:
                if i >= last and not any(a <= i and i + len(x) <= b for a, b in free):
                    total, last = total + lex.terms[x], i + len(x) - 1
        return total

    words = ["bad", "luck", "rot", "rotten", "rotting", "ill", "at", "ease", "illness", "good", "b4d"]
    for _ in range(300):
        text = " ".join(r.choice(words) for _ in range(r.randrange(0, 12)))
        a, b = lex.features(text, lex.automaton())
        assert abs(a - float(__import__("math").log1p(plain(text)))) < 1e-9, text
        assert abs(b - plain(text) / (toxicity.folded(text).count(" ") + 50) * 50) < 1e-9


def test_empty_tables_and_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    sample, weights = toxicity.training_rows(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    lex = toxicity.learn(sample, weights)
    assert toxicity.score_texts(docs, lex).count() == 0
    more = spark.createDataFrame([(1, "idiot", 9.0), (1, "idiot", 9.0)], "doc_id long, text string, score double")
    out = toxicity.score_texts(more, lex, keep=("score",))
    assert out.columns == ["doc_id", "score", "predicted"] and [r.predicted for r in out.collect()] == [1, 1]
