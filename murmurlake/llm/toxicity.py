"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguises, normalised by length.

The lexicon is a short fixed list plus words and word beginnings learned from labelled rows; hits inside exception phrases
do not count. The sum of weights, and its share of the length, go through a logistic curve fitted on the same rows. Words, terms,
phrases and features of the labelled rows are counted by executors; the driver sees counts, chosen terms and two numbers for each row.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import guarded_join, pick, small_batches, written

#: Insults that count even without labelled examples, and phrases in which such words are harmless.
INSULTS = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "disgusting", "loser", "imbecile", "dumbass")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "stupid mistake of mine")
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
_LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏοαερνικυ", "aeopcyxijsdhloaepviku" + "")
_DIGITS = str.maketrans("013457@$", "oieastas")
#: A digit or sign that begins a word or stands inside one, before a letter, or ends one, after a letter.
_DISGUISED = re.compile(r"(?<![\d.,:/=_-])[013457@$]{1,2}(?=[^\W\d_])|(?<=[^\W\d_])[013457@$]{1,2}(?![\w@$#%&*])")
#: Four or more words of one letter, once words are single-spaced; a letter three times or more.
_SPACED = re.compile(r" [^\W\d_](?: [^\W\d_]){3,}(?= )")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_GAPS = re.compile(r"[\W\d_]+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_OTHER_SCRIPT = re.compile("[\u0370-\u04ff\u0500-\u052f]")


def folded(text: str) -> str:
    """Lower case, look-alikes as Latin letters, digits and signs in words as letters, spaced-out words closed up, drawn-out letters
    once; words single-spaced, with a space at both ends."""
    text = text.lower()
    if _INVISIBLE.search(text):
        text = _INVISIBLE.sub("", text)
    if _OTHER_SCRIPT.search(text):
        text = text.translate(_LOOKALIKES)
    text = _DISGUISED.sub(lambda m: m[0].translate(_DIGITS), text)
    text = f" {_GAPS.sub(' ', text).strip()} "
    return _LONG.sub(r"\1", _SPACED.sub(lambda m: " " + m[0].replace(" ", ""), text))


@dataclass
class Lexicon:
    """terms: folded, with a leading space, and a trailing one where only the whole word counts; phrases: exceptions; curve: logistic weights."""

    terms: dict[str, float]
    phrases: tuple[str, ...]
    curve: tuple[float, float, float]

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for p in self.phrases:
            a.add_word(f" {p} ", (len(p) + 2, None))
        a.make_automaton()
        return a

    def features(self, text: str, automaton) -> tuple[float, float]:
        """(log of 1 + summed weights, summed weights for each of the text's words plus 50).

        Where terms overlap, the one that begins first and then is longest counts. A hit inside an exception phrase does not.
        """
        t = folded(text)
        hits, free = [], []
        for end, (n, w) in automaton.iter(t):
            (free if w is None else hits).append((end - n + 1, end + 1, w))
        total, last = 0.0, -1
        for start, end, w in sorted(hits, key=lambda h: (h[0], -h[1])):
            if start >= last and not any(a <= start and end <= b for a, b, _ in free):
                total += w
                last = end - 1
        return float(np.log1p(total)), total / (t.count(" ") + 50) * 50

    def score(self, x: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * x[0] + self.curve[2] * x[1]
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4 are never learned from."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(4)) == 2


def row_words(sample: DataFrame) -> DataFrame:
    """sample (row, text, toxic) to (row, toxic, word): the distinct folded words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text, y in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                words = sorted(set(folded(text).split()))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(words), pa.int64()), pa.array([y] * len(words), pa.int32()), pa.array(words, pa.string())], ["row", "toxic", "word"])

    return sample.select("row", "text", "toxic").mapInArrow(run, "row long, toxic int, word string")


def row_terms(words: DataFrame) -> DataFrame:
    """words plus `term`: of each word itself with a space on both sides, and its beginnings of four to eight letters with one before."""
    size = F.length("word")
    starts = F.when(size > 4, F.transform(F.sequence(F.lit(4), F.least(size, F.lit(9)) - 1), lambda k: F.concat(F.lit(" "), F.substr("word", F.lit(1), k)))).otherwise(F.array().cast("array<string>"))
    whole = F.when(size > 2, F.array(F.concat(F.lit(" "), "word", F.lit(" ")))).otherwise(F.array().cast("array<string>"))
    return words.withColumn("term", F.explode(F.concat(whole, starts)))


def learn_terms(sample: DataFrame, rows_of: tuple[int, int], least: int = 3, most: int = 400, clean_weight: float = 1.0) -> dict[str, float]:
    """Words, and beginnings of at least four letters with three different endings, that toxic rows have and others hardly.

    A term needs `least` toxic rows, at most half as many clean ones and a log-odds of 2.5. Terms are taken by the number of
    toxic rows that no earlier term covers, less its clean rows twice; then words that no clean row has, by their odds. No more
    than `most` are taken. rows_of: how many rows of the sample are clean and toxic. clean_weight: how many toxic rows of the sample
    a clean one stands beside, where the two were sampled at different rates.
    """
    words = written(row_words(sample))
    tox = row_terms(words.where("toxic = 1"))
    seen = tox.groupBy("term").agg(F.count_distinct("row").alias("n"), F.count_distinct("word").alias("endings")).where((F.col("n") >= least) & (F.col("term").endswith(" ") | (F.col("endings") >= 3)))
    seen = written(seen)
    clean = guarded_join(row_terms(words.where("toxic = 0")), seen.select("term"), ["term"], "left_semi").groupBy("term").agg(F.count_distinct("row").alias("c"))
    odds = F.log((F.col("n") + 0.5) / (rows_of[1] + 1)) - F.log((F.col("c") + 0.5) / (rows_of[0] + 1))
    good = seen.join(clean, "term", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("odds", odds).where((F.col("odds") >= 2.5) & (2 * clean_weight * F.col("c") <= F.col("n")))
    good = written(good.select("term", "n", "c", "odds"))
    known = {r.term: r for r in good.collect()}
    cover = {r.term: set(r.rows) for r in guarded_join(tox, good.select("term"), ["term"], "left_semi").groupBy("term").agg(F.collect_set("row").alias("rows")).collect()}
    gain = lambda t: len(cover[t] - done) - 2 * clean_weight * known[t].c
    done: set[int] = set()
    queue = [(-gain(t), t[-1] == " ", -len(t), t) for t in known]
    heapq.heapify(queue)
    chosen: dict[str, float] = {}
    while queue and len(chosen) < most:
        old, *rest, t = heapq.heappop(queue)
        now = gain(t)
        if now < least:
            continue
        if -old > now:  # earlier terms cover some of its rows
            heapq.heappush(queue, (-now, *rest, t))
            continue
        chosen[t] = known[t].odds
        done |= cover[t]
    strong = {t: r.odds for t, r in known.items() if t not in chosen and t[-1] == " " and r.n >= 2 * least - 1 and not r.c}
    return chosen | dict(sorted(strong.items(), key=lambda x: (-x[1], x[0]))[: max(0, most - len(chosen))])


def learn_phrases(sample: DataFrame, terms: dict[str, float], least: int = 3) -> list[str]:
    """Two-word phrases around a lexicon word that `least` clean rows and no toxic row have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, y in zip(*[b.column(i).to_pylist() for i in range(2)], strict=True):
                ws = folded(text).split()
                met = sorted({f"{x} {z}" for x, z in zip(ws, ws[1:], strict=False) if f" {x} " in terms or f" {z} " in terms})
                yield pa.RecordBatch.from_arrays([pa.array(met, pa.string()), pa.array([y] * len(met), pa.int32())], ["phrase", "toxic"])

    counts = sample.select("text", "toxic").mapInArrow(run, "phrase string, toxic int").groupBy("phrase").agg(F.count("*").alias("n"), F.max("toxic").alias("toxic"))
    return sorted(r.phrase for r in counts.where((F.col("n") >= least) & (F.col("toxic") == 0)).select("phrase").collect())


def fitted_curve(sample: DataFrame, lex: Lexicon, weights: tuple[float, float]) -> tuple[float, float, float]:
    """Logistic weights of the two features by Newton steps with a small ridge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lex.automaton()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                found = [lex.features(t, a) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), *[pa.array(c, pa.float64()) for c in zip(*found, strict=True)]], ["toxic", "a", "b"])

    rows = np.array(sorted(map(tuple, sample.select("text", "toxic").mapInArrow(run, "toxic int, a double, b double").collect())))
    x, y = np.column_stack((np.ones(len(rows)), rows[:, 1:])), rows[:, 0]
    each = np.where(y > 0, weights[1], weights[0])
    each *= len(each) / each.sum()  # the ridge weighs as much as in an unweighted sample
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (each * (y - p)) - 0.05 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def learn(sample: DataFrame, weights: tuple[float, float] = (1.0, 1.0)) -> Lexicon:
    """A lexicon and its curve from rows (row, text, toxic) of a written table. Without rows of both labels: the fixed list under a fixed curve.

    weights: for how many labelled rows a clean and a toxic row of the sample stand, so that the curve and the choice of terms
    see the true ratio of the classes whatever was sampled.
    """
    terms = {f" {w} ": 5.0 for w in INSULTS}
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Lexicon(terms, EXCEPTIONS, (-3.0, 3.0, 0.5))
    terms |= learn_terms(sample, (counts[0], counts[1]), clean_weight=weights[0] / weights[1])
    lex = Lexicon(terms, (*EXCEPTIONS, *learn_phrases(sample, terms)), (0.0, 0.0, 0.0))
    lex.curve = fitted_curve(sample, lex, weights)
    return lex


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_clean: int = 2500) -> tuple[DataFrame, tuple[float, float]]:
    """A bounded sample (row, text, toxic) of labelled, not held-out rows, written: those of at most most_toxic and most_clean ids, in
    order of a hash of the id. With it the weights (clean, toxic): labelled ids of the class over sampled ones.

    The ids are chosen from labels alone; no text comes to the driver. Ids with conflicting labels count as toxic; an id that several
    rows have gives its least text. Null texts are empty.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = written(marks.join(pick(docs, "doc_id"), "doc_id", "left_semi"))
    ids = [(r.doc_id, y) for y, n in ((1, most_toxic), (0, most_clean)) for r in marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    known = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    got = {y: sum(1 for _, z in ids if z == y) for y in (0, 1)}
    weights = tuple(known[y] / got[y] if got[y] else 1.0 for y in (0, 1))
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))
    rows = pick(docs, "doc_id", "text").join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return written(rows.select(F.col("doc_id").alias("row"), "text", "toxic").repartition(8)), weights


def score_texts(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns `keep`, score, predicted) for each row, from its whole text; null text is scored as an empty one. Columns of
    `keep` named score or predicted give way to the new ones. Repeated rows are scored each; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = share.value
        a = lex.automaton()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                scores = [lex.score(lex.features(t or "", a)) for t in part.column(0).to_pylist()]
                cols = [part.column(i) for i in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*b.schema.names[1:], "score", "predicted"])

    names = [n for n in dict.fromkeys([id_col, *keep]) if n not in ("score", "predicted")]
    fields = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(F.col("text").alias("_scored"), *[F.col(f"`{n}`") for n in names]).mapInArrow(run, f"{fields}, score double, predicted int")
