"""Typed spans of personal data in texts: rules, term lists, literal proposals, manual spans. Offsets are code points, half-open.

Every detector maps (doc_id, text) to rows (doc_id, span_start, span_end, text, category, source, score, detector_ord, emit_ord).
The test of what stands before and after is applied to matches that were found, never inside the pattern: a greedy match that fails
it is gone, and no shorter one is tried.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ALNUM, find_all, free_after, free_before, luhn_ok, running_lengths

#: The categories with their labels, and which source wins where spans overlap.
LABELS = {
    "person": "Person", "plats": "Plats", "organisation": "Organisation", "tid": "Tid", "handelse": "Händelse", "personnummer": "Personnummer", "epost": "E-post",
    "telefon": "Telefon", "ip_adress": "IP-adress", "url": "Webbadress", "diagnos": "Diagnos", "medicin": "Medicin", "egen": "Egen term", "ovrigt": "Övrigt",
}
PRIORITY = {"manual": 5, "rule": 4, "dictionary": 3, "model": 2, "ai": 1}

#: Patterns of the rule detectors.
PERSONNUMMER = r"[0-9]{6,8}[-+]?[0-9]{4}"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+46|0046|0)[0-9 \-]{6,12}[0-9]"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
URL = r"(?:https?://|www\.)[^\s<>\"'()]+"
ICD10 = r"[A-Z][0-9]{2}(?:\.[0-9]{1,2}[A-Z]?)?"
APARTMENT = r"(?i:\blgh\.?\s*[0-9]{1,4}\b)"
STREET = (
    r"(?:(?:Norra|Södra|Östra|Västra|Gamla|Nya|Lilla|Stora|Övre|Nedre) )?\p{Lu}\p{Ll}*"
    r"(?:gatan|gata|vägen|väg|gränden|gränd|stigen|stig|torget|torg|allén|allé|backen|plan)\s+[0-9]{1,4}(?:\s?[A-Za-z]\b)?"
)
SCHOOL = r"\p{Lu}\p{Ll}+(?:gymnasieskolan|grundskolan|gymnasiet|förskolan|särskolan|friskolan|skolan)s?"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ten(m: Column) -> Column:
    d = digits(m)
    return F.when(F.length(d) == 10, d).when(F.length(d) == 12, F.substr(d, F.lit(3)))


def _dated(m: Column) -> Column:
    ten = _ten(m)
    month, day = F.substr(ten, F.lit(3), F.lit(2)).cast("int"), F.substr(ten, F.lit(5), F.lit(2)).cast("int")
    return F.coalesce(month.between(1, 12) & (day.between(1, 31) | day.between(61, 91)), F.lit(False))


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    category: str
    score: Callable[[Column], Column] | float
    before: str | None = ALNUM
    after: str | None = ALNUM
    test: Callable[[Column], Column] | None = None
    trim: str | None = None


#: In the order in which they are emitted; the order breaks ties between equal spans.
RULES = (
    Rule("personnummer", PERSONNUMMER, "personnummer", lambda m: F.when(luhn_ok(_ten(m)), 1.0).otherwise(0.6), test=_dated),
    Rule("epost", EMAIL, "epost", 1.0, before=None, after=None),
    Rule("telefon", PHONE, "telefon", 0.9, test=lambda m: F.length(digits(m)).between(8, 13)),
    Rule("ip_adress", IPV4, "ip_adress", 0.9, before=r"[\p{IsAlphabetic}\p{N}.]", after=r"[\p{IsAlphabetic}\p{N}.]", test=lambda m: F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)),
    Rule("url", URL, "url", 0.95, before=None, after=None, trim=r"[.,;:!?)\]}\"']+$"),
    Rule("icd10", ICD10, "diagnos", 0.85),
    Rule("lagenhet", APARTMENT, "plats", 0.9, before=None, after=None),
    Rule("gatuadress", STREET, "plats", 0.85, after=None),
    Rule("skolnamn", SCHOOL, "plats", 0.8),
)
COLUMNS = ("doc_id", "span_start", "span_end", "text", "category", "source", "score", "detector_ord", "emit_ord")
MODEL_ORD, RULE_ORD, TERM_ORD, AI_ORD = 0, 1, 20, 40


_ROW = "struct<span_start:int,span_end:int,text:string,category:string,source:string,score:float,detector_ord:int,emit_ord:int>"


def rule_array(whole: Column, rule: Rule) -> Column:
    """One rule's spans in a text, as an array; empty for texts that cannot match, before any offset is worked out."""
    ord_ = RULE_ORD + RULES.index(rule) if rule in RULES else TERM_ORD

    def row(m: Column, i: Column) -> Column:
        hit = F.regexp_replace(m["text"], rule.trim, "") if rule.trim else m["text"]
        score = F.lit(rule.score) if isinstance(rule.score, float) else rule.score(hit)
        return F.struct(
            m["start"].alias("span_start"), (m["start"] + F.length(hit)).cast("int").alias("span_end"), hit.alias("text"), F.lit(rule.category).alias("category"), F.lit("rule").alias("source"),
            score.cast("float").alias("score"), F.lit(ord_).alias("detector_ord"), i.cast("int").alias("emit_ord"),
        )

    def ok(r: Column) -> Column:
        out = F.length(r["text"]) > 0
        if rule.before:
            out = out & free_before(whole, r["span_start"], rule.before)
        if rule.after:
            out = out & free_after(whole, r["span_end"], rule.after)
        return out & rule.test(r["text"]) if rule.test else out

    found = F.filter(F.transform(find_all(whole, rule.pattern), row), ok)
    return F.coalesce(F.when(whole.rlike(rule.pattern), found.cast(f"array<{_ROW}>")), F.array().cast(f"array<{_ROW}>"))


def rule_spans(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """One rule over (doc_id, text); null texts give no spans."""
    return docs.where(F.col(text).rlike(rule.pattern)).select("doc_id", F.inline(rule_array(F.col(text), rule)))


def all_rules(docs: DataFrame, enabled: set[str] | None = None, text: str = "text") -> DataFrame:
    """All rules in their order, in one pass over the texts. A rule of a category that is not enabled is not in the plan."""
    used = [r for r in RULES if enabled is None or r.category in enabled]
    if not used:
        return rule_spans(docs, RULES[0], text).limit(0)
    return docs.select("doc_id", F.inline(F.concat(*[rule_array(F.col(text), r) for r in used])))


def quoted(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def term_spans(docs: DataFrame, terms: list[str], category: str, ignore_case: bool, score: float = 1.0, ord_: int = TERM_ORD, text: str = "text") -> DataFrame:
    """Whole-word occurrences of listed terms, leftmost and longest first, ASCII case folding only.

    One alternation of all terms by falling length; a longest match that fails the word test is consumed, its beginnings are not
    tried. Blank terms are dropped; without terms there are no rows. Meant for lists of up to some thousand short terms.
    """
    listed = sorted({t.strip() for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    pattern = "(?:" + "|".join(map(quoted, listed)) + ")" if listed else "(?!)"
    if ignore_case:
        pattern = f"(?i:{pattern})"
    return rule_spans(docs, Rule("terms", pattern, category, float(score)), text).withColumns({"source": F.lit("dictionary"), "detector_ord": F.lit(ord_)}) if listed else rule_spans(docs, RULES[0], text).limit(0)


def token_term_spans(docs: DataFrame, terms: DataFrame, category: str, score: float, ord_: int = TERM_ORD, max_terms: int = 500_000) -> DataFrame:
    """Long lists of case-sensitive terms (term), of one word or several: one pass over each text with an automaton of all terms.

    As term_spans: leftmost and longest first, and a longest match that fails the word test is consumed. More than max_terms are an
    error, for every task holds the automaton; the list is counted first.
    """
    listed = terms.select(F.trim("term").alias("term")).where("term <> ''").distinct()
    if listed.limit(max_terms + 1).count() > max_terms:
        raise ValueError(f"more than {max_terms} terms: split the list")
    return matched_spans(docs, [("terms", category, False, float(score), ord_, [r.term for r in listed.collect()])])


@dataclass(frozen=True)
class TermList:
    """A list of murmurlake/data; ASCII case counts unless ignore_case."""

    name: str
    category: str
    ignore_case: bool = False
    score: float = 1.0
    ord_: int = TERM_ORD

    def terms(self) -> list[str]:
        lines = (Path(__file__).parents[1] / "data" / f"{self.name}.txt").read_text("utf-8").splitlines()
        return sorted({x.strip() for x in lines if x.strip() and not x.strip().startswith("#")})


#: In the order in which they are emitted. The list of school names is not at hand.
TERM_LISTS = (
    TermList("diagnoser", "diagnos", ignore_case=True), TermList("diagnoser_akronymer", "diagnos"), TermList("mediciner", "medicin", ignore_case=True, ord_=21),
    TermList("fornamn", "person", score=0.5, ord_=22), TermList("efternamn", "person", score=0.5, ord_=22), TermList("kommuner", "plats", ord_=23), TermList("ortnamn", "plats", ord_=23),
)


class TermMatcher:
    """Whole-word occurrences of listed terms in a text: leftmost and longest first within a list, each range of a category once.

    lists: (name, category, ASCII case folded, score, detector order, terms). A longest match that fails the word test is consumed;
    its beginnings are not tried. All lists share two automata, one over the text and one over its ASCII-lower-cased form.
    """

    def __init__(self, lists: list[tuple]):
        import ahocorasick
        import regex

        self.lists, self.word = lists, regex.compile(r"[\p{Alphabetic}\p{N}]")
        self.automata = []
        for fold in (False, True):
            owners: dict[str, list[int]] = {}
            for i, (_, _, folded, _, _, terms) in enumerate(lists):
                if folded == fold:
                    for t in {self.lower(x.strip()) if fold else x.strip() for x in terms if x.strip()}:
                        owners.setdefault(t, []).append(i)
            automaton = ahocorasick.Automaton()
            for t, own in owners.items():
                automaton.add_word(t, (len(t), own))
            if owners:
                automaton.make_automaton()
            self.automata.append((fold, automaton if owners else None))

    @staticmethod
    def lower(text: str) -> str:
        return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")

    def free(self, text: str, start: int, end: int) -> bool:
        return not (start and self.word.match(text[start - 1])) and not (end < len(text) and self.word.match(text[end]))

    def spans(self, text: str) -> list[tuple[int, int, str, str, float, int, int]]:
        """(start, end, text, category, score, detector order, order of emission) in order of detectors and starts."""
        met: dict[int, list[tuple[int, int]]] = {}
        for fold, automaton in self.automata:
            if automaton is not None:
                for last, (n, own) in automaton.iter(self.lower(text) if fold else text):
                    for i in own:
                        met.setdefault(i, []).append((last + 1 - n, -last - 1))
        out, seen = [], set()
        for i in sorted(met, key=lambda i: (self.lists[i][4], i)):
            _, category, _, score, ord_, _ = self.lists[i]
            at = 0
            for nth, (start, end) in enumerate(sorted(met[i])):
                if start < at:
                    continue
                at = -end
                if self.free(text, start, at) and (start, at, category) not in seen:
                    seen.add((start, at, category))
                    out.append((start, at, text[start:at], category, score, ord_, nth))
        return out


def listed_terms(lists: tuple[TermList, ...] = TERM_LISTS) -> list[tuple]:
    return [(x.name, x.category, x.ignore_case, float(x.score), x.ord_, x.terms()) for x in lists]


def matched_spans(docs: DataFrame, lists: list[tuple]) -> DataFrame:
    """Spans of TermMatcher over (doc_id, text): one pass, nothing is shuffled. Null texts give no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = TermMatcher(lists)
        for b in batches:
            row, found = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                got = matcher.spans(text) if text else []
                row += [i] * len(got)
                found += got
            if found:
                start, end, text, category, score, ord_, nth = zip(*found, strict=True)
                source = ["dictionary"] * len(found)
                cols = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text), pa.array(category), pa.array(source), pa.array(score, pa.float32()), pa.array(ord_, pa.int32()), pa.array(nth, pa.int32())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *cols], list(COLUMNS))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + _ROW[7:-1].replace(":", " ").replace(",", ", "))


def listed_spans(docs: DataFrame, lists: tuple[TermList, ...] = TERM_LISTS) -> DataFrame:
    """Whole-word occurrences of all terms of the lists, leftmost and longest first within a list; one range of a category once."""
    return matched_spans(docs, listed_terms(lists))


def same_range_once(spans: DataFrame) -> DataFrame:
    """Of spans with one range the first by detector and emission."""
    w = Window.partitionBy("doc_id", "span_start", "span_end").orderBy("detector_ord", "emit_ord")
    return spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def literal_spans(docs: DataFrame, proposals: DataFrame) -> DataFrame:
    """proposals (doc_id, proposal): each literal occurrence of a proposal of two letters or more, without a word test."""
    p = proposals.select("doc_id", F.trim("proposal").alias("needle")).where(F.length("needle") >= 2)
    rows = docs.join(p, "doc_id").select("doc_id", "needle", F.split("text", F.concat(F.lit("\\Q"), F.col("needle"), F.lit("\\E")), -1).alias("parts"))
    rows = rows.where(F.size("parts") > 1).select("doc_id", "needle", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("i"))
    before = F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0), lambda s, x: s + F.length(x)) + (F.col("i") - 1) * F.length("needle")
    return rows.select(
        "doc_id", before.alias("span_start"), (before + F.length("needle")).alias("span_end"), F.col("needle").alias("text"), F.lit("ovrigt").alias("category"),
        F.lit("ai").alias("source"), F.lit(0.7).cast("float").alias("score"), F.lit(AI_ORD).alias("detector_ord"), (F.col("i") - 1).alias("emit_ord"),
    )


def manual_spans(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (doc_id, span_start, span_end, category, custom) with the text that they stand for; a range that is empty or reaches
    outside its text is an error, a blank custom replacement is none."""
    rows = marks.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    ok = (F.col("span_start") >= 0) & (F.col("span_start") < F.col("span_end")) & (F.col("span_end") <= F.length("whole"))
    surface = F.substr("whole", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    text = F.when(F.coalesce(ok, F.lit(False)), surface).otherwise(F.raise_error(F.concat(F.lit("no such range in document "), F.col("doc_id").cast("string"))))
    return rows.select("doc_id", "span_start", "span_end", text.alias("text"), "category", F.when(F.trim("custom") != "", F.col("custom")).alias("custom"))


def with_manual(spans: DataFrame, manual: DataFrame) -> DataFrame:
    """manual (doc_id, span_start, span_end, text, category): each replaces all spans that it overlaps."""
    m = manual.select("doc_id", F.col("span_start").alias("ms"), F.col("span_end").alias("me"))
    hit = (spans["doc_id"] == m["doc_id"]) & (spans["span_start"] < m["me"]) & (m["ms"] < spans["span_end"])
    rest = spans.join(m, hit, "left_anti")
    new = manual.withColumns({"source": F.lit("manual"), "score": F.lit(1.0).cast("float"), "detector_ord": F.lit(99), "emit_ord": F.lit(0)})
    more = ["custom"] if "custom" in manual.columns else []
    return rest.select(*COLUMNS).unionByName(new.select(*COLUMNS, *more), allowMissingColumns=True)


def model_label(raw: Column) -> Column:
    """A tagger's label as a category; null for labels that name nobody and nothing."""
    return (
        F.when((raw == "PER") | raw.contains("PRS"), "person").when(raw.contains("LOC"), "plats").when(raw.contains("ORG"), "organisation").when(raw.contains("TME"), "tid").when(raw.contains("EVN"), "handelse")
    )


def joined_token_spans(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """tags (doc_id, ord, category, s, e): tokens widened to whole words and joined to the span before if category is the same
    and only white space and hyphens, or nothing, lies between."""
    t = F.col("whole")
    wide = tags.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    head = F.length(F.regexp_extract(F.substr(t, F.lit(1), F.col("s")), ALNUM + r"*\z", 0))
    tail = F.length(F.regexp_extract(F.substr(t, F.col("e") + 1), "^" + ALNUM + "*", 0))
    wide = wide.withColumns({"s": F.col("s") - head, "e": F.col("e") + tail})
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("e").over(before)
    gap = F.when(F.col("s") > reach, F.substr(t, reach + 1, F.col("s") - reach)).otherwise("")
    join = (F.lag("category").over(w) == F.col("category")) & (F.col("s") >= F.lag("s").over(w)) & gap.rlike(r"^[\s\-]*$")
    wide = wide.withColumn("new", F.when(F.coalesce(join, F.lit(False)), 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    out = wide.groupBy("doc_id", "g", "category").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end"), F.first("whole").alias("whole"))
    return out.select("doc_id", "span_start", "span_end", F.substr("whole", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")).alias("text"), "category")


def capital_stub(tokens: list[str]) -> list[list[float]]:
    """Stands for a tagger where no weights are at hand: logits of (O, PER) for the two marks at the ends and each token between."""
    return [[1.0, 0.0], *[[0.0, 1.0] if t[:1].isupper() else [1.0, 0.0] for t in tokens], [1.0, 0.0]]


def token_tags(docs: DataFrame, logits: Callable[[list[str]], list[list[float]]] = capital_stub, labels: tuple[str, ...] = ("O", "PER"), window: int = 510, token: str = r"[^\W_]+|[^\w\s]|_") -> DataFrame:
    """(doc_id, ord, category, s, e) from a tagger: tokens in windows of `window` without overlap, in each the label of the greatest
    logit at each position, the first on ties; the window's two end marks, tokens without length and labels of no category go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, ords, label, s, e = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                met = list(re.finditer(token, text or ""))
                for lo in range(0, len(met), window):
                    part = met[lo : lo + window]
                    scores = logits([m[0] for m in part])[1:-1]
                    for nth, (m, x) in enumerate(zip(part, scores, strict=True), lo):
                        if m.end() > m.start():
                            row.append(i)
                            ords.append(nth)
                            label.append(labels[x.index(max(x))])
                            s.append(m.start())
                            e.append(m.end())
            cols = [pa.array(ords, pa.int32()), pa.array(label, pa.string()), pa.array(s, pa.int32()), pa.array(e, pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *cols], ["doc_id", "ord", "label", "s", "e"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    tags = docs.where(F.trim("text") != "").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ord int, label string, s int, e int")
    return tags.withColumn("category", model_label(F.col("label"))).where("category IS NOT NULL").select("doc_id", "ord", "category", "s", "e")


def model_spans(docs: DataFrame, **tagger) -> DataFrame:
    """token_tags joined to spans, as candidates."""
    found = joined_token_spans(docs, token_tags(docs, **tagger))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("span_start", "span_end"))
    return found.withColumns({"source": F.lit("model"), "score": F.lit(1.0).cast("float"), "detector_ord": F.lit(MODEL_ORD), "emit_ord": order}).select(*COLUMNS)


#: The categories that only a tagger finds or can find.
MODEL_CATEGORIES = ("person", "plats", "organisation", "tid", "handelse")


def candidates(docs: DataFrame, enabled: set[str] | None = None, lists: tuple[TermList, ...] = TERM_LISTS, terms: list[str] | None = None, tagger: dict | None = None, proposals: DataFrame | None = None, use_ai: bool = False) -> DataFrame:
    """All candidate spans. Rules and lists always run; the tagger does if one is given and one of its categories is enabled;
    language-model proposals count only with use_ai, and then must be given."""
    found = all_rules(docs, enabled).unionByName(listed_spans(docs, lists))
    if terms:
        found = found.unionByName(term_spans(docs, terms, "egen", ignore_case=True, ord_=30))
    if tagger is not None and (enabled is None or enabled & set(MODEL_CATEGORIES)):
        found = found.unionByName(model_spans(docs, **tagger))
    if use_ai:
        if proposals is None:
            raise ValueError("use_ai needs proposals: no model is at hand")
        found = found.unionByName(literal_spans(docs, proposals))
    return found


def salvaged_strings(raw: Column) -> Column:
    """Strings of the JSON list inside a model's answer; of a broken list the quoted literals of two letters or more."""
    inner = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    listed = F.coalesce(F.from_json(inner, "array<string>"), F.transform(F.from_json(inner, "array<struct<text:string>>"), lambda x: x["text"]))
    loose = F.transform(F.regexp_extract_all(F.regexp_extract(raw, r"(?s)\[.*", 0), F.lit(r'"((?:[^"\\]|\\.)*)"')), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r'\\"', '"'), r"\\\\", r"\\")))
    return F.filter(F.coalesce(F.when(inner != "", listed), loose), lambda x: F.length(F.trim(x)) >= 2)


def proposals_of(answers: DataFrame, most: int = 80) -> DataFrame:
    """(doc_id, raw) to (doc_id, proposal): first spelling of each, by position, at most `most` for a text (a feature)."""
    rows = answers.select("doc_id", F.posexplode(salvaged_strings(F.col("raw"))).alias("i", "proposal"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", F.lower("proposal")).orderBy("i"))).where("n = 1")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))).where(F.col("k") <= most).select("doc_id", "proposal")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELS.items()), "category string, label string")
