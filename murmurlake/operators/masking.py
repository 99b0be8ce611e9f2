"""From candidate spans to masked text: conflicts, pseudonyms, splicing, render segments."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_form
from .spans import LABELS, PRIORITY, RULES, TERM_LISTS, TermList, TermMatcher, listed_terms, rule_array



def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def resolve(spans: DataFrame, enabled: set[str] | None = None) -> DataFrame:
    """Spans without overlaps, per document: by source priority, then length in bytes, then start, then order of detection, each
    span is kept that overlaps no kept one. A loser's loser may be kept. Touching spans do not overlap. Scores play no part.

    A document's candidates are one array; each is tested against its two neighbours among those kept.
    """
    rows = spans.where(F.col("span_end") > F.col("span_start"))
    if enabled is not None:
        rows = rows.where(F.col("category").isin(*enabled))
    each = rows.groupBy("doc_id").agg(F.collect_list(F.struct("span_start", "span_end", "text", "category", "source", F.col("score").cast("float").alias("score"), "detector_ord", "emit_ord")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for i, found in enumerate(b.column(1).to_pylist()):
                kept = without_overlaps(found)
                row += [i] * len(kept)
                out += [(nth, *[x[c] for c in ("span_start", "span_end", "text", "category", "source", "score")]) for nth, x in enumerate(kept)]
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float32()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *cols], ["doc_id", "span_id", "span_start", "span_end", "text", "category", "source", "score"])

    kind = spans.schema["doc_id"].dataType.simpleString()
    return each.mapInArrow(run, f"doc_id {kind}, span_id int, span_start int, span_end int, text string, category string, source string, score float")


KEPT = "array<struct<span_id:int,span_start:int,span_end:int,text:string,category:string,source:string,score:float,replacement:string>>"
_KEPT = pa.list_(pa.struct([("span_id", pa.int32()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("text", pa.string()), ("category", pa.string()), ("source", pa.string()), ("score", pa.float32()), ("replacement", pa.string())]))


def without_overlaps(found: list[dict]) -> list[dict]:
    """resolve() for the candidates of one document, by start: kept spans are held in order, so each is tested against two."""
    key = lambda x: (-PRIORITY[x["source"]], -len(x["text"].encode("utf-8", "surrogatepass")), x["span_start"], x["detector_ord"], x["emit_ord"])
    starts: list[int] = []
    kept: list[dict] = []
    for x in sorted(found, key=key):
        at = bisect.bisect_left(starts, x["span_start"])
        if x["span_end"] > x["span_start"] and not (at and kept[at - 1]["span_end"] > x["span_start"]) and not (at < len(kept) and starts[at] < x["span_end"]):
            starts.insert(at, x["span_start"])
            kept.insert(at, x)
    return kept


def numbered(kept: list[dict]) -> list[dict]:
    """pseudonyms() for one document's disjoint spans in order, without custom replacements."""
    names: dict[tuple[str, str], str] = {}
    used: dict[str, int] = {}
    out = []
    for i, x in enumerate(kept):
        form = (x["category"], re.sub(r"\s+", " ", x["text"]).strip(" ").lower())
        if form not in names:
            used[form[0]] = used.get(form[0], 0) + 1
            names[form] = f"{LABELS[form[0]]} {used[form[0]]}"
        out.append({**{k: x[k] for k in ("span_start", "span_end", "text", "category", "source", "score")}, "span_id": i, "replacement": names[form]})
    return out


def analysed(docs: DataFrame, enabled: set[str] | None = None, lists: tuple[TermList, ...] = TERM_LISTS, terms: list[str] | None = None) -> DataFrame:
    """(doc_id, text, spans) of (doc_id, text): rules, lists and own terms, resolved and numbered within the row, by one pass.

    Neither a text nor a span leaves its row, so nothing is shuffled. Candidates are those of spans.candidates, the result is that of
    resolve and pseudonyms. Null texts have no spans.
    """
    used = [r for r in RULES if enabled is None or r.category in enabled]
    known = listed_terms(lists) + ([("own", "egen", True, 1.0, 30, list(terms))] if terms else [])
    found = F.concat(*[rule_array(F.col("text"), r) for r in used]) if used else rule_array(F.lit(None).cast("string"), RULES[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, names = TermMatcher(known), ("span_start", "span_end", "text", "category", "score", "detector_ord", "emit_ord")
        for b in batches:
            out = []
            for text, rules in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                listed = [{**dict(zip(names, x, strict=True)), "source": "dictionary"} for x in (matcher.spans(text) if text else [])]
                every = [x for x in [*(rules or []), *listed] if enabled is None or x["category"] in enabled]
                out.append(numbered(without_overlaps(every)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, _KEPT)], ["doc_id", "text", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", found.alias("found")).mapInArrow(run, f"doc_id {kind}, text string, spans {KEPT}")


def spans_of(rows: DataFrame) -> DataFrame:
    """analysed() rows to one row for each span."""
    return rows.select("doc_id", F.inline("spans"))


def spliced(rows: DataFrame) -> DataFrame:
    """analysed() rows to (doc_id, masked_text, n_spans)."""
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["span_end"])
    piece = lambda x, i: F.concat(F.substr("text", before(i) + 1, x["span_start"] - before(i)), x["replacement"])
    tail = F.substr("text", F.coalesce(F.get("spans", F.size("spans") - 1)["span_end"], F.lit(0)) + 1)
    return rows.select("doc_id", F.concat(F.array_join(F.transform("spans", piece), ""), tail).alias("masked_text"), F.size("spans").alias("n_spans"))


def audit(docs: DataFrame, replaced: DataFrame) -> DataFrame:
    """What was replaced by what: (doc_id, span_start, span_end, original, replacement, category, source, score), one row for each splice."""
    return replaced.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "span_start", "span_end", F.col("text").alias("original"), "replacement", "category", "source", "score")


def pseudonyms(resolved: DataFrame) -> DataFrame:
    """resolved plus `replacement`: the category's label and a number by first appearance; equal forms share it.

    A non-blank `custom` column replaces the label and takes no number.
    """
    custom = F.nullif(F.trim("custom"), F.lit("")) if "custom" in resolved.columns else F.lit(None).cast("string")
    df = resolved.withColumn("_c", custom).withColumn("_norm", normal_form(F.col("text")))
    df = df.withColumn("_first", F.when(F.col("_c").isNull(), F.min(F.when(F.col("_c").isNull(), F.col("span_start"))).over(Window.partitionBy("doc_id", "category", "_norm"))))
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "category").orderBy(F.col("_first").asc_nulls_last()))
    return df.withColumn("replacement", F.coalesce("_c", F.concat_ws(" ", _lookup(LABELS, F.col("category")), rank.cast("string")))).drop("_c", "_norm", "_first")


def masked(docs: DataFrame, replaced: DataFrame) -> DataFrame:
    """(doc_id, masked_text, n_spans) for every document: replacements spliced in by start."""
    piece = F.struct(F.col("span_start").alias("s"), F.col("span_end").alias("e"), F.col("replacement").alias("r"))
    each = replaced.groupBy("doc_id").agg(F.array_sort(F.collect_list(piece)).alias("ps"))
    t = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, p: F.when(p["s"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substr(t, a["at"] + 1, p["s"] - a["at"]), p["r"]).alias("out"), p["e"].alias("at")))
    text = F.aggregate("ps", start, step, lambda a: F.concat(a["out"], F.substr(t, a["at"] + 1)))
    return docs.join(each, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("ps").isNotNull(), text), t).alias("masked_text"), F.coalesce(F.size("ps"), F.lit(0)).alias("n_spans"))


def in_paragraphs(spans: DataFrame, paras: DataFrame) -> DataFrame:
    """spans plus (para, p_start, p_end) of the paragraph that holds them whole, null for none: the last paragraph that begins at or
    before a span is found by merging both sides into one ordered stream per document."""
    marks = paras.select("doc_id", F.col("p_start").alias("span_start"), F.lit(0).alias("_kind"), F.struct("para", "p_start", "p_end").alias("_mark"))
    both = spans.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("span_start", "_kind", "_mark.para").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_mark", F.last("_mark", ignorenulls=True).over(w)).where("_kind = 1")
    inside = F.col("span_end") <= F.col("_mark.p_end")
    return rows.select(*spans.columns, *[F.when(inside, F.col(f"_mark.{c}")).alias(c) for c in ("para", "p_start", "p_end")])


def masked_paragraphs(docs: DataFrame, paras: DataFrame, spans: DataFrame) -> DataFrame:
    """paras (doc_id, para, p_start, p_end): each paragraph with the spans that lie inside it, numbered over the document.

    A span across two paragraphs is left unmasked in both, takes no number and is counted in dropped_cross_para.
    """
    placed = in_paragraphs(spans, paras)
    named = pseudonyms(placed.where("para IS NOT NULL"))
    local = named.select("doc_id", "para", (F.col("span_start") - F.col("p_start")).alias("span_start"), (F.col("span_end") - F.col("p_start")).alias("span_end"), "replacement")
    texts = docs.join(paras, "doc_id").select(F.struct("doc_id", "para").alias("doc_id"), F.substr("text", F.col("p_start") + 1, F.col("p_end") - F.col("p_start")).alias("text"))
    out = masked(texts, local.withColumn("doc_id", F.struct("doc_id", "para"))).select("doc_id.doc_id", "doc_id.para", "masked_text", "n_spans")
    lost = placed.where("para IS NULL").groupBy("doc_id").agg(F.count("*").alias("dropped_cross_para"))
    return out.join(lost, "doc_id", "left").fillna(0, ["dropped_cross_para"])


def joined_paragraphs(segments: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Segments (key, idx, text) of each document as one text, joined by line ends with none at the end, and the paragraphs
    (doc_id, para, p_start, p_end) that they are in it; null texts are empty."""
    body = F.coalesce(F.col("text"), F.lit(""))
    w = Window.partitionBy(key).orderBy("idx")
    end = F.sum(F.length(body) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    paras = segments.select(F.col(key).alias("doc_id"), (F.row_number().over(w) - 1).alias("para"), (end - F.length(body)).cast("int").alias("p_start"), end.cast("int").alias("p_end"))
    texts = segments.groupBy(F.col(key).alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", body.alias("b")))), lambda x: x.b), "\n").alias("text"))
    return texts, paras


def active(spans: DataFrame, enabled: set[str], rejected: DataFrame | None = None) -> DataFrame:
    """Spans that apply: manual ones and those of enabled categories, without the (doc_id, span_id) rejected."""
    rows = spans.where((F.col("source") == "manual") | F.col("category").isin(*enabled))
    return rows if rejected is None else accepted(rows, rejected)


def category_counts(spans: DataFrame) -> DataFrame:
    """(category, n) over all documents."""
    return spans.groupBy("category").agg(F.count("*").alias("n"))


def paragraph_speakers(paras: DataFrame, utterances: DataFrame, labels: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """paras (key, para) plus `speaker`: the label, else the name, of the utterance with that index; null for none."""
    rows = utterances.select(key, F.col("idx").alias("para"), F.col("speaker"))
    if labels is not None:
        rows = rows.join(labels.select(key, "speaker", "label"), [key, "speaker"], "left").withColumn("speaker", F.coalesce("label", "speaker")).drop("label")
    return paras.join(rows, [key, "para"], "left")


def accepted(resolved: DataFrame, rejected: DataFrame) -> DataFrame:
    """resolved without the (doc_id, span_id) that a reviewer rejected."""
    return resolved.join(rejected, ["doc_id", "span_id"], "left_anti")


def counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("doc_id", _lookup(LABELS, F.col("category")).alias("label")).agg(F.count("*").alias("n"))


#: White space of any script, as a class.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def render_segments(rows: DataFrame) -> DataFrame:
    """analysed() rows, or rows (doc_id, text, spans) like them, to (doc_id, seg_start, seg_end, text, span_id, word): spans and, between
    them, alternating words and white space. A row is rendered in itself."""
    names = ["doc_id", "seg_start", "seg_end", "text", "span_id", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = re.compile(f"([{_SPACES}]+)|[^{_SPACES}]+")
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                row, start, end, texts, ids, word = [], [], [], [], [], []
                for i, (text, spans) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    at, before = 0, len(row)
                    for x in [*spans, None]:
                        stop = len(text) if x is None else x["span_start"]
                        for m in piece.finditer(text, at, stop):
                            start.append(m.start())
                            end.append(m.end())
                            texts.append(m[0])
                            ids.append(None)
                            word.append(m[1] is None)
                        if x is not None:
                            at = x["span_end"]
                            start.append(x["span_start"])
                            end.append(at)
                            texts.append(x["text"])
                            ids.append(x["span_id"])
                            word.append(True)
                    row += [i] * (len(start) - before)
                cols = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(texts, pa.string()), pa.array(ids, pa.int32()), pa.array(word, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *cols], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.where("text IS NOT NULL").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, seg_start int, seg_end int, text string, span_id int, word boolean")


def segment_paragraphs(segments: DataFrame, paras: DataFrame) -> DataFrame:
    """segments plus `para`, the last paragraph that begins at or before them, 0 if none: a backward as-of join by merging both
    sides into one ordered stream per document."""
    marks = paras.select("doc_id", F.col("p_start").alias("seg_start"), F.lit(0).alias("kind"), F.col("para").alias("mark"))
    both = segments.withColumns({"kind": F.lit(1), "mark": F.lit(None).cast("int")}).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("seg_start", "kind", F.col("mark").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("para", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(0))).where("kind = 1").drop("kind", "mark")
