"""The flagship path: texts to candidates, candidates to disjoint spans, spans to pseudonyms, pseudonyms to masked texts and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import masking, spans
from ..sources import writers


def deidentified(docs: DataFrame, terms: list[str] | None = None, enabled: set[str] | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """(doc_id, masked_text, n_spans) of (doc_id, text). terms: own words to mask, whatever their case."""
    rows = masking.analysed(docs, enabled, terms=terms)
    if rejected is None:
        return masking.spliced(rows)
    return masking.masked(docs, masking.pseudonyms(masking.accepted(masking.spans_of(rows).drop("replacement"), rejected)))


def deidentified_segments(segments: DataFrame, enabled: set[str] | None = None, rejected: DataFrame | None = None, key: str = "meeting_id") -> DataFrame:
    """Utterances (key, idx, text) to (doc_id, para, masked_text, n_spans, dropped_cross_para): analysed as one text, masked each, with
    names that agree over the whole of it."""
    texts, paras = masking.joined_paragraphs(segments, key)
    kept = masking.spans_of(masking.analysed(texts, enabled)).drop("replacement")
    if rejected is not None:
        kept = masking.accepted(kept, rejected)
    return masking.masked_paragraphs(texts, paras, kept)


def exported(docs: DataFrame, paras: DataFrame | None = None, suffix: str = "txt", **how) -> DataFrame:
    """De-identified files: txt as (doc_id, content string), the whole text; docx as (doc_id, content binary), paragraph by paragraph.

    paras (doc_id, para, p_start, p_end) are needed for docx. Another suffix is an error.
    """
    if suffix == "txt":
        return deidentified(docs, **how).select("doc_id", F.col("masked_text").alias("content"))
    if suffix != "docx" or paras is None:
        raise ValueError(f"cannot export {suffix}" + ("" if paras is not None else " without paragraphs"))
    kept = masking.spans_of(masking.analysed(docs, how.get("enabled"), terms=how.get("terms"))).drop("replacement")
    if how.get("rejected") is not None:
        kept = masking.accepted(kept, how["rejected"])
    each = masking.masked_paragraphs(docs, paras, kept)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("para", "masked_text"))), lambda x: x.masked_text)
    return writers.as_docx_lists(each.groupBy("doc_id").agg(lines.alias("lines")), "doc_id", "lines")
