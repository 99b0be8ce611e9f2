"""The registry of queries over the driver's tables and their SQL equivalents.

What tables stand for is told in catalog_base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog_base import TODAY, actions, job_rows, recordings, signals, table, turns, utterances
from .functions import signal
from .functions import text as tx
from .operators import align, chunking, gazetteer, jobs, masking, spans, transcript
from .plans import deidentify
from .samples import SENTENCES
from .streaming import live

NAMES = ["Stein", "Leon", "Chen", "Sten", "Anna", "Erik", "Ann", "Ann-Britt", "Anna Berg"]

def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and the sample sentences under negative ids."""
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(SENTENCES)], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(rows)


def _rule(name: str) -> Callable[[SparkSession, str], DataFrame]:
    rule = next(r for r in spans.RULES if r.name == name)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")) if name == "url" else texts(spark, sf_dir)
        found = spans.rule_spans(docs, rule)
        return found.select("doc_id", "span_start", "span_end", "text", F.round(F.col("score").cast("double"), 2).alias("score"))

    return query


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.analysed(texts(spark, sf_dir))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.spans_of(_analysed(spark, sf_dir)).drop("replacement")


def pii_name_spans(spark, sf_dir):
    found = spans.term_spans(texts(spark, sf_dir), NAMES, "person", ignore_case=False, score=0.5)
    return spans.same_range_once(found).select("doc_id", "span_start", "span_end", "text")


def pii_name_spans_by_token(spark, sf_dir):
    terms = spark.createDataFrame([(n,) for n in NAMES], "term string")
    return spans.token_term_spans(texts(spark, sf_dir), terms, "person", 0.5).select("doc_id", "span_start", "span_end", "text")


def _listed(category: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lists = tuple(x for x in spans.TERM_LISTS if x.category == category)
        return spans.listed_spans(texts(spark, sf_dir), lists).select("doc_id", "span_start", "span_end", "text", F.col("score").cast("double").alias("score"))

    return query


def pii_candidates(spark, sf_dir):
    """How many candidates each detector gives, before any conflict is settled."""
    return spans.candidates(texts(spark, sf_dir)).groupBy("category", "source").agg(F.count("*").alias("n"), F.sum("span_start").alias("starts"))


def pii_resolved(spark, sf_dir):
    return _kept(spark, sf_dir).select("doc_id", "span_id", "span_start", "span_end", "text", "category", "source")


def pii_resolved_by_shuffle(spark, sf_dir):
    """The same from spans of any origin, which come as rows."""
    return masking.resolve(spans.candidates(texts(spark, sf_dir))).select("doc_id", "span_id", "span_start", "span_end", "text", "category", "source")


def pii_counts(spark, sf_dir):
    return masking.counts(_kept(spark, sf_dir))


def pii_category_counts(spark, sf_dir):
    return masking.category_counts(_kept(spark, sf_dir))


def pii_active(spark, sf_dir):
    """Spans of two categories, the first of each document rejected."""
    kept = _kept(spark, sf_dir)
    return masking.active(kept, {"person", "epost"}, kept.where("span_id = 0")).select("doc_id", "span_id", "category")


def pii_pseudonyms(spark, sf_dir):
    return masking.spans_of(_analysed(spark, sf_dir)).select("doc_id", "span_id", "text", "replacement")


def pii_audit(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return masking.audit(docs, masking.spans_of(masking.analysed(docs))).select("doc_id", "span_start", "span_end", "original", "replacement", "category", "source")


def pii_masked_text(spark, sf_dir):
    return masking.spliced(_analysed(spark, sf_dir))


def pii_masked_mail_ip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans.all_rules(docs, {"epost", "ip_adress"})
    return masking.masked(docs, masking.pseudonyms(masking.resolve(found)))


def pii_render_segments(spark, sf_dir):
    return masking.render_segments(_analysed(spark, sf_dir))


def _paras(docs: DataFrame) -> DataFrame:
    lines = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(tx.find_all(F.col("text"), r"[^\n]+")).alias("para", "m"))
    return lines.select("doc_id", "para", F.col("m.start").alias("p_start"), F.col("m.end").alias("p_end"))


def pii_paragraph_masked(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return masking.masked_paragraphs(docs, _paras(docs), _kept(spark, sf_dir))


def pii_segments_masked(spark, sf_dir):
    """Utterances, analysed as one text for each meeting."""
    return deidentify.deidentified_segments(utterances(spark, sf_dir).select("meeting_id", "idx", "text")).select("doc_id", F.col("para").cast("int").alias("para"), "masked_text", "n_spans")


def pii_manual_mask(spark, sf_dir):
    docs = texts(spark, sf_dir)
    marks = docs.where("text IS NOT NULL AND length(text) >= 12").select("doc_id", F.lit(4).alias("span_start"), F.lit(12).alias("span_end"), F.lit("egen").alias("category"), F.lit(" ").alias("custom"))
    found = spans.with_manual(_kept(spark, sf_dir).withColumns({"detector_ord": F.lit(0), "emit_ord": F.col("span_id")}), spans.manual_spans(docs, marks).drop("custom"))
    return masking.resolve(found).select("doc_id", "span_id", "span_start", "span_end", "category", "source")


def pii_rejected_filter(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    return masking.pseudonyms(masking.accepted(kept, kept.where("span_id = 0"))).select("doc_id", "span_id", "replacement")


def transcript_text(spark, sf_dir):
    return transcript.as_text(utterances(spark, sf_dir))


def transcript_timed(spark, sf_dir):
    return transcript.as_timed_text(utterances(spark, sf_dir))


def transcript_srt(spark, sf_dir):
    return transcript.as_srt(utterances(spark, sf_dir))


def transcript_vtt(spark, sf_dir):
    return transcript.as_vtt(utterances(spark, sf_dir))


def transcript_speaker_groups(spark, sf_dir):
    return align.speaker_groups(utterances(spark, sf_dir)).select("meeting_id", "idx", "speaker", F.col("grp").cast("long").alias("grp"))


def speakers_in_order(spark, sf_dir):
    return align.speakers(utterances(spark, sf_dir)).select("meeting_id", F.col("ord").cast("long").alias("ord"), "speaker")


def align_dominant_speaker(spark, sf_dir):
    rows = utterances(spark, sf_dir).select("meeting_id", "idx", "start", "end")
    return align.dominant_speaker(rows, turns(spark, sf_dir)).select("meeting_id", "idx", "cluster")


def align_relabel(spark, sf_dir):
    rows = utterances(spark, sf_dir).select("meeting_id", "idx", "start", "end")
    return align.numbered_speakers(align.dominant_speaker(rows, turns(spark, sf_dir))).select("meeting_id", "idx", "speaker")


def _two_sources(spark, sf_dir) -> DataFrame:
    rows = utterances(spark, sf_dir).select("meeting_id", "idx", "start", "end", "text", "speaker")
    echo = rows.where("speaker = 'assistant' AND idx % 4 = 1").withColumns({"start": F.col("start") + 0.5, "end": F.col("end") + 0.5})
    return align.merged_timeline(rows.where("speaker = 'user'").unionByName(echo), rows.where("speaker <> 'user'"))


def align_merge_timeline(spark, sf_dir):
    return _two_sources(spark, sf_dir).select("meeting_id", "idx", "speaker", F.round("start", 3).alias("start"))


def align_drop_echo(spark, sf_dir):
    return align.without_echo(_two_sources(spark, sf_dir)).select("meeting_id", "idx", "speaker")


def align_active_utterance(spark, sf_dir):
    rows = utterances(spark, sf_dir)
    times = rows.select("meeting_id").distinct().select("meeting_id", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("k")).select("meeting_id", (F.col("k") * 6.25).alias("t"))
    return align.active_at(rows, times)


def chunk_count(spark, sf_dir):
    return chunking.chunks(table(spark, sf_dir, "documents"), 1000).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


def jobs_listing(spark, sf_dir):
    return jobs.listing(job_rows(spark, sf_dir)).select("id", "title", "category", "updated_at", F.col("n_actions").cast("long").alias("n_actions"), F.col("n_done").cast("long").alias("n_done"), "has_notes")


def jobs_recent_topk(spark, sf_dir):
    return jobs.recent(job_rows(spark, sf_dir)).select("id", "updated_at")


def jobs_search(spark, sf_dir):
    return jobs.matching(job_rows(spark, sf_dir), "  Urgent ").select("id")


def jobs_move_folder(spark, sf_dir):
    return job_rows(spark, sf_dir).select("id", jobs.moved(F.col("category"), "/ASIA/", "Arkiv/ASIA").alias("category"))


def jobs_upsert_category(spark, sf_dir):
    old = job_rows(spark, sf_dir).select("id", "title", "category")
    new = old.where("id % 10 = 0").withColumns({"title": F.concat("title", F.lit(" v2")), "category": F.when(F.col("id") % 20 == 0, " ").otherwise("Ny")})
    return jobs.upserted(old, new)


def actions_union(spark, sf_dir):
    return actions(spark, sf_dir).select("job_id", F.col("idx").cast("long").alias("idx"), "project", "text", "done", "assignee", "due")


def actions_due_state(spark, sf_dir):
    return actions(spark, sf_dir).groupBy(jobs.due_state(F.col("due"), F.lit(TODAY).cast("date")).alias("state")).agg(F.count("*").alias("n"))


def actions_counts(spark, sf_dir):
    return jobs.action_counts(actions(spark, sf_dir), F.lit(TODAY).cast("date"))


def actions_filtered(spark, sf_dir):
    rows = actions(spark, sf_dir).where((~F.col("done")) & F.startswith("category", F.lit("EUROPE/")) & jobs.due_state(F.col("due"), F.lit(TODAY).cast("date")).isin("today", "soon"))
    return rows.select("job_id", F.col("idx").cast("long").alias("idx"), "assignee", "due")


def actions_grouped(spark, sf_dir):
    return jobs.grouped_actions(actions(spark, sf_dir)).select("grp", "nth", "text")


def folder_ancestors(spark, sf_dir):
    return job_rows(spark, sf_dir).select("category").distinct().select(F.explode(jobs.ancestors(F.col("category"))).alias("folder")).distinct()


def folder_counts(spark, sf_dir):
    sized = job_rows(spark, sf_dir).select("category", F.floor("price").cast("long").alias("size"))
    return jobs.folder_rollup(sized, size="size")


def folder_has_children(spark, sf_dir):
    return jobs.folder_tree(folder_ancestors(spark, sf_dir)).select("folder", F.col("depth").cast("long").alias("depth"), "has_children")


def folder_pending_diff(spark, sf_dir):
    pending = spark.createDataFrame([("ASIA",), ("ASIA/JAPAN",), ("Tom",), ("Ny mapp",)], "folder string")
    return jobs.pending_folders(pending, folder_ancestors(spark, sf_dir))


def text_corrections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(transcript.corrected(F.col("text"), "the=>DE\nof->AV")).alias("text_md5"))


def signal_levels(spark, sf_dir):
    return signals(spark, sf_dir).select("user_id", F.round(signal.rms(F.col("a")), 6).alias("rms"), F.round(signal.peak(F.col("a")), 6).alias("peak"))


def signal_mix(spark, sf_dir):
    mixed = signal.mix(F.col("a"), F.col("b"))
    return signals(spark, sf_dir).select("user_id", F.size(mixed).cast("long").alias("n"), F.round(F.aggregate(mixed, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def live_batch_chunks(spark, sf_dir):
    return live.batch_chunks(recordings(spark, sf_dir)).select("source", "start_s", F.size("samples").alias("n_samples"))


def json_salvage(spark, sf_dir):
    answers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit('Svar: ["'), "n_name", F.lit('", "'), "n_name", F.lit('", "Lund"'), F.when(F.col("n_nationkey") % 2 == 0, "] klart").otherwise(', "Conc')).alias("raw"))
    return spans.proposals_of(answers)


def action_lines(spark, sf_dir):
    notes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("# Plan\n- [ ] Ring "), "r_name", F.lit("\n2. Skriv till "), "r_name", F.lit("\n\n* [x] Klart")).alias("text"))
    return transcript.action_lines(notes)


def gazetteer_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("anna-"), F.translate(F.lower("c_mktsegment"), "0123456789", "")).alias("term"), F.col("c_custkey").cast("string").alias("count"))
    return gazetteer.clean_terms(rows)


def gazetteer_localities(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(" och "), F.lit("By"), F.col("n_nationkey").cast("string")).alias("name"), (F.col("n_nationkey") * 1000).cast("string").alias("population"))
    towns = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("term"))
    return gazetteer.localities(rows, towns, spark.createDataFrame([("By7",)], "term string"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii_masked_text(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"pii_{n}_spans": _rule(n) for n in ("personnummer", "epost", "telefon", "ip_adress", "url", "icd10", "lagenhet", "gatuadress", "skolnamn")},
    "pii_diagnosis_spans": _listed("diagnos"), "pii_medicine_spans": _listed("medicin"), "pii_listed_name_spans": _listed("person"), "pii_place_spans": _listed("plats"),
    **{
        f.__name__: f
        for f in (
            pii_name_spans, pii_name_spans_by_token, pii_candidates, pii_resolved, pii_resolved_by_shuffle, pii_counts, pii_category_counts, pii_active, pii_pseudonyms, pii_audit, pii_segments_masked, pii_masked_text, pii_masked_mail_ip, pii_render_segments, pii_paragraph_masked, pii_manual_mask, pii_rejected_filter,
            transcript_text, transcript_timed, transcript_srt, transcript_vtt, transcript_speaker_groups, speakers_in_order, align_dominant_speaker, align_relabel, align_merge_timeline,
            align_drop_echo, align_active_utterance, chunk_count, jobs_listing, jobs_recent_topk, jobs_search, jobs_move_folder, jobs_upsert_category, actions_union, actions_due_state,
            actions_counts, actions_filtered, actions_grouped, folder_ancestors, folder_counts, folder_has_children, folder_pending_diff, text_corrections,
            signal_levels, signal_mix, live_batch_chunks, json_salvage, action_lines, gazetteer_clean, gazetteer_localities,
        )
    },
}

from . import catalog_details, catalog_workspace  # noqa: E402
from .catalog_sql import ORACLE_SQL as _SQL  # noqa: E402

QUERIES |= catalog_workspace.QUERIES | catalog_details.QUERIES
ORACLE_SQL = _SQL | catalog_workspace.ORACLE_SQL | catalog_details.ORACLE_SQL
