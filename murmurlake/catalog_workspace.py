"""Further queries: changes to jobs and tasks, views of actions and folders, edits of transcripts, what is handed to models and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_base as base
from .catalog_sql import _JOBS, _U
from .operators import align, chunking, gazetteer, jobs, masking, transcript
from .streaming import live

def _today():
    return F.lit(base.TODAY).cast("date")


def _details(spark, sf_dir) -> DataFrame:
    """Jobs with everything that a search looks through and a workspace shows."""
    i = F.col("id").cast("string")
    rows = base.job_rows(spark, sf_dir)
    return rows.withColumns({
        "source_text": F.concat(F.lit("Källa "), i), "followup": F.when(F.col("id") % 3 == 0, F.concat(F.lit("Ring om "), i)).otherwise(""),
        "participants": F.array(F.struct(F.concat(F.lit("Kund "), i).alias("name"), F.when(F.col("id") % 2 == 0, "chef").otherwise(" ").alias("role"))),
        "utterances": F.array(F.struct(F.concat(F.lit("Vi talade om "), F.col("id") % 100).alias("text"))),
        "audio_path": F.concat(F.when(F.col("id") % 2 == 0, "/own/").otherwise("/user/"), i, F.lit(".wav")), "mic_wav_path": F.when(F.col("id") % 4 == 0, F.concat(F.lit("/own/mic/"), i)), "mix_wav_path": F.lit(None).cast("string"),
    })


def jobs_search_people(spark, sf_dir):
    return jobs.matching(_details(spark, sf_dir), "KUND 12").select("id")


def jobs_search_spoken(spark, sf_dir):
    return jobs.matching(_details(spark, sf_dir), " talade om 42 ").select("id")


def job_lookup(spark, sf_dir):
    return jobs.job_by_id(base.job_rows(spark, sf_dir), 7).select("id", "title", "category")


def jobs_renamed(spark, sf_dir):
    old = base.job_rows(spark, sf_dir).select("id", "title", "category", "updated_at")
    return jobs.renamed(old, old.where("id % 10 = 0").select("id", F.concat("title", F.lit("!")).alias("title"), F.lit("Ny/Plats").alias("category")))


def _tenth(rows: DataFrame) -> DataFrame:
    return rows.where("id % 10 = 0").select("id")


def jobs_without_audio(spark, sf_dir):
    rows = _details(spark, sf_dir)
    return jobs.without_audio(rows, _tenth(rows), "/own")[0].select("id", "audio_path", "mic_wav_path")


def jobs_audio_to_delete(spark, sf_dir):
    rows = _details(spark, sf_dir)
    return jobs.without_audio(rows, _tenth(rows), "/own")[1]


def jobs_deleted(spark, sf_dir):
    rows = base.job_rows(spark, sf_dir).select("id", "title")
    return jobs.deleted(rows, _tenth(rows))


def jobs_bulk_moved(spark, sf_dir):
    rows = base.job_rows(spark, sf_dir).select("id", "category")
    return jobs.moved_jobs(rows, _tenth(rows), " Arkiv/1998 ")


def actions_changed(spark, sf_dir):
    """One action of a job set, one added to another, one deleted from a third."""
    rows = jobs.action_set(base.job_rows(spark, sf_dir), 1, 0, "2000-01-01", text="Ny text", done=True)
    rows = jobs.action_deleted(jobs.action_added(rows, 2, "2000-01-02", text="Till sist", assignee="S9"), 3, 0, "2000-01-03")
    rows = jobs.action_deleted(rows, 5, 999, "2000-01-04")
    each = rows.select("id", "updated_at", F.posexplode_outer("actions").alias("idx", "a"))
    return each.select("id", "updated_at", F.col("idx").cast("long").alias("idx"), "a.text", "a.done", F.coalesce("a.assignee", F.lit("")).alias("assignee"))


def tasks_changed(spark, sf_dir):
    p = base.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("text"), F.lit(False).alias("done"))
    new = spark.createDataFrame([(-1, "Egen", False)], "id long, text string, done boolean")
    change = spark.createDataFrame([(3, "Ändrad", True), (-99, "Finns inte", True)], "id long, text string, done boolean")
    return jobs.deleted(jobs.updated_tasks(jobs.added_tasks(p, new), change), spark.createDataFrame([(5,), (-98,)], "id long"))


def actions_filtered_by(spark, sf_dir):
    rows = jobs.filtered_actions(base.actions(spark, sf_dir), _today(), status="open", assignee="S1", folder="EUROPE", due="overdue", query="line 1")
    return rows.select("job_id", F.col("idx").cast("long").alias("idx"), "project", "due")


def actions_without_date(spark, sf_dir):
    return jobs.filtered_actions(base.actions(spark, sf_dir), _today(), due="none", query="part 1").select("project", "text")


def actions_by_project(spark, sf_dir):
    return jobs.grouped_actions(base.actions(spark, sf_dir), "project").select("grp", "nth", "text")


def action_group_heads(spark, sf_dir):
    return jobs.group_heads(base.actions(spark, sf_dir))


def action_keys(spark, sf_dir):
    rows = base.actions(spark, sf_dir)
    return rows.select(jobs.row_key(F.col("job_id"), F.col("idx"), F.col("idx")).alias("row_key"), jobs.project_name(F.col("job_id"), F.col("project")).alias("project"))


def folder_total_bytes(spark, sf_dir):
    return jobs.total_bytes(base.job_rows(spark, sf_dir).select(F.floor("price").cast("long").alias("bytes")))


def folder_jobs(spark, sf_dir):
    return jobs.jobs_in_folder(base.job_rows(spark, sf_dir), "ASIA").select("id", "category")


def folder_categories(spark, sf_dir):
    return jobs.categories(base.job_rows(spark, sf_dir))


def folder_parents(spark, sf_dir):
    return jobs.categories(base.job_rows(spark, sf_dir)).select("category", jobs.parent_of(F.col("category")).alias("parent"), F.array_join(jobs.path_parts(F.concat(F.lit(" / "), "category")), "|").alias("parts"))


def folder_pending_rewritten(spark, sf_dir):
    pending = base.table(spark, sf_dir, "nation").select(F.concat(F.lit("Land/"), "n_name").alias("folder")).unionByName(spark.createDataFrame([("Land",), ("Landet",), ("Land/CHINA/Norr",)], "folder string"))
    return jobs.rewritten_pending(pending, "Land", "")


def _rows(spark, sf_dir) -> DataFrame:
    return base.utterances(spark, sf_dir)


def transcript_segment_texts(spark, sf_dir):
    return transcript.segment_texts(_rows(spark, sf_dir)).select("meeting_id", F.md5(F.array_join("texts", "|")).alias("texts_md5"))


def transcript_paragraphs(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    timed = transcript.paragraphs(rows, timed=True).select("meeting_id", F.md5(F.array_join("lines", "|")).alias("timed_md5"))
    return transcript.paragraphs(rows).select("meeting_id", F.md5(F.array_join("lines", "|")).alias("lines_md5")).join(timed, "meeting_id")


def transcript_summary_input(spark, sf_dir):
    return transcript.summary_input(_rows(spark, sf_dir).withColumn("name", F.when(F.col("speaker") == "user", F.col("name")))).select("meeting_id", F.md5("text").alias("text_md5"))


def transcript_export(spark, sf_dir):
    """Subtitles with masked bodies where there are any."""
    rows = _rows(spark, sf_dir)
    hidden = rows.where("idx % 2 = 0").select("meeting_id", "idx", F.lit("[dold]").alias("new_text"))
    return transcript.exported(rows, "vtt", word_level=True, texts=hidden)


def transcript_corrected(spark, sf_dir):
    rows = transcript.with_corrections(_rows(spark, sf_dir), "the=>DE\nis -> ÄR\n=> x\nof=>AV=>b")
    return rows.select("meeting_id", "idx", "changed", F.md5("text").alias("text_md5"))


def transcript_edited(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    edits = rows.where("idx % 3 = 0").select("meeting_id", "idx", F.when(F.col("idx") == 0, F.col("text")).otherwise(F.concat(F.lit("  ny "), F.col("idx").cast("string"))).alias("new_text"))
    return transcript.with_edits(rows, edits).select("meeting_id", "idx", "changed", "text")


def transcript_rows_deleted(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return transcript.without_rows(rows, rows.where("idx = 1").select("meeting_id", "idx")).select("meeting_id", "idx", "speaker")


def transcript_speakers_set(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    given = rows.where("idx < 2").select("meeting_id", "idx", F.when(F.col("idx") == 0, "").otherwise("TALARE_9").alias("new_speaker"))
    return transcript.with_speakers_set(rows, given).select("meeting_id", "idx", "speaker")


def workspace_texts(spark, sf_dir):
    return _details(spark, sf_dir).select("id", F.md5(transcript.workspace_text()).alias("text_md5"))


def ai_payloads(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(transcript.payload(F.coalesce("text", F.lit("")), " Sammanfatta. ", True, " skola ")).alias("payload_md5"))


def ai_prefill_urls(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(transcript.prefill_url(F.substr("text", F.lit(1), F.lit(4000)), "https://chat.example/?q=")).alias("url_md5"))


def job_dates(spark, sf_dir):
    rows = base.job_rows(spark, sf_dir)
    iso = F.when(F.col("id") % 5 == 0, "i går").otherwise(F.concat("updated_at", F.lit("T08:30:00")))
    return rows.select("id", transcript.job_date(iso).alias("shown"), transcript.preview(F.concat_ws(" ", "title", "category", "notes"), 30).alias("preview"))


def align_without_speakers(spark, sf_dir):
    return align.without_speakers(_rows(spark, sf_dir)).select("meeting_id", "idx", "speaker")


def align_rebased(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("chunk", F.col("idx") % 4)
    chunks = rows.select("meeting_id", "chunk").distinct().withColumn("start_s", F.col("chunk") * 2.5)
    return align.rebased(rows.select("meeting_id", "idx", "chunk", "start", "end"), chunks).select("meeting_id", "idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def align_active_word(spark, sf_dir):
    """Words of equal length within each utterance, asked for at some times of each meeting."""
    rows = _rows(spark, sf_dir).withColumn("ws", F.split("text", " ")).withColumn("step", (F.col("end") - F.col("start")) / F.size("ws"))
    at = lambda i: F.col("start") + i * F.col("step")
    words = rows.select("meeting_id", "idx", F.transform("ws", lambda w, i: F.struct(at(i).alias("start"), at(i + 1).alias("end"), w.alias("text"))).alias("words"))
    times = rows.select("meeting_id").distinct().select("meeting_id", F.explode(F.array(*[F.lit(x) for x in (0.05, 3.21, 40.4)])).alias("t"))
    return align.active_word(words, times).select("meeting_id", "t", F.col("idx").cast("long").alias("idx"), "word")


def pii_paragraph_speakers(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumnRenamed("meeting_id", "doc_id")
    paras = masking.joined_paragraphs(rows.select("doc_id", "idx", "text"))[1]
    labels = rows.select("doc_id").distinct().select("doc_id", F.lit("user").alias("speaker"), F.lit("Anna").alias("label"))
    return masking.paragraph_speakers(paras, rows, labels).select("doc_id", F.col("para").cast("long").alias("para"), "p_start", "p_end", "speaker")


def chunk_numbers(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    return chunking.chunks(docs, 500).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def prompts(spark, sf_dir):
    """Every prompt over every document."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = {"map": chunking.map_prompt(F.col("text")), "final": chunking.final_prompt(F.col("text"), chunking.structure_of("custom", "Mål\nBeslut")), "ask": chunking.question_prompt(F.col("text"), "Vem?"), "combine": chunking.combining_prompt(F.col("text"), "Vem?")}
    return docs.select("doc_id", *[F.md5(p).alias(f"{n}_md5") for n, p in made.items()])


def answers(spark, sf_dir):
    """Answers of the stub to a question about each conversation that is one chunk."""
    docs = transcript.as_text(_rows(spark, sf_dir)).select(F.col("meeting_id").alias("doc_id"), F.col("transcript").alias("text")).where(F.octet_length("text") < 15_000)
    return chunking.answered(docs, "Vad beslutades?").select("doc_id", F.md5("answer").alias("answer_md5"))


def summaries(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text").where("octet_length(text) < 15000")
    return chunking.summarized(docs, chunking.structure_of("sammanfattning")).select("doc_id", F.md5("summary").alias("summary_md5"))


def gazetteer_schools(spark, sf_dir):
    n = base.table(spark, sf_dir, "nation")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Anpassad grundskola", "Engelska skolan", "Skolan för", "Fristående - i")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    name = F.when(F.col("n_nationkey") % 4 == 1, F.concat(kind, F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in ("Norr", "Söder", "Öster", "Väster", "Mitt")]), (F.col("n_nationkey") % 5 + 1).cast("int")))).otherwise(kind)
    status = F.element_at(F.array(F.lit("Aktiv"), F.lit("Vilande"), F.lit("")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return gazetteer.schools(n.select(name.alias("SKOLENHETSNAMN"), status.alias("status")))


def gazetteer_file(spark, sf_dir):
    one = base.table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.lit("900").alias("count"))
    two = base.table(spark, sf_dir, "region").select(F.col("r_name").alias("term"), F.lit("1 200").alias("count"))
    lines = gazetteer.list_lines(gazetteer.clean_terms(gazetteer.both_lists(one, two)), ["# Namn"])
    return lines.groupBy("value").agg(F.count("*").alias("n"))


def live_stop_figures(spark, sf_dir):
    e = base.table(spark, sf_dir, "events").where("value IS NOT NULL")
    rows = lambda odd: e.where(F.col("event_id") % 2 == odd).select((F.col("event_id") / 10.0).alias("start_s"), F.array("value", "value").alias("samples"), F.lit(4).alias("rate"))
    return live.stop_figures(live.both_sources(rows(0), rows(1)))


def live_lag(spark, sf_dir):
    e = base.table(spark, sf_dir, "events").where("event_id IS NOT NULL AND user_id IS NOT NULL")
    rows = e.select(F.col("user_id").cast("string").alias("source"), (F.col("event_id") * 1.0).alias("event_s"), (F.col("event_id") - F.col("event_id") % 37).cast("double").alias("processed_s"))
    return live.lagging(rows)


def live_finalised(spark, sf_dir):
    """A stop with the live path behind: all is recognised anew, in one batch."""
    return live.finalised(None, base.recordings(spark, sf_dir), live.energy_stub, behind_s=12.0).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 6).alias("seconds"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        jobs_search_people, jobs_search_spoken, job_lookup, jobs_renamed, jobs_without_audio, jobs_audio_to_delete, jobs_deleted, jobs_bulk_moved, actions_changed, tasks_changed, actions_filtered_by,
        actions_without_date, actions_by_project, action_group_heads, action_keys, folder_total_bytes, folder_jobs, folder_categories, folder_parents, folder_pending_rewritten,
        transcript_segment_texts, transcript_paragraphs, transcript_summary_input, transcript_export, transcript_corrected, transcript_edited, transcript_rows_deleted, transcript_speakers_set,
        workspace_texts, ai_payloads, ai_prefill_urls, job_dates, align_without_speakers, align_rebased, align_active_word, pii_paragraph_speakers, chunk_numbers, prompts, answers, summaries,
        gazetteer_schools, gazetteer_file, live_stop_figures, live_lag, live_finalised,
    )
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines(text: str) -> str:
    """A text with line ends as SQL."""
    return " || chr(10) || ".join(_quoted(x) for x in text.split("\n"))


def _asked(system: str, *parts: str) -> str:
    """SQL of a prompt: parts are SQL."""
    return _lines(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n") + "".join(f" || {p}" for p in parts) + " || " + _lines("<|im_end|>\n<|im_start|>assistant\n")


_DETAILS = _JOBS + """, v AS (
  SELECT id, title, category, notes, 'Källa ' || id AS source_text, CASE WHEN id % 3 = 0 THEN 'Ring om ' || id ELSE '' END AS followup, 'Kund ' || id AS who, CASE WHEN id % 2 = 0 THEN 'chef' ELSE '' END AS part,
    (CASE WHEN id % 2 = 0 THEN '/own/' ELSE '/user/' END) || id || '.wav' AS audio_path, CASE WHEN id % 4 = 0 THEN '/own/mic/' || id END AS mic_wav_path FROM j
)"""
_OWN = ", b AS (SELECT *, 'Line ' || (idx + 1) AS t FROM a)"
_DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

ORACLE_SQL: dict[str, str] = {
    "jobs_search_people": _DETAILS + " SELECT id FROM v WHERE contains(lower(who), 'kund 12')",
    "jobs_search_spoken": _DETAILS + " SELECT id FROM v WHERE id % 100 = 42",
    "job_lookup": _JOBS + " SELECT id, title, category FROM j WHERE id = 7",
    "jobs_renamed": _JOBS + " SELECT id, CASE WHEN id % 10 = 0 THEN title || '!' ELSE title END AS title, CASE WHEN id % 10 = 0 THEN 'Ny/Plats' ELSE category END AS category, updated_at FROM j",
    "jobs_without_audio": _DETAILS + " SELECT id, CASE WHEN id % 10 <> 0 THEN audio_path END AS audio_path, CASE WHEN id % 10 <> 0 THEN mic_wav_path END AS mic_wav_path FROM v",
    "jobs_audio_to_delete": _DETAILS + " SELECT path FROM (SELECT id, unnest([audio_path, mic_wav_path]) AS path FROM v) WHERE id % 10 = 0 AND path LIKE '/own/%'",
    "jobs_deleted": _JOBS + " SELECT id, title FROM j WHERE id % 10 <> 0",
    "jobs_bulk_moved": _JOBS + " SELECT id, CASE WHEN id % 10 = 0 THEN 'Arkiv/1998' ELSE category END AS category FROM j",
    "actions_changed": _JOBS
    + """, b AS (
  SELECT id, CASE WHEN id = 3 THEN idx - 1 ELSE idx END AS idx, CASE WHEN id = 1 AND idx = 0 THEN 'Ny text' ELSE text END AS text, CASE WHEN id = 1 AND idx = 0 THEN true ELSE done END AS done, assignee FROM a WHERE NOT (id = 3 AND idx = 0)
  UNION ALL SELECT 2, (SELECT count(*) FROM a WHERE id = 2), 'Till sist', false, 'S9'
)
SELECT j.id, CASE WHEN j.id = 1 THEN '2000-01-01' WHEN j.id = 2 THEN '2000-01-02' WHEN j.id = 3 AND EXISTS (SELECT 1 FROM a WHERE a.id = 3) THEN '2000-01-03' ELSE updated_at END AS updated_at,
  idx, text, done, coalesce(assignee, '') AS assignee FROM j LEFT JOIN b ON j.id = b.id""",
    "tasks_changed": "SELECT p_partkey::BIGINT AS id, CASE WHEN p_partkey = 3 THEN 'Ändrad' ELSE p_name END AS text, p_partkey = 3 AS done FROM part WHERE p_partkey <> 5 UNION ALL SELECT -1, 'Egen', false",
    "actions_filtered_by": _JOBS
    + " SELECT job_id, idx, project, due FROM y WHERE NOT done AND trim(assignee) = 'S1' AND category LIKE 'EUROPE/%' AND state = 'overdue' AND contains(lower(text || ' ' || coalesce(assignee, '') || ' ' || project), 'line 1')",
    "actions_without_date": _JOBS + " SELECT project, text FROM y WHERE state IN ('none', 'text') AND contains(lower(text || ' ' || coalesce(assignee, '') || ' ' || project), 'part 1')",
    "actions_by_project": _JOBS + " SELECT project AS grp, row_number() OVER (PARTITION BY project ORDER BY job_id NULLS FIRST, idx, text) - 1 AS nth, text FROM x",
    "action_group_heads": _JOBS + " SELECT coalesce(nullif(trim(assignee), ''), 'Utan ansvarig') AS grp, count(*) AS n FROM x GROUP BY 1",
    "action_keys": _JOBS + " SELECT CASE WHEN job_id IS NULL THEN 't:' || idx ELSE 'j:' || job_id || ':' || idx END AS row_key, project FROM x",
    "folder_total_bytes": _JOBS + " SELECT sum(floor(price)::BIGINT)::BIGINT AS bytes FROM j",
    "folder_jobs": _JOBS + " SELECT id, category FROM j WHERE category LIKE 'ASIA/%'",
    "folder_categories": _JOBS + " SELECT DISTINCT category FROM j",
    "folder_parents": _JOBS + " SELECT DISTINCT category, split_part(category, '/', 1) || '/' || split_part(category, '/', 2) AS parent, replace(category, '/', '|') AS parts FROM j",
    "folder_pending_rewritten": "SELECT n_name AS folder FROM nation UNION ALL SELECT unnest(['Landet', 'CHINA/Norr'])",
    "transcript_segment_texts": _U + " SELECT meeting_id, md5(string_agg(text, '|' ORDER BY idx)) AS texts_md5 FROM u GROUP BY meeting_id",
    "transcript_paragraphs": _U
    + """, s AS (SELECT *, round("start")::BIGINT AS sec FROM u)
SELECT meeting_id, md5(string_agg(name || ': ' || text, '|' ORDER BY idx)) AS lines_md5, md5(string_agg('[' || CASE WHEN sec >= 3600 THEN printf('%d:%02d:%02d', sec // 3600, (sec // 60) % 60, sec % 60)
  ELSE printf('%02d:%02d', sec // 60, sec % 60) END || '] ' || CASE WHEN before IS DISTINCT FROM speaker THEN name || ': ' ELSE '' END || text, '|' ORDER BY idx)) AS timed_md5 FROM s GROUP BY meeting_id""",
    "transcript_summary_input": _U + " SELECT meeting_id, md5(string_agg(CASE WHEN speaker = 'user' THEN name || ': ' ELSE '' END || text, chr(10) ORDER BY idx)) AS text_md5 FROM u GROUP BY meeting_id",
    "transcript_corrected": _U
    + r""", c2 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bthe\b', 'DE', 'g'), '(?i)\bis\b', 'ÄR', 'g'), '(?i)\bof\b', 'AV', 'g') AS t FROM u)
SELECT meeting_id, idx, t <> text AS changed, md5(t) AS text_md5 FROM c2""",
    "transcript_edited": _U
    + " SELECT meeting_id, idx, idx % 3 = 0 AND (CASE WHEN idx = 0 THEN trim(text) <> text ELSE 'ny ' || idx <> text END) AS changed, CASE WHEN idx = 0 THEN trim(text) WHEN idx % 3 = 0 THEN 'ny ' || idx ELSE text END AS text FROM u",
    "transcript_rows_deleted": _U + " SELECT meeting_id, (row_number() OVER (PARTITION BY meeting_id ORDER BY idx) - 1)::INT AS idx, speaker FROM u WHERE idx <> 1",
    "transcript_speakers_set": _U + " SELECT meeting_id, idx, CASE WHEN idx = 1 THEN 'TALARE_9' WHEN idx > 1 OR idx < 0 THEN speaker END AS speaker FROM u",
    "workspace_texts": _DETAILS
    + """, t AS (
  SELECT id, string_agg('- [' || CASE WHEN done THEN 'x' ELSE ' ' END || '] ' || text || ' (' || assignee || ', ' || due || ')', chr(10) ORDER BY idx) AS todo FROM a GROUP BY id
)
SELECT v.id, md5(trim(concat_ws(chr(10), 'Deltagare:' || chr(10) || '- ' || who || CASE WHEN part <> '' THEN ' (' || part || ')' ELSE '' END || chr(10), CASE WHEN trim(notes) <> '' THEN 'Anteckningar:' || chr(10) || trim(notes) || chr(10) END,
  'Att göra:' || chr(10) || todo || chr(10), CASE WHEN followup <> '' THEN 'Uppföljning: ' || followup END), chr(10) || ' ')) AS text_md5 FROM v LEFT JOIN t ON v.id = t.id""",
    "ai_payloads": f"SELECT doc_id, md5({_lines('Sammanfatta.' + chr(10) * 2 + transcript.MASKED_NOTE + chr(10) * 2 + 'Kontext: skola' + chr(10) * 2 + '---' + chr(10) * 2)} || text) AS payload_md5 FROM ({_DOCS})",
    "ai_prefill_urls": """
WITH e AS (
  SELECT doc_id, replace(replace(replace(replace(replace(url_encode(substr(text, 1, 4000)), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS x FROM documents
)
SELECT doc_id, CASE WHEN length(x) <= 6000 THEN md5('https://chat.example/?q=' || x) END AS url_md5 FROM e""",
    "job_dates": _JOBS
    + """, p AS (
  SELECT id, CASE WHEN id % 5 = 0 THEN 'i går' ELSE day(updated_at::DATE) || ' ' || (['jan.', 'feb.', 'mars', 'apr.', 'maj', 'juni', 'juli', 'aug.', 'sep.', 'okt.', 'nov.', 'dec.'])[month(updated_at::DATE)] || ' ' || year(updated_at::DATE) || ' 08:30' END AS shown,
    concat_ws(' ', title, category, notes) AS t FROM j
)
SELECT id, shown, CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '…' ELSE t END AS preview FROM p""",
    "align_without_speakers": _U + " SELECT meeting_id, idx, NULL::VARCHAR AS speaker FROM u",
    "align_rebased": _U + """ SELECT meeting_id, idx, round("start" + (idx % 4) * 2.5, 3) AS "start", round("end" + (idx % 4) * 2.5, 3) AS "end" FROM u""",
    "align_active_word": _U
    + """, w AS (
  SELECT meeting_id, idx, "start", ("end" - "start") / len(string_split(text, ' ')) AS step, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM u
), t AS (SELECT unnest([0.05::DOUBLE, 3.21, 40.4]) AS t)
SELECT meeting_id, t, idx::BIGINT AS idx, word FROM w, t WHERE "start" + (i - 1) * step <= t AND t < "start" + i * step""",
    "pii_paragraph_speakers": _U
    + """ SELECT meeting_id AS doc_id, n - 1 AS para, (sum(length(text) + 1) OVER w - length(text) - 1)::INT AS p_start, (sum(length(text) + 1) OVER w - 1)::INT AS p_end, CASE WHEN speaker = 'user' THEN 'Anna' ELSE speaker END AS speaker
FROM u WINDOW w AS (PARTITION BY meeting_id ORDER BY idx)""",
    "chunk_numbers": """
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), s AS (
  SELECT doc_id, i, strlen(CASE WHEN line LIKE '%' || chr(13) THEN line[:-2] ELSE line END) AS n FROM l
), r AS (
  SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS made, 0::BIGINT AS held FROM documents
  UNION ALL
  SELECT r.doc_id, s.i, made + CASE WHEN held > 0 AND held + s.n + 1 > 500 THEN 1 ELSE 0 END + CASE WHEN s.n > 500 THEN ceil(s.n / 500.0)::BIGINT ELSE 0 END,
    CASE WHEN s.n > 500 THEN 0 WHEN held > 0 AND held + s.n + 1 <= 500 THEN held + 1 + s.n ELSE s.n END
  FROM r JOIN s ON r.doc_id = s.doc_id AND s.i = r.i + 1
)
SELECT doc_id, made + CASE WHEN held > 0 OR made = 0 THEN 1 ELSE 0 END AS n_chunks FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1""",
    "prompts": f"SELECT doc_id, md5({_asked(chunking.SYSTEM, _lines(chunking.MAP_ASK), 'text')}) AS map_md5, md5({_asked(chunking.SYSTEM, _lines(chunking.CUSTOM + 'Mål' + chr(10) + 'Beslut' + chunking.FINAL_ASK), 'text')}) AS final_md5, "
    f"md5({_asked(chunking.QA_SYSTEM, _lines('Mötestranskript:' + chr(10) * 2), 'text', _lines(chr(10) * 2 + '---' + chr(10) + 'Fråga: Vem?'))}) AS ask_md5, "
    f"md5({_asked(chunking.QA_SYSTEM, _lines('Delsvar från olika delar av mötet:' + chr(10) * 2), 'text', _lines(chr(10) * 2 + '---' + chr(10) + 'Väv ihop delsvaren till ETT sammanhängande svar på frågan: Vem?'))}) AS combine_md5 FROM ({_DOCS})",
    "summaries": f"SELECT doc_id, md5(substr({_asked(chunking.SYSTEM, _lines(chunking.STRUCTURES['sammanfattning'] + chunking.FINAL_ASK), 'text')}, 1, 1024)) AS summary_md5 FROM documents WHERE strlen(text) < 15000",
    "gazetteer_schools": """
WITH s AS (
  SELECT n_nationkey AS i, n_nationkey % 4 AS k, (['Aktiv', 'Vilande', ''])[n_nationkey % 3 + 1] AS status, n_name FROM nation
)
SELECT DISTINCT 'Engelska skolan ' || (['Norr', 'Söder', 'Öster', 'Väster', 'Mitt'])[i % 5 + 1] AS term FROM s WHERE k = 1 AND status <> 'Vilande'""",
    "gazetteer_file": """
WITH t AS (
  SELECT n_name AS t FROM nation WHERE regexp_full_match(n_name, '[A-Za-z -]+') UNION SELECT r_name FROM region
)
SELECT value, count(*) AS n FROM (SELECT DISTINCT array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS value FROM t UNION ALL SELECT unnest(['# Namn', ''])) GROUP BY value""",
    "live_stop_figures": "SELECT greatest(max(event_id / 10.0::DOUBLE) FILTER (event_id % 2 = 0), max(event_id / 10.0::DOUBLE) FILTER (event_id % 2 = 1)) + 0.5::DOUBLE AS duration_s, max(event_id / 10.0::DOUBLE) FILTER (event_id % 2 = 0) + 0.5::DOUBLE AS mic_s, max(event_id / 10.0::DOUBLE) FILTER (event_id % 2 = 1) + 0.5::DOUBLE AS meeting_s FROM events WHERE value IS NOT NULL",
    "live_lag": "SELECT user_id::VARCHAR AS source, min(event_id)::DOUBLE AS first_late_s FROM events WHERE event_id % 37 > 30 GROUP BY user_id",
}
ORACLE_SQL["answers"] = _U + f""", d AS (
  SELECT meeting_id AS doc_id, string_agg(CASE WHEN before IS DISTINCT FROM speaker THEN (CASE WHEN n > 1 THEN chr(10) ELSE '' END) || name || ': ' || text ELSE text END, chr(10) ORDER BY idx) AS text FROM u GROUP BY meeting_id
)
SELECT doc_id, md5(substr({_asked(chunking.QA_SYSTEM, _lines('Mötestranskript:' + chr(10) * 2), 'text', _lines(chr(10) * 2 + '---' + chr(10) + 'Fråga: Vad beslutades?'))}, 1, 512)) AS answer_md5 FROM d WHERE strlen(text) < 15000"""
ORACLE_SQL["transcript_export"] = _U + """ SELECT meeting_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({s} || ' --> ' || {e} || chr(10) || name || ': ' || CASE WHEN idx % 2 = 0 THEN '[dold]' ELSE text END || chr(10) || chr(10), '' ORDER BY idx) AS content FROM u GROUP BY meeting_id""".replace("{s}", base.stamp_sql('"start"')).replace("{e}", base.stamp_sql('"end"'))
