"""Transcripts as text, SRT, WebVTT and paragraphs; corrections, titles, action lines. Rows: (meeting_id, idx, start, end, speaker, text)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clock, stamp
from ..sources import writers


def joined_rows(rows: DataFrame, line: Column, key: str, sep: str, name: str) -> DataFrame:
    """One text for each key from its rows' lines by idx."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x.line)
    return rows.groupBy(key).agg(F.array_join(parts, sep).alias(name))


def with_names(rows: DataFrame, labels: DataFrame | None = None, key: str = "meeting_id") -> DataFrame:
    """rows plus `name`: the speaker's label, else the speaker."""
    if labels is None:
        return rows.withColumn("name", F.col("speaker"))
    return rows.join(labels.select(key, "speaker", F.col("label").alias("_l")), [key, "speaker"], "left").withColumn("name", F.coalesce("_l", "speaker")).drop("_l")


def _changed(key: str) -> Column:
    """The speaker differs from the last known one; rows without a speaker change nothing."""
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return F.col("speaker").isNotNull() & ~F.last("speaker", ignorenulls=True).over(before).eqNullSafe(F.col("speaker"))


def as_text(rows: DataFrame, key: str = "meeting_id") -> DataFrame:
    """`Name: body` where the speaker changes, after a blank line unless first; else the body alone."""
    rows = rows.withColumn("_new", _changed(key)).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("idx")))
    line = F.when(F.col("_new"), F.concat(F.when(F.col("_n") > 1, F.lit("\n")).otherwise(F.lit("")), F.col("name"), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    return joined_rows(rows.withColumn("_line", line), F.col("_line"), key, "\n", "transcript")


def as_timed_text(rows: DataFrame, key: str = "meeting_id") -> DataFrame:
    """`[clock] Name: body` where the speaker changes, else `[clock] body`; a line end after each line."""
    rows = rows.withColumn("_new", _changed(key))
    return joined_rows(rows.withColumn("_line", F.concat(_timed_line(), F.lit("\n"))), F.col("_line"), key, "", "transcript")


def _timed_line() -> Column:
    return F.concat(F.lit("["), clock(F.col("start")), F.lit("] "), F.when(F.col("_new"), F.concat(F.col("name"), F.lit(": "))).otherwise(F.lit("")), F.col("text"))


def _prefix() -> Column:
    return F.coalesce(F.concat(F.col("name"), F.lit(": ")), F.lit(""))


def as_srt(rows: DataFrame, key: str = "meeting_id") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy("idx"))
    cue = F.concat(F.col("_n").cast("string"), F.lit("\n"), stamp(F.col("start"), ","), F.lit(" --> "), stamp(F.col("end"), ","), F.lit("\n"), _prefix(), F.col("text"), F.lit("\n\n"))
    return joined_rows(rows.withColumn("_n", n), cue, key, "", "srt")


def as_vtt(rows: DataFrame, key: str = "meeting_id") -> DataFrame:
    cue = F.concat(stamp(F.col("start"), "."), F.lit(" --> "), stamp(F.col("end"), "."), F.lit("\n"), _prefix(), F.col("text"), F.lit("\n\n"))
    return joined_rows(rows, cue, key, "", "vtt").withColumn("vtt", F.concat(F.lit("WEBVTT\n\n"), "vtt"))


def as_word_vtt(rows: DataFrame, key: str = "meeting_id") -> DataFrame:
    """One cue for each word; the name stands before a row's first word if the speaker differs from the row before, null included."""
    w = Window.partitionBy(key).orderBy("idx")
    new = (F.row_number().over(w) == 1) | ~F.lag("speaker").over(w).eqNullSafe(F.col("speaker"))
    words = rows.withColumn("_new", new).select(key, "idx", "name", "_new", F.posexplode("words").alias("_p", "w"))
    lead = F.when(F.col("_new") & (F.col("_p") == 0), _prefix()).otherwise(F.lit(""))
    cue = F.concat(stamp(F.col("w.start"), "."), F.lit(" --> "), stamp(F.col("w.end"), "."), F.lit("\n"), lead, F.col("w.text"), F.lit("\n\n"))
    words = words.withColumn("line", cue).withColumn("idx", F.struct("idx", "_p"))
    return joined_rows(words, F.col("line"), key, "", "vtt").withColumn("vtt", F.concat(F.lit("WEBVTT\n\n"), "vtt"))


def with_texts(rows: DataFrame, texts: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Bodies replaced by texts (key, idx, new_text) where there is one."""
    return rows.join(texts, [key, "idx"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def correction_rules(rules: str) -> list[tuple[str, str]]:
    """Lines `from=>to` (or ->, or =); of more than two parts the first two count, lines without a first part do not."""
    parts = [[p.strip() for p in re.split(r"=>|->|=", line)] for line in rules.split("\n")]
    return [(p[0], p[1]) for p in parts if len(p) >= 2 and p[0]]


def corrected(text: Column, rules: str) -> Column:
    """Rules applied one after the other to whole words, whatever the case; word boundaries are those of ASCII."""
    for old, new in correction_rules(rules):
        text = F.regexp_replace(text, rf"(?i)\b{re.escape(old)}\b", new.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def with_corrections(rows: DataFrame, rules: str) -> DataFrame:
    """rows with corrected texts and `changed`; the words of a changed row are dropped, for their times hold no longer."""
    return _edited(rows.withColumn("_new", corrected(F.col("text"), rules)))


def _edited(rows: DataFrame) -> DataFrame:
    """rows with `_new` as text, `changed` where that is another one, and no words there."""
    rows = rows.withColumn("changed", ~F.col("_new").eqNullSafe(F.col("text")))
    if "words" in rows.columns:
        rows = rows.withColumn("words", F.when(F.col("changed"), F.array().cast(rows.schema["words"].dataType)).otherwise(F.col("words")))
    return rows.withColumn("text", F.col("_new")).drop("_new")


def with_edits(rows: DataFrame, edits: DataFrame, key: str = "meeting_id") -> DataFrame:
    """rows with the trimmed texts of edits (key, idx, new_text), and `changed`; an equal text changes nothing."""
    joined = rows.join(edits.select(key, "idx", F.trim("new_text").alias("_e")), [key, "idx"], "left")
    return _edited(joined.withColumn("_new", F.coalesce("_e", "text")).drop("_e"))


def without_rows(rows: DataFrame, gone: DataFrame, key: str = "meeting_id") -> DataFrame:
    """rows without those of gone (key, idx), numbered anew."""
    left = rows.join(gone.select(key, "idx"), [key, "idx"], "left_anti")
    return left.withColumn("idx", (F.row_number().over(Window.partitionBy(key).orderBy("idx")) - 1).cast("int"))


def with_speakers_set(rows: DataFrame, given: DataFrame, key: str = "meeting_id") -> DataFrame:
    """rows with the speakers of given (key, idx, new_speaker); an empty one means nobody."""
    joined = rows.join(given.select(key, "idx", F.struct(F.nullif("new_speaker", F.lit("")).alias("s")).alias("_g")), [key, "idx"], "left")
    return joined.withColumn("speaker", F.when(F.col("_g").isNotNull(), F.col("_g.s")).otherwise(F.col("speaker"))).drop("_g")


def segment_texts(rows: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, texts): the bodies in order."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x.text).alias("texts"))


def summary_input(rows: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, text): `Name: body` for each row, the body alone without a speaker, joined by line ends; rows as of with_names, with masked
    bodies where with_texts put them."""
    return joined_rows(rows, F.concat(_prefix(), F.col("text")), key, "\n", "text")


def paragraphs(rows: DataFrame, timed: bool = False, key: str = "meeting_id") -> DataFrame:
    """(key, lines) for a Word document: each row with its name, or, timed, the lines of as_timed_text."""
    line = F.concat(_prefix(), F.col("text"))
    if timed:
        rows = rows.withColumn("_new", _changed(key))
        line = _timed_line()
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x.line).alias("lines"))


def exported(rows: DataFrame, suffix: str, timestamps: bool = False, word_level: bool = False, texts: DataFrame | None = None, key: str = "meeting_id") -> DataFrame:
    """(key, content) by file type: srt, vtt (one cue for each word only of raw texts), docx as bytes, anything else plain text.

    rows as of with_names; texts (key, idx, new_text): masked bodies, which take the place of the raw ones.
    """
    raw = texts is None
    rows = rows if raw else with_texts(rows, texts, key)
    if suffix == "docx":
        return writers.as_docx_lists(paragraphs(rows, timestamps, key), key, "lines")
    if suffix == "srt":
        out = as_srt(rows, key)
    elif suffix == "vtt":
        out = as_word_vtt(rows, key) if word_level and raw else as_vtt(rows, key)
    else:
        out = as_timed_text(rows, key) if timestamps else as_text(rows, key)
    return out.select(key, F.col(out.columns[-1]).alias("content"))


def workspace_text() -> Column:
    """A job's participants, notes, actions and follow-up as plain text, from columns of these names."""
    trim = lambda c: F.trim(F.coalesce(c, F.lit("")))
    some = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind))
    people = F.filter(some("participants", "array<struct<name:string,role:string>>"), lambda p: (trim(p["name"]) != "") | (trim(p["role"]) != ""))
    person = lambda p: F.concat(F.lit("- "), trim(p["name"]), F.when(trim(p["role"]) != "", F.concat(F.lit(" ("), trim(p["role"]), F.lit(")"))).otherwise(""))
    todo = some("actions", "array<struct<text:string,done:boolean,assignee:string,due:string>>")
    extra = lambda a: F.concat_ws(", ", F.nullif(trim(a["assignee"]), F.lit("")), F.nullif(trim(a["due"]), F.lit("")))
    action = lambda a: F.concat(F.lit("- ["), F.when(a["done"], "x").otherwise(" "), F.lit("] "), trim(a["text"]), F.when(extra(a) != "", F.concat(F.lit(" ("), extra(a), F.lit(")"))).otherwise(""))
    block = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"), F.lit("\n")))
    notes = F.when(trim(F.col("notes")) != "", F.concat(F.lit("Anteckningar:\n"), trim(F.col("notes")), F.lit("\n")))
    after = F.when(trim(F.col("followup")) != "", F.concat(F.lit("Uppföljning: "), trim(F.col("followup"))))
    whole = F.concat_ws("\n", block("Deltagare:", F.transform(people, person)), notes, block("Att göra:", F.transform(todo, action)), after)
    return F.regexp_replace(whole, r"^\s+|\s+$", "")


#: Fixed value: what a language model is told about masked texts.
MASKED_NOTE = (
    "Texten nedan är avidentifierad: namn, platser m.m. är ersatta med pseudonymer (t.ex. Person 1, Plats 1) där samma pseudonym avser samma person/plats genomgående. "
    "Behåll pseudonymerna exakt — gissa eller hitta inte på riktiga identiteter."
)
PREFILL_MOST = 6000


def payload(text: Column, prompt: str, masked: bool, context: str = "", raw_confirmed: bool = False) -> Column:
    """What is handed to a language model elsewhere: prompt, note on masking, context, then the text. A text that is not masked needs a
    confirmation, else it is an error."""
    if not masked and not raw_confirmed:
        raise ValueError("texts that are not masked leave only with raw_confirmed")
    head = [x for x in (prompt.strip(), MASKED_NOTE if masked else "", f"Kontext: {context.strip()}" if context.strip() else "") if x]
    return F.concat(F.lit("\n\n".join(head) + "\n\n---\n\n"), text)


def prefill_url(text: Column, base: str, most: int = PREFILL_MOST) -> Column:
    """base followed by the percent-encoded text; null where the encoded text is longer than most."""
    encoded = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.when(F.length(encoded) <= most, F.concat(F.lit(base), encoded))


def job_date(iso: Column) -> Column:
    """`2 jan. 2024 08:30` of an ISO time; what is none stays as it is. The months' short names."""
    months = F.array(*[F.lit(m) for m in ("jan.", "feb.", "mars", "apr.", "maj", "juni", "juli", "aug.", "sep.", "okt.", "nov.", "dec.")])
    at = F.try_to_timestamp(iso)
    return F.when(at.isNotNull(), F.concat_ws(" ", F.dayofmonth(at).cast("string"), F.element_at(months, F.month(at)), F.year(at).cast("string"), F.date_format(at, "HH:mm"))).otherwise(iso)


def preview(text: Column, most: int = 60) -> Column:
    """The text, cut at `most` characters with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("…"))).otherwise(text)


def title_of(file_name: Column, text: Column, kind: Column) -> Column:
    """The file's name, else the first seven words, else the kind's label."""
    words = F.array_join(F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), 1, 7), " ")
    return F.coalesce(F.nullif(F.trim(file_name), F.lit("")), F.nullif(words, F.lit("")), kind)


def action_lines(notes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, action): lines without bullets, boxes and numbers; headings and blank lines are skipped."""
    lines = notes.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("ord", "line")).where(~F.trim("line").rlike(r"^#") & ~F.trim("line").rlike(r"^\*\*.*\*\*:?$"))
    clean = F.trim(F.regexp_replace(F.trim("line"), r"^(?:[-*•]\s*)?(?:\[[ xX]?\]\s*)?(?:\d+[.)]\s*)?", ""))
    return lines.select(key, "ord", clean.alias("action")).where("action <> ''")
