"""Texts, Word documents, WAV audio, job folders, projects and term lists as DataFrames. Everything is read through Spark's readers."""

from __future__ import annotations

import io
import wave
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = (".txt", ".text", ".md")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
WORD = "struct<start:double,end:double,text:string>"
UTTERANCE = f"struct<start:double,end:double,speaker:string,text:string,words:array<{WORD}>>"
#: The fields of stored jobs, tasks and projects.
TRANSCRIPT = f"struct<utterances:array<{UTTERANCE}>,language:string,model:string,diarized:boolean>"
JOB_SCHEMA = (
    f"version INT, id STRING, jobType STRING, title STRING, createdAt STRING, updatedAt STRING, transcript {TRANSCRIPT}, speakerLabels MAP<STRING,STRING>, audioPath STRING, micWavPath STRING, "
    "mixWavPath STRING, transcriptionPending BOOLEAN, category STRING, sourceText STRING, sourcePath STRING, enabled ARRAY<STRING>, terms ARRAY<STRING>, useAi BOOLEAN, rejected ARRAY<INT>, "
    "summaryDraft STRING, summaryTemplate STRING, summaryModel STRING, customHeadings STRING, notes STRING, participants ARRAY<STRUCT<name:STRING,role:STRING>>, "
    "actions ARRAY<STRUCT<text:STRING,done:BOOLEAN,assignee:STRING,due:STRING>>, followup STRING"
)
PROJECT_SCHEMA = f"version INT, transcript {TRANSCRIPT}, speaker_labels MAP<STRING,STRING>, audio_path STRING, speakerLabels MAP<STRING,STRING>, audioPath STRING"
TASK_SCHEMA = "id STRING, text STRING, done BOOLEAN, assignee STRING, due STRING, category STRING, createdAt STRING, updatedAt STRING"


def docx_paragraphs(data: bytes) -> tuple[list[str], bool]:
    """Body paragraphs of a .docx, and whether tables were skipped."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p"):
        out.append("".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else x.text or "" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr")))
    return out, body.find(f"{_W}tbl") is not None


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, paras array<struct<p_start, p_end>>, has_tables, warning) of .txt, .text, .md and .docx files.

    A plain text is one paragraph; a Word paragraph ends with a line end that belongs to none. Another suffix is an error.
    """
    files = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    known = suffix.isin(*TEXT_SUFFIXES, ".docx")
    files = files.withColumn("suffix", F.when(known, suffix).otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), F.col("path")))))

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for name, kind, data in zip(p["path"], p["suffix"], p["content"], strict=True):
                if kind == ".docx":
                    paras, tables = docx_paragraphs(bytes(data))
                    at, marks = 0, []
                    for x in paras:
                        marks.append({"p_start": at, "p_end": at + len(x)})
                        at += len(x) + 1
                    rows.append((name, "".join(x + "\n" for x in paras), marks, tables))
                else:
                    t = bytes(data).decode("utf-8", "replace")
                    rows.append((name, t, [{"p_start": 0, "p_end": len(t)}], False))
            yield pd.DataFrame(rows, columns=["path", "text", "paras", "has_tables"])

    out = files.select("path", "suffix", "content").mapInPandas(parse, "path string, text string, paras array<struct<p_start:int,p_end:int>>, has_tables boolean")
    return out.withColumn("warning", F.when(F.col("has_tables"), "Tables were left out."))


def pcm_samples(raw: bytes, width: int):
    """Whole-number PCM of 1 (unsigned), 2, 3 or 4 bytes a sample, little end first, in [-1, 1)."""
    import numpy as np

    if width == 1:
        return (np.frombuffer(raw, "u1").astype(float) - 128) / 128
    if width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], "u1").reshape(-1, 3).astype("<i4")
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    return np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))


def wav_decoder(data: bytes) -> tuple[int, list[float]]:
    """(rate, samples) of a PCM .wav, channels averaged; others are an error."""
    with wave.open(io.BytesIO(data)) as w:
        x = pcm_samples(w.readframes(w.getnframes()), w.getsampwidth())
        return w.getframerate(), x[: len(x) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(1).astype("float32").tolist()


def read_audio(spark: SparkSession, path: str, decoders: dict[str, Callable[[bytes], tuple[int, list[float]]]] | None = None) -> DataFrame:
    """(path, rate, samples array<float>, duration_s, status): status is `ok`, or why a file could not be read; none is left out.

    .wav is decoded here; decoders by suffix (without the dot) add further formats.
    """
    known = {"wav": wav_decoder, **(decoders or {})}

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for name, data in zip(p["path"], p["content"], strict=True):
                decode = known.get(name.rsplit(".", 1)[-1].lower())
                try:
                    rate, x = decode(bytes(data)) if decode else (None, None)
                    rows.append((name, rate, x, None if x is None else len(x) / rate, "ok" if decode else "no decoder for this format"))
                except (wave.Error, EOFError, ValueError) as why:
                    rows.append((name, None, None, None, f"unreadable: {why}"))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples", "duration_s", "status"]).astype({"rate": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, rate int, samples array<float>, duration_s double, status string")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, samples, duration_s) of the readable files of read_audio."""
    return read_audio(spark, path).where("status = 'ok'").drop("status")


def read_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Every valid *.json job of a folder; files that are no JSON or lack a required field are left out."""
    jobs = spark.read.schema(JOB_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder)
    return jobs.where(" AND ".join(f"{c} IS NOT NULL" for c in ("version", "id", "jobType", "title", "createdAt", "updatedAt")))


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """(version, transcript, speaker_labels, audio_path) of stored projects; a file that is none is an error."""
    raw = spark.read.schema(PROJECT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ok = F.col("version").isNotNull() & F.col("transcript").isNotNull()
    version = F.when(ok, F.col("version")).otherwise(F.raise_error(F.lit("no project file")))
    labels = F.coalesce("speaker_labels", "speakerLabels", F.create_map().cast("map<string,string>"))
    return raw.select(version.alias("version"), "transcript", labels.alias("speaker_labels"), F.coalesce("audio_path", "audioPath").alias("audio_path"))


#: The models on offer, with their kind and size in MB.
MODELS = (
    ("kb-whisper-tiny", "speech", 28), ("kb-whisper-base", "speech", 53), ("kb-whisper-small", "speech", 167), ("kb-whisper-medium", "speech", 514), ("kb-whisper-large", "speech", 1031),
    ("qwen2.5-1.5b", "summary", 1570), ("qwen2.5-3b", "summary", 3133), ("qwen2.5-7b", "summary", 8100),
)


def model_catalogue(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(id, kind, size_mb, downloaded): downloaded if the folder has a file whose name begins with the id."""
    models = spark.createDataFrame(list(MODELS), "id string, kind string, size_mb int")
    if folder is None:
        return models.withColumn("downloaded", F.lit(False))
    ids = F.array(*[F.lit(m[0]) for m in MODELS])
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"))
    have = names.select(F.explode(F.filter(ids, lambda m: F.col("file").startswith(m))).alias("id")).distinct().withColumn("downloaded", F.lit(True))
    return models.join(have, "id", "left").withColumn("downloaded", F.coalesce("downloaded", F.lit(False)))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The task store; a missing or broken file is an empty one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], TASK_SCHEMA)
    return spark.read.schema(TASK_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term) of a list with one on each line; blank lines and lines that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> '' AND NOT startswith(term, '#')")


def decoded_recordings(rows: DataFrame) -> DataFrame:
    """(id, payload) in base64 to (id, wav); empty payloads and bare 44-byte headers are left out."""
    return rows.select("id", F.unbase64("payload").alias("wav")).where(F.octet_length("wav") > 44)


def encoded_recordings(rows: DataFrame) -> DataFrame:
    """(id, seq, samples) pieces of recordings to (id, samples, payload): joined in order, and their 32-bit floats in base64."""
    whole = rows.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "samples"))), lambda x: x.samples)).alias("samples"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            yield pd.DataFrame({"id": p["id"], "samples": p["samples"], "raw": [np.asarray(x, dtype="<f4").tobytes() for x in p["samples"]]})

    kind = rows.schema["id"].dataType.simpleString()
    return whole.mapInPandas(run, f"id {kind}, samples array<double>, raw binary").select("id", "samples", F.base64("raw").alias("payload"))
