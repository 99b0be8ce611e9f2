"""Recogniser output to timed rows: torn characters, words from tokens, blank segments; catalogues of profiles and templates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import tail_bytes

#: Which categories a profile masks, and the headings of the summary templates.
IDENTITY = ("person", "personnummer", "telefon", "epost", "ip_adress", "url", "plats", "organisation", "egen", "ovrigt")
PROFILES = {"allman": IDENTITY, "skola": (*IDENTITY, "diagnos", "medicin"), "social": (*IDENTITY, "diagnos", "medicin", "handelse"), "allt": None}
TEMPLATES = {
    "protokoll": ("Mötesprotokoll", ("Deltagare", "Dagordning", "Diskussion", "Beslut", "Åtgärder (vem – vad – när)", "Övrigt")),
    "sammanfattning": ("Kort sammanfattning", ("Sammanfattning", "Viktigaste punkter")),
    "actions": ("Endast åtgärder & beslut", ("Beslut", "Åtgärder")),
}


def profiles(spark: SparkSession, all_categories: tuple[str, ...]) -> DataFrame:
    """(profile, category): what each profile masks."""
    rows = [(p, c) for p, cats in PROFILES.items() for c in (all_categories if cats is None else cats)]
    return spark.createDataFrame(rows, "profile string, category string")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, label, list(h)) for k, (label, h) in TEMPLATES.items()], "id string, label string, headings array<string>")


def joined_bytes(parts: list[bytes]) -> list[bytes]:
    """Continuation bytes at a part's beginning go back to the part that they complete."""
    out = [bytes(p) for p in parts]
    for i in range(1, len(out)):
        n = 0
        for b in out[i][: tail_bytes(out[i - 1])]:
            if b & 0xC0 != 0x80:
                break
            n += 1
        out[i - 1], out[i] = out[i - 1] + out[i][:n], out[i][n:]
    return out


def mended_segments(segments: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, idx, t0, t1 in hundredths, bytes) to (key, idx, start, end, text): mended, trimmed, blank ones left out."""

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        texts = [b.decode("utf-8", "replace").strip() for b in joined_bytes(list(part["bytes"]))]
        return pd.DataFrame({key: group[0], "idx": part["idx"].to_numpy(), "start": part["t0"].to_numpy() / 100.0, "end": part["t1"].to_numpy() / 100.0, "text": texts})

    kind = segments.schema[key].dataType.simpleString()
    return segments.groupBy(key).applyInPandas(run, f"{key} {kind}, idx int, start double, end double, text string").where("text <> ''")


def words_of(tokens: list[tuple[float, float, bytes]]) -> list[tuple[float, float, str]]:
    """Timed tokens to words. A token with a leading blank, or the first one, opens a word; markers are skipped; a byte that
    continues a character never opens one."""
    words: list[list] = []
    for start, end, data in tokens:
        if not data or data[:2] == b"[_":
            continue
        inside = data[0] & 0xC0 == 0x80
        if not inside and (not words or data[:1] == b" "):
            if piece := data.lstrip(b" \t\n\x0c\r"):
                words.append([start, end, piece])
        elif words:
            words[-1][1], words[-1][2] = end, words[-1][2] + data
    return [(s, e, b.decode("utf-8", "replace")) for s, e, b in words]


def assembled_words(tokens: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, idx, ord, t0, t1, bytes) to (key, idx, words): an Arrow batch holds whole segments, each a short list."""
    each = tokens.groupBy(key, "idx").agg(F.array_sort(F.collect_list(F.struct("ord", "t0", "t1", "bytes"))).alias("tokens"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            words = [[{"start": s, "end": e, "text": t} for s, e, t in words_of([(x["t0"] / 100.0, x["t1"] / 100.0, bytes(x["bytes"])) for x in ts])] for ts in p["tokens"]]
            yield pd.DataFrame({key: p[key], "idx": p["idx"], "words": words})

    kind = tokens.schema[key].dataType.simpleString()
    return each.mapInPandas(run, f"{key} {kind}, idx int, words array<struct<start:double,end:double,text:string>>")


def seeded_participants(speakers: DataFrame, participants: DataFrame, key: str = "meeting_id") -> DataFrame:
    """speakers (key, ord, name) that no participant (key, name) has, whatever the case; the first spelling of each."""
    new = speakers.withColumn("_n", F.lower(F.trim("name"))).where("_n <> ''")
    have = participants.select(key, F.lower(F.trim("name")).alias("_n"))
    return new.join(have, [key, "_n"], "left_anti").groupBy(key, "_n").agg(F.min_by(F.trim("name"), "ord").alias("name"), F.min("ord").alias("ord")).drop("_n")


def own_terms(lines: DataFrame, text: str = "value") -> DataFrame:
    """(term): entries between line ends, commas and semicolons, trimmed, distinct, in Swedish order."""
    each = lines.select(F.explode(F.split(text, r"[\n,;]+")).alias("term")).select(F.trim("term").alias("term")).where("term <> ''").distinct()
    return each.orderBy(F.collate("term", "sv"))


def silence_stub(samples: np.ndarray, rate: int, language: str, translate: bool) -> list[tuple[int, int, bytes]]:
    """Stands for a recogniser where no weights are at hand: one segment over the whole, in hundredths of a second."""
    return [(0, int(len(samples) * 100 / rate), f"{language}{' en' if translate else ''} {len(samples)}".encode())] if len(samples) else []


def transcribed(recordings: DataFrame, recognise: Callable[[np.ndarray, int, str, bool], list[tuple[int, int, bytes]]] = silence_stub, language: str = "auto", translate: bool = False, key: str = "meeting_id") -> DataFrame:
    """recordings (key, samples, rate) to (key, idx, start, end, text): a pluggable recogniser's segments, torn characters mended, blank
    ones left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, i, *x) for k, s, r in zip(p[key], p["samples"], p["rate"], strict=True) for i, x in enumerate(recognise(np.asarray(s), int(r), language, translate))]
            yield pd.DataFrame(rows, columns=[key, "idx", "t0", "t1", "bytes"])

    kind = recordings.schema[key].dataType.simpleString()
    return mended_segments(recordings.select(key, "samples", "rate").mapInPandas(run, f"{key} {kind}, idx int, t0 int, t1 int, bytes binary"), key)
