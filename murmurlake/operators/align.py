"""Who spoke when: interval joins, speaker numbering, merging of sources, echo removal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens


def interval_join(left: DataFrame, right: DataFrame, key: str, width: float = 30.0, slack: float = 0.0) -> DataFrame:
    """Pairs with l_start < r_end + slack and r_start < l_end + slack within a key, by an equi-join on time buckets.

    left has l_start, l_end; right r_start, r_end. Both sides go to every bucket that they touch; a pair counts in the bucket
    of the later of its two starts only. Rows without length meet nothing.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor((s - slack) / width).cast("long"), F.floor((e + slack) / width).cast("long")))
    a = left.withColumn("cell", cells(F.col("l_start"), F.col("l_end")))
    b = right.withColumn("cell", cells(F.col("r_start"), F.col("r_end")))
    near = (F.col("l_start") < F.col("r_end") + slack) & (F.col("r_start") < F.col("l_end") + slack)
    once = F.floor((F.greatest("l_start", "r_start") - slack) / width).cast("long") == F.col("cell")
    return a.join(b, [key, "cell"]).where(near & once).drop("cell")


def dominant_speaker(segments: DataFrame, turns: DataFrame, key: str = "meeting_id") -> DataFrame:
    """segments (key, idx, start, end, ...) plus cluster: the one with the most overlap, the lowest on ties, null without any."""
    left = segments.select(key, "idx", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = turns.select(key, F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("speaker").alias("cluster"))
    each = interval_join(left, right, key).groupBy(key, "idx", "cluster").agg(F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("overlap")).where("overlap > 0")
    best = each.groupBy(key, "idx").agg(F.max_by("cluster", F.struct("overlap", -F.col("cluster"))).alias("cluster"))
    return segments.join(best, [key, "idx"], "left")


def numbered_speakers(rows: DataFrame, key: str = "meeting_id", only: str | None = None) -> DataFrame:
    """cluster to `speaker` TALARE_n by first appearance; with `only`, just rows whose speaker is that label change."""
    pick = F.col("cluster").isNotNull() & (F.lit(True) if only is None else F.col("speaker") == only)
    first = F.min(F.when(pick, F.col("idx"))).over(Window.partitionBy(key, F.when(pick, F.col("cluster"))))
    rows = rows.withColumn("_first", F.when(pick, first))
    name = F.concat(F.lit("TALARE_"), F.dense_rank().over(Window.partitionBy(key).orderBy(F.col("_first").asc_nulls_last())).cast("string"))
    other = F.lit(None).cast("string") if only is None else F.col("speaker")
    return rows.withColumn("speaker", F.when(F.col("_first").isNotNull(), name).otherwise(other)).drop("_first")


def merged_timeline(mic: DataFrame, meeting: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Both sources in order of start, microphone first on ties, each in its own order: idx numbers the result."""
    both = mic.withColumns({"speaker": F.lit("Jag"), "_src": F.lit(0)}).unionByName(meeting.withColumns({"speaker": F.lit("Mötet"), "_src": F.lit(1)}))
    return both.withColumn("idx", (F.row_number().over(Window.partitionBy(key).orderBy("start", "_src", "idx")) - 1).cast("int")).drop("_src")


def contained_share(a: Column, b: Column) -> Column:
    """The share of a's tokens, repeats counted, that b has; 0 for none."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a))


def without_echo(rows: DataFrame, key: str = "meeting_id", own: str = "Jag", other: str = "Mötet", share: float = 0.7, least: int = 4, slack: float = 3.0) -> DataFrame:
    """Rows of `own` with four tokens or more go if a near row of `other` contains 70 % of them."""
    mine = rows.where(F.col("speaker") == own).select(key, "idx", F.col("start").alias("l_start"), F.col("end").alias("l_end"), tokens(F.col("text")).alias("a")).where(F.size("a") >= least)
    theirs = rows.where(F.col("speaker") == other).select(key, F.col("start").alias("r_start"), F.col("end").alias("r_end"), tokens(F.col("text")).alias("b"))
    echo = interval_join(mine, theirs, key, slack=slack).where(contained_share(F.col("a"), F.col("b")) >= share).select(key, "idx").distinct()
    return rows.join(echo, [key, "idx"], "left_anti")


def active_at(rows: DataFrame, times: DataFrame, key: str = "meeting_id") -> DataFrame:
    """times (key, t) plus active: the first row with start <= t < end, -1 for none."""
    points = times.select(key, F.col("t"), F.col("t").alias("l_start"), F.col("t").alias("l_end")).distinct()
    spans = rows.select(key, "idx", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / 30.0).cast("long"), F.floor(e / 30.0).cast("long")))
    hit = points.withColumn("cell", F.floor(F.col("t") / 30.0).cast("long")).join(spans.withColumn("cell", cells(F.col("r_start"), F.col("r_end"))), [key, "cell"]).where("r_start <= t AND t < r_end")
    return times.join(hit.groupBy(key, "t").agg(F.min("idx").alias("active")), [key, "t"], "left").withColumn("active", F.coalesce("active", F.lit(-1)))


def speakers(rows: DataFrame, key: str = "meeting_id") -> DataFrame:
    """(key, ord, speaker): distinct speakers by first appearance."""
    first = rows.where("speaker IS NOT NULL").groupBy(key, "speaker").agg(F.min("idx").alias("_i"))
    return first.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_i")) - 1).alias("ord"), "speaker")


def speaker_groups(rows: DataFrame, key: str = "meeting_id") -> DataFrame:
    """rows plus grp: number of the stretch of neighbouring rows with one speaker; null is a speaker like any other."""
    w = Window.partitionBy(key).orderBy("idx")
    new = (F.row_number().over(w) == 1) | ~F.lag("speaker").over(w).eqNullSafe(F.col("speaker"))
    return rows.withColumn("_new", new.cast("int")).withColumn("grp", F.sum("_new").over(w) - 1).drop("_new")


def default_label(speaker: Column) -> Column:
    return F.regexp_replace(speaker, r"^TALARE_(\d+)$", "Talare $1")


def without_speakers(rows: DataFrame) -> DataFrame:
    return rows.withColumn("speaker", F.lit(None).cast("string"))


def rebased(segments: DataFrame, chunks: DataFrame, key: str = "meeting_id") -> DataFrame:
    """segments (key, chunk, start, end, ...) on the recording's clock: the start of their chunk (key, chunk, start_s) added."""
    rows = segments.join(chunks.select(key, "chunk", "start_s"), [key, "chunk"])
    return rows.withColumns({"start": F.col("start") + F.col("start_s"), "end": F.col("end") + F.col("start_s")}).drop("start_s")


def active_word(words: DataFrame, times: DataFrame, key: str = "meeting_id") -> DataFrame:
    """times (key, t) with each word (key, idx, words array<struct<start, end, text>>) that is spoken then: (key, t, idx, pos, word).

    Several words may be; a time without any has no row."""
    each = words.select(key, "idx", F.posexplode("words").alias("pos", "w")).select(key, "idx", "pos", F.col("w.text").alias("word"), F.col("w.start").alias("r_start"), F.col("w.end").alias("r_end"))
    cells = F.explode(F.sequence(F.floor(F.col("r_start") / 30.0).cast("long"), F.floor(F.greatest("r_start", "r_end") / 30.0).cast("long")))
    points = times.select(key, "t").distinct().withColumn("cell", F.floor(F.col("t") / 30.0).cast("long"))
    return points.join(each.withColumn("cell", cells), [key, "cell"]).where("r_start <= t AND t < r_end").select(key, "t", "idx", "pos", "word")


def diarised(recordings: DataFrame, cluster: Callable[[np.ndarray, int], list[tuple[float, float, int]]] | None = None, key: str = "meeting_id") -> DataFrame:
    """recordings (key, samples, rate) to turns (key, start, end, speaker) from a pluggable clusterer, by start; a negative cluster is
    cluster 0. Without one a stub that hears a new voice where loudness changes. A recording is one row."""
    voices = cluster or loudness_stub

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, s, e, max(c, 0)) for k, x, r in zip(p[key], p["samples"], p["rate"], strict=True) for s, e, c in sorted(voices(np.asarray(x, dtype=float), int(r)))]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "speaker"])

    kind = recordings.schema[key].dataType.simpleString()
    return recordings.select(key, "samples", "rate").mapInPandas(run, f"{key} {kind}, start double, end double, speaker int")


#: Seconds below which speech and pauses do not count.
MIN_ON_S, MIN_OFF_S = 0.3, 0.5


def loudness_stub(x: np.ndarray, rate: int, frame_s: float = 0.1, quiet: float = 0.01) -> list[tuple[float, float, int]]:
    """Stretches of loud frames as turns: pauses under MIN_OFF_S are closed, turns under MIN_ON_S go; cluster 1 is louder than 0.3."""
    n = max(1, int(frame_s * rate))
    levels = [float(np.abs(x[i : i + n]).max(initial=0.0)) for i in range(0, len(x), n)]
    turns: list[list[float]] = []
    for i, level in enumerate(levels):
        if level > quiet:
            if turns and i * frame_s - turns[-1][1] < MIN_OFF_S - 1e-9:
                turns[-1][1:] = [(i + 1) * frame_s, max(turns[-1][2], level)]
            else:
                turns.append([i * frame_s, (i + 1) * frame_s, level])
    return [(s, e, int(level > 0.3)) for s, e, level in turns if e - s >= MIN_ON_S - 1e-9]
