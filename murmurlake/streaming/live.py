"""Content-defined chunks of live signals: one state for each source, cut at the quietest frame, silence dropped.

Rows in: (source STRING, start_s DOUBLE, samples ARRAY<DOUBLE>, rate INT), ordered by start within a source. Rows out: (source, start_s, samples).
The same chunker runs in a stream and over a table, so that a late or failed stream can be made good by the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds after which a chunk is cut at its quietest frame, the least and the most seconds, and the frame.
TARGET_S, LEAST_S, MOST_S, FRAME_S = 6.0, 2.5, 11.0, 0.03
SILENCE, FLUSH_S, GAP_MOST_S = 0.015, 1.0, 30.0
#: Samples that go to Python, or come from it, at once: longer pieces pass the chunker in slices.
SLICE = 1 << 20
OUT = "source string, start_s double, samples array<double>"
STATE = "start_s double, rate int, buffer array<double>"


def cut_point(x: np.ndarray, rate: int) -> int | None:
    """Where to cut a buffer: at the most length if it has that, else at the beginning of the quietest frame after the least length;
    None to wait."""
    if len(x) < int(TARGET_S * rate):
        return None
    most, first, frame = int(MOST_S * rate), int(LEAST_S * rate), max(1, int(FRAME_S * rate))
    if len(x) >= most:
        return most
    whole = x[first:]
    n = len(whole) // frame
    if not n:
        return len(x)
    levels = np.square(whole[: n * frame]).reshape(n, frame).mean(1)
    return first + int(np.argmin(levels)) * frame


class Chunker:
    """Buffer and clock of one source. Downtime up to 30 s becomes silence, so that the clock keeps to the source's own."""

    def __init__(self, start_s: float = 0.0, rate: int = 0, buffer=()):
        self.start_s, self.rate, self.buffer = start_s, rate, np.asarray(buffer, dtype=float)

    def push(self, start_s: float, samples, rate: int, opens: bool = True, ends: bool = True) -> list[tuple[float, np.ndarray]]:
        """Chunks of a piece, or of a slice of one: only its first slice can follow a gap, and before its last only cuts at the most length are sure."""
        if not self.rate:
            self.start_s, self.rate = start_s, rate
        gap = start_s - (self.start_s + len(self.buffer) / self.rate) if opens else 0.0
        silence = np.zeros(int(round(min(max(gap, 0.0), GAP_MOST_S) * self.rate)))
        self.buffer = np.concatenate((self.buffer, silence, np.asarray(samples, dtype=float)))
        out = []
        most = int(MOST_S * self.rate)
        while (ends or len(self.buffer) >= most) and (at := cut_point(self.buffer, self.rate)) is not None:
            out += self._emit(at)
        return out

    def flush(self) -> list[tuple[float, np.ndarray]]:
        return self._emit(len(self.buffer)) if self.rate and len(self.buffer) >= FLUSH_S * self.rate else []

    def _emit(self, n: int) -> list[tuple[float, np.ndarray]]:
        part, at = self.buffer[:n], self.start_s
        self.buffer, self.start_s = self.buffer[n:], self.start_s + n / self.rate
        return [(at, part)] if np.abs(part).max(initial=0.0) > SILENCE else []


def _frame(source: str, found: list[tuple[float, np.ndarray]]) -> pd.DataFrame:
    return _frames([(source, *y) for y in found])


def live_chunks(stream: DataFrame, idle_ms: int = 10_000) -> DataFrame:
    """Chunks of a stream as they fill; what is left is flushed after idle_ms without rows."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Chunker(*state.get) if state.exists else Chunker()
        if state.hasTimedOut:
            yield _frame(key[0], c.flush())
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("start_s")
        found = [y for r in rows.itertuples() for y in c.push(r.start_s, r.samples, r.rate)]
        state.update((c.start_s, c.rate, c.buffer.tolist()))
        state.setTimeoutDuration(idle_ms)
        yield _frame(key[0], found)

    return stream.groupBy("source").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def batch_chunks(rows: DataFrame, flush: bool = True) -> DataFrame:
    """The same over a table: a source's rows pass its chunker in order of start, a slice at a time; what a task holds is one buffer.

    Rows may be slices of pieces already: with (piece, at, ends) besides, which tell pieces of equal start apart, order the slices of a
    piece, and mark its last one.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, c, opens = None, None, True
        found: list[tuple[str, float, np.ndarray]] = []
        held = 0
        for p in parts:
            for r in p.itertuples():
                if c is None or r.source != source:
                    found += [(source, *y) for y in (c.flush() if c is not None and flush else [])]
                    source, c, opens = r.source, Chunker(), True
                found += [(source, *y) for y in c.push(r.start_s, r.samples, r.rate, opens, r.ends)]
                opens = r.ends
                held += len(r.samples)
                if held >= SLICE:
                    yield _frames(found)
                    found, held = [], 0
        if c is not None and flush:
            found += [(source, *y) for y in c.flush()]
        yield _frames(found)

    slices = rows if "ends" in rows.columns else _slices(rows)
    order = ("source", "start_s", "piece", "at")
    return slices.select(*order, "samples", "rate", "ends").repartition("source").sortWithinPartitions(*order).mapInPandas(run, OUT)


def _slices(rows: DataFrame) -> DataFrame:
    """Pieces as slices of SLICE samples at most; an empty one is a slice."""
    ats = rows.select("source", "start_s", "samples", "rate", F.monotonically_increasing_id().alias("piece")).withColumn("at", F.explode(F.expr(f"sequence(0, greatest(size(samples) - 1, 0), {SLICE})")))
    return ats.select("source", "start_s", "piece", "at", F.slice("samples", F.col("at") + 1, SLICE).alias("samples"), "rate", (F.col("at") + SLICE >= F.size("samples")).alias("ends"))


def _frames(found: list[tuple[str, float, np.ndarray]]) -> pd.DataFrame:
    """Columns of objects where nothing is found: Arrow makes no arrays of the numbers that pandas takes empty columns for."""
    return pd.DataFrame([(source, at, x.tolist()) for source, at, x in found], columns=["source", "start_s", "samples"])


def both_sources(mic: DataFrame, meeting: DataFrame) -> DataFrame:
    """Two streams or tables (start_s, samples, rate) as one, tagged by source."""
    tagged = lambda df, name: df.select(F.lit(name).alias("source"), F.col("start_s").cast("double").alias("start_s"), F.col("samples").cast("array<double>").alias("samples"), F.col("rate").cast("int").alias("rate"))
    return tagged(mic, "mic").unionByName(tagged(meeting, "meeting"))


def read_capture(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """A stream of captured pieces: Parquet files of (source, start_s, samples, rate) as they arrive in a folder."""
    reader = spark.readStream.schema("source string, start_s double, samples array<double>, rate int")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def recognised(chunks: DataFrame, recognise: Callable[[np.ndarray], list[tuple[float, float, str]]]) -> DataFrame:
    """chunks (source, start_s, samples) to (source, chunk_start_s, start, end, text, failed): segments on the recording's own clock.

    A chunk that the recogniser fails on is skipped: one row that says so, without times and text.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.itertuples():
                try:
                    rows += [(r.source, r.start_s, r.start_s + s, r.start_s + e, t, False) for s, e, t in recognise(np.asarray(r.samples))]
                except Exception:  # noqa: BLE001  a failing recogniser must not end the stream
                    rows.append((r.source, r.start_s, None, None, None, True))
            yield pd.DataFrame(rows, columns=["source", "chunk_start_s", "start", "end", "text", "failed"])

    return chunks.mapInPandas(run, "source string, chunk_start_s double, start double, end double, text string, failed boolean")


def energy_stub(samples: np.ndarray, each: int = 100) -> list[tuple[float, float, str]]:
    """Stands for a recogniser where no weights are at hand: one segment for the chunk, its text the number of loud frames."""
    loud = int((np.abs(samples[: len(samples) // each * each]).reshape(-1, each).max(1, initial=0.0) > SILENCE).sum()) if len(samples) >= each else 0
    return [(0.0, len(samples) / each, f"{loud} loud")]


def finalised(live: DataFrame, captured: DataFrame, recognise: Callable, behind_s: float, grace_s: float = 10.0) -> DataFrame:
    """The recording's segments at its stop: those heard live, or, if the live path is still more than grace_s behind then, all anew from
    what was captured, in one batch. Failed chunks are left out; rows are (source, start, end, text)."""
    rows = live if behind_s <= grace_s else recognised(batch_chunks(captured), recognise)
    return rows.where("NOT failed").select("source", "start", "end", "text")


def stop_figures(captured: DataFrame) -> DataFrame:
    """(duration_s, mic_s, meeting_s) of a recording: each source's last sample, and the longer of the two."""
    end = F.col("start_s") + F.size("samples") / F.col("rate")
    of = lambda name: F.coalesce(F.max(F.when(F.col("source") == name, end)), F.lit(0.0))
    return captured.agg(F.greatest(of("mic"), of("meeting")).alias("duration_s"), of("mic").alias("mic_s"), of("meeting").alias("meeting_s"))


def pending_stubs(meetings: DataFrame) -> DataFrame:
    """meetings (id, title, audio_path, created_at) as stored jobs whose transcription is pending: written at the stop, replaced by id when done."""
    return meetings.select("id", "title", "audio_path", F.col("created_at"), F.col("created_at").alias("updated_at"), F.lit(True).alias("transcription_pending"), F.lit(None).cast("string").alias("transcript"))


def recovered(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """jobs with the transcript of `done` (id, transcript, updated_at), no longer pending; applying it again changes nothing."""
    new = done.select("id", F.col("transcript").alias("_t"), F.col("updated_at").alias("_u"))
    rows = jobs.join(new, "id", "left")
    got = F.col("_t").isNotNull()
    return rows.withColumns({"transcript": F.coalesce("_t", "transcript"), "updated_at": F.when(got, F.coalesce("_u", "updated_at")).otherwise(F.col("updated_at")), "transcription_pending": F.col("transcription_pending") & ~got}).select(*jobs.columns)


def lagging(progress: DataFrame, most_s: float = 30.0) -> DataFrame:
    """progress (source, processed_s, event_s): the first time each source's processing trails its events by more."""
    late = progress.where(F.col("event_s") - F.col("processed_s") > most_s)
    return late.groupBy("source").agg(F.min("event_s").alias("first_late_s"))


def lag_warnings(stream: DataFrame, most_s: float = 30.0) -> DataFrame:
    """stream (source, start_s, now_s) to one warning (source, start_s, late_s) for each source, the first time that it is late by more."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("start_s")
        late = rows[rows.now_s - rows.start_s > most_s]
        if state.exists or not len(late):
            return
        state.update((True,))
        first = late.iloc[0]
        yield pd.DataFrame({"source": [key[0]], "start_s": [first.start_s], "late_s": [first.now_s - first.start_s]})

    return stream.groupBy("source").applyInPandasWithState(step, "source string, start_s double, late_s double", "warned boolean", "append", GroupStateTimeout.NoTimeout)
