"""Shared pieces of the training-data operators: scratch tables, word hashing, guarded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere: runs of anything but these six ASCII white-space bytes. bytes.split() cuts at exactly these.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Stands for a null id inside joins and orderings; results show null again. So a row of this very id counts as one without.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or one of our own where that is unset on a single machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="murmurlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_scratch: list[str] = []


def scratch_mark() -> int:
    """How many scratch tables there are, for release()."""
    return len(_scratch)


def release(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the scratch tables written after scratch_mark() gave `since`, but for those that `keep` reads."""
    used = "\n".join(keep.inputFiles())
    for path in _scratch[since:]:
        if path.rsplit("/", 1)[1] not in used:
            hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
            _scratch.remove(path)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df once as a table in the shared folder and read it back.

    The files outlive any executor, are compressed and can be read by column. They go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append(path)
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in Arrow batches of at most `rows` rows where the session has Spark's default of 10,000; a session that
    has set another number keeps it. Results do not depend on it.

    Batches of long texts are what a worker's memory goes to; workers are reused and keep the most that they ever held.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def guarded_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = 50_000) -> DataFrame:
    """Broadcast `small` only when its counted rows stay within max_rows; beyond that a shuffled join that AQE can split.

    `small` is counted here, so pass a written table or something cheap.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number of short ones."""

    def __init__(self, seed: int = 0, most: int = 200_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < self.most and len(word) <= 48:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring items (k >= 1, len(h) >= k), by doubling: O(n log k)."""
    n, out, have, step, part = len(h), None, 0, 1, mix64(h)
    salt = np.uint64(0x9E3779B97F4A7C15)
    while True:
        if k & step:
            take = part[have : have + n - k + 1]
            out = take.copy() if out is None else mix64(out * np.uint64(0xD6E8FEB86659FD93) + take + salt)
            have += step
        if have == k:
            return out
        part = mix64(part[:-step] * np.uint64(0xA0761D6478BD642F) + part[step:] + np.uint64(step))
        step *= 2


def text_bytes(col: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns, whatever their names, stay out of the work."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def by_bytes(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `most` bytes (one text at least)."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
