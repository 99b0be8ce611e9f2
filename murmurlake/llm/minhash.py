"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch of a shingle set with t coordinates: in round i each element falls into one hashed coordinate with a hashed value;
a coordinate keeps the least (round, value). Rounds go on until all are filled; from round t on, round t + c throws every
element into coordinate c, so filling is certain. Coordinates of two sets agree with probability equal to their Jaccard
similarity, with concentration as for t independent values, for a cost of O(t log t + n) instead of O(t n).

Equal sets are one node. Nodes that share a band are candidates; what counts as a link is decided on full sets. Within a
bucket every member is first compared with the smallest one; only buckets that this leaves in several components are then
compared in blocks of bounded size, member by member across components. So a group of n near copies costs about n comparisons, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, WordHashes, gram_hashes, guarded_join, mix64, small_batches, text_bytes, written
from .components import components

_ROUND = np.uint64(55)


def shingles(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of k words; fewer words are one run; no words, no run."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashes.of(words)
    return np.unique(gram_hashes(h, min(k, len(h))))


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates, each (round << 55) + value."""
    out = np.full(t, np.uint64(2**64 - 1), dtype=np.uint64)
    n, done = len(elements), 0
    at_once = int(min(t, np.ceil(1.25 * t * (np.log(t) + 1) / n)))
    while done < t and (out == np.uint64(2**64 - 1)).any():
        rounds = np.arange(done, min(t, done + at_once), dtype=np.uint64)
        h = mix64((elements[None, :] ^ mix64(rounds * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[:, None]).ravel())
        value = (np.repeat(rounds, n) << _ROUND) | (mix64(h + np.uint64(7)) >> np.uint64(9))
        np.minimum.at(out, (h % np.uint64(t)).astype(np.int64), value)
        done += at_once
        at_once = max(1, at_once // 4)
    for c in np.flatnonzero(out == np.uint64(2**64 - 1)):
        r = np.uint64(t + int(c))
        out[c] = (r << _ROUND) | (mix64(elements ^ mix64(np.array([r * np.uint64(0x9E3779B9) + np.uint64(1)])))).min() >> np.uint64(9)
    return out


def band_keys(coords: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of neighbouring coordinates."""
    rows = coords.reshape(bands, -1)
    key = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for c in range(rows.shape[1]):
        key = mix64(key ^ rows[:, c])
    return key


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(np.concatenate(parts)) if parts else np.empty(0, np.int64)))


def sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, k1, k2, keys) for each row: set size, a 128-bit hash of the set, band keys (none for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                size, k1, k2, keys = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text.lower().split(), k, hashes)
                    size.append(len(s))
                    place = np.arange(1, len(s) + 1, dtype=np.uint64)
                    k1.append(np.bitwise_xor.reduce(mix64(s + place)) if len(s) else np.uint64(0))
                    k2.append((mix64(s ^ np.uint64(0x5851F42D4C957F2D)) * (place | np.uint64(1))).sum(dtype=np.uint64) if len(s) else np.uint64(0))
                    keys.append(band_keys(sketch(s, bands * rows), bands) if len(s) else s)
                longs = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), longs(k1), longs(k2), _lists(keys)], ["id", "n_shingles", "k1", "k2", "keys"])

    return docs.mapInArrow(run, "id long, n_shingles long, k1 long, k2 long, keys array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, items): all shingle hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingles(t.lower().split(), k, hashes) for t in part.column(1).to_pylist()])], ["id", "items"])

    return docs.mapInArrow(run, "id long, items array<long>")


def linked_across(comps: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Positions (x, y) of links that join different components: enough of them to connect all that are linked.

    Members of the largest component are no queries: a pair with one of them is found from its other side. Each query counts
    its common elements with all members in one pass over an index of the group's elements.
    """
    n = len(sets)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[int, int] = {}
    for i, c in enumerate(comps):
        parent[i] = first.setdefault(c, i)
    sizes = np.array([len(s) for s in sets])
    ids, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    count: dict[int, int] = {}
    for c in comps:
        count[c] = count.get(c, 0) + 1
    largest = max(count, key=lambda c: (count[c], -c))
    mark = np.zeros(len(ids), dtype=np.int32)
    out = []
    for x in range(n):
        if comps[x] == largest:
            continue
        own = place[starts[x] : starts[x] + sizes[x]]
        mark[own] = 1
        common = np.add.reduceat(mark[place], starts)
        mark[own] = 0
        for y in np.flatnonzero(den * common >= num * (sizes + sizes[x] - common)):
            a, b = root(x), root(int(y))
            if a != b:
                parent[b] = a
                out.append((x, int(y)))
    return out


def blocks_linked(members: DataFrame, num: int, den: int) -> DataFrame:
    """members (g, id, comp, items), all rows of a g in one place: links (a, b) across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        current = None

        def flush() -> Iterator[pa.RecordBatch]:
            if len({c for _, c, _ in held}) > 1:
                found = linked_across([c for _, c, _ in held], [s for _, _, s in held], num, den)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([held[x][0] for x, _ in found], pa.int64()), pa.array([held[y][0] for _, y in found], pa.int64())], ["a", "b"])

        for b in batches:
            items = b.column(3)
            values, offsets = items.values.to_numpy(), items.offsets.to_numpy()
            for i, (g, node, comp) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if g != current:
                    yield from flush()
                    held, current = [], g
                held.append((node, comp, values[offsets[i] : offsets[i + 1]].copy()))
        yield from flush()

    return members.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100), bands: int = 40, rows: int = 6, block: int = 2_000_000, id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    Texts are lower-cased (A-Z only) and cut into words at ASCII white space; a set is the distinct runs of k words. Rows are
    linked if 100 times the common size is at least 80 times the joint size. component_id is the smallest id that links
    reach, kept marks rows whose id it is. Null or empty texts and texts without words have empty sets and no links. Rows
    that repeat an id are one node; a null id is a node of its own kind, below all others, shown as null again.

    A pair of similarity 0.8 shares no band of 40 x 6 with a probability of 5e-6; no bucket is capped. block: shingles of the members
    of a bucket that are compared in one place; larger buckets are dealt to pairs of blocks. Ids are integers. Further columns are left
    out; empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    num, den = similarity
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"), text_bytes().alias("b"))
    seen = written(sketched(base, k, bands, rows))
    full = seen.where("n_shingles > 0")
    reps = written(full.groupBy("k1", "k2").agg(F.min("id").alias("rep")))
    banded = full.join(reps.select(F.col("rep").alias("id"), "k1", "k2"), ["id", "k1", "k2"], "left_semi").select("id", "n_shingles", F.explode("keys").alias("key"))
    multi = banded.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("n")).where("leader < last").drop("last")
    members = written(banded.join(multi, "key"))

    pairs = written(members.where("id <> leader").select("id", "leader").distinct())
    needed = written(pairs.select("id").union(pairs.select("leader")).distinct())
    sets = written(full_sets(guarded_join(base, needed, ["id"], "left_semi", max_rows=200_000), k))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(sets.select("id", F.col("items").alias("x")), "id").join(sets.select(F.col("id").alias("leader"), F.col("items").alias("y")), "leader")
    near = both.withColumn("common", common).where(den * F.col("common") >= num * (F.size("x") + F.size("y") - F.col("common")))
    links = written(near.select(F.col("id").alias("a"), F.col("leader").alias("b")))

    now = written(components(links))
    label = members.where("n > 2").join(now.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    label = written(label.select("key", "id", "comp", "n_shingles"))
    mixed = label.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n"), F.sum("n_shingles").alias("items"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("same")).where("c0 < c1")
    mixed = mixed.groupBy("n", "same", "items").agg(F.min("key").alias("key"))  # bands with the same members once
    left = written(label.drop("n_shingles").join(mixed, "key").withColumn("parts", F.ceil(F.col("items") / block).cast("int")))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    spread = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "id", "comp")
    more = blocks_linked(spread.join(sets, "id").select("g", "id", "comp", "items"), num, den)
    more = written(more)
    if not more.isEmpty():
        now = written(components(links.union(more)))

    named = reps.join(now.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = seen.select("id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(shown("id").alias(id_col), "n_shingles", shown("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
