"""Repeated passages by prefix-partitioned suffix trees over words.

Suffixes are truncated at `window` words, for whether a window repeats is decided at that depth of the tree of all suffixes. The
tree is never built as a whole:

1. Fragments. Neighbouring windows whose least hash of `k` words is the same one are a fragment of the text, about one in twenty
   words. Equal windows have equal such hashes, so fragments whose hash one document alone has cannot hold a repeat and go. Equal
   fragments are one; they are the branch of the tree that their documents share, and the least of these keeps it.
2. Prefixes. The suffixes that begin in the fragments left are counted by their first words, all but 16 of the window. A prefix that
   one document alone has goes. A prefix with more than `most` suffixes is lengthened by 8, by 12, in the end to the whole window, so that every group either fits in memory or is itself a node at full depth, which takes an aggregate and no list.
3. Subtrees. A group's suffixes are sorted by the words after their prefix; the depths at which neighbours part are the tree's inner
   nodes. Below a node of depth `window` or more stand the occurrences of one repeat, of which the smallest document is kept.
4. Windows whose smallest document is a smaller one are removed, on words of the whole text; windows that touch or overlap give
   the maximal stretches in `spans`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, WordHashes, by_bytes, gram_hashes, guarded_join, mix64, small_batches, text_bytes, written

_BASE = 0x9E3779B97F4A7C15 | 1


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            factors = np.ones(2 * n + 1024, dtype=np.uint64)
            for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                factors[1:] = factor
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self.up, self.down


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by doubling."""
    m, size = x, 1
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == w else np.minimum(m[: len(x) - w + 1], m[w - size : w - size + len(x) - w + 1])


def suffix_places(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that begin at `starts` of one array and have `counts` suffixes each: the number of each suffix's text, its place."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def runs_of(texts: list[np.ndarray], window: int, k: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(text, selector, path, path2, start, length) of the texts' fragments: runs of windows with one least k-word hash."""
    sizes = np.array([len(x) for x in texts])
    h, begins = np.concatenate(texts), np.cumsum(sizes) - sizes
    row, at = suffix_places(begins, np.maximum(sizes - window + 1, 0))
    if not len(row):
        return (np.zeros(0, np.int64),) * 6
    selector = sliding_min(mix64(gram_hashes(h, k)), window - k + 1)[at]
    first = np.flatnonzero(np.concatenate(([True], (selector[1:] != selector[:-1]) | (row[1:] != row[:-1]))))
    length = np.diff(np.concatenate((first, [len(row)])))
    row, selector, start = row[first], selector[first], at[first]
    end = start + length + window - 1
    up, down = powers.to(len(h))
    paths = []
    for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDEF01)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h ^ salt) * up[: len(h)], dtype=np.uint64)))
        paths.append(mix64((sums[end] - sums[start]) * down[start] + length.astype(np.uint64)))
    return row, selector, *paths, start - begins[row], length


def fragments(base: DataFrame, window: int, k: int) -> DataFrame:
    """base (id, tag, b) to (selector, path, path2, id, tag, start, length) of every fragment of every row; path and path2 name its words."""
    names = ["selector", "path", "path2", "id", "tag", "start", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in by_bytes(texts):
                row, selector, path, path2, start, length = runs_of([hashes.of(t.split()) for t in texts[lo:hi]], window, k, powers)
                if len(row):
                    keys = [b.column(c).take(pa.array(row + lo)) for c in range(2)]
                    longs = [pa.array(x.view(np.int64)) for x in (selector, path, path2)]
                    yield pa.RecordBatch.from_arrays([*longs, *keys, pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], names)

    return base.select("id", "tag", "b").mapInArrow(run, "selector long, path long, path2 long, id long, tag long, start int, length int")


def path_words(base: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted (id, tag, start, length, path, path2) to (path, path2, id, words), the hashes of the fragment's words, from the texts."""
    per_row = wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "length", "path", "path2")).alias("runs"))
    once = base.join(per_row, ["id", "tag"]).groupBy("id", "tag").agg(F.first("b").alias("b"), F.first("runs").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                rows, parts = [], []
                for own, text, runs in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                    h = hashes.of(text.split()).view(np.int64)
                    for r in runs:
                        rows.append((r["path"], r["path2"], own))
                        parts.append(h[r["start"] : r["start"] + r["length"] + window - 1])
                if rows:
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], long_lists(parts)], ["path", "path2", "id", "words"])

    return once.select("id", "b", "runs").mapInArrow(run, "path long, path2 long, id long, words array<long>")


def long_lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


def each_list(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    for lo, hi in zip(offsets, offsets[1:], strict=False):
        yield values[lo:hi]


def prefix_names(paths: DataFrame, window: int, length: int, shorter: int = 0) -> DataFrame:
    """paths (path, path2, id, words) to (path, path2, id, at, name, before) for each suffix of `window` words or more: the names
    of its first `length` and first `shorter` words (0 for none)."""
    names = ["path", "path2", "id", "at", "name", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h, offsets = b.column(3).values.to_numpy().view(np.uint64), b.column(3).offsets.to_numpy()
            row, place = suffix_places(offsets[:-1], np.diff(offsets) - window + 1)
            before = gram_hashes(h, shorter)[place].view(np.int64) if shorter else np.zeros(len(row), np.int64)
            keys = [b.column(c).take(pa.array(row)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array((place - offsets[row]).astype(np.int32)), pa.array(gram_hashes(h, length)[place].view(np.int64)), pa.array(before)], names)

    return paths.select("path", "path2", "id", "words").mapInArrow(run, "path long, path2 long, id long, at int, name long, before long")


def suffixes(paths: DataFrame, routes: DataFrame, window: int, depth: int) -> DataFrame:
    """routes (path, path2, at, name) to (name, path, path2, at, id, whole, rest): the words of each suffix after its prefix of `depth`
    words, 32 bits for each, and a 64-bit name of all its `window` words."""
    each = routes.groupBy("path", "path2").agg(F.collect_list("at").alias("at"), F.collect_list("name").alias("name"))
    names = ["name", "path", "path2", "at", "id", "whole", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                h, offsets = part.column(3).values.to_numpy().view(np.uint64), part.column(3).offsets.to_numpy()
                at, marks = part.column(4).flatten().to_numpy(), part.column(4).offsets.to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(marks))
                place = offsets[row] + at
                rest = (h >> np.uint64(32)).astype(np.uint32)[place[:, None] + np.arange(depth, window)].tobytes()
                ends = np.arange(0, len(rest) + 1, 4 * (window - depth), dtype=np.int32)
                path, path2, own = (part.column(c).take(pa.array(row)) for c in range(3))
                whole = pa.array(gram_hashes(h, window)[place].view(np.int64))
                cols = [part.column(5).flatten(), path, path2, pa.array(at), own, whole, pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(rest)])]
                yield pa.RecordBatch.from_arrays(cols, names)

    joined = paths.join(each, ["path", "path2"]).select("path", "path2", "id", "words", "at", "name")
    return joined.mapInArrow(run, "name long, path long, path2 long, at int, id long, whole long, rest binary")


def subtree_nodes(group: np.ndarray, rest: np.ndarray, whole: np.ndarray, depth: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Subtrees of groups (a number for each suffix) below prefixes of `depth` words: the suffixes' order, and for each in this order
    the number of the node of depth `window` that it stands below.

    rest holds the words after the prefix. The depth at which neighbours part is that of the inner node that joins them; nodes of full
    depth are the stretches that no shallower one cuts. Words are compared by 32 bits, whole suffixes by 64 more.
    """
    words = np.concatenate([group.astype(np.uint32)[:, None], rest], axis=1)
    order = np.argsort(np.ascontiguousarray(words).view(f"S{4 * words.shape[1]}").ravel(), kind="stable")
    order = order[np.lexsort((whole[order], np.concatenate(([0], np.cumsum((words[order][1:] != words[order][:-1]).any(1))))))]
    words = words[order]
    same = words[1:] == words[:-1]
    common = np.where(same.all(1), words.shape[1], same.argmin(1))
    parts = np.where(common == 0, 0, depth + common - 1)  # 0: other groups, the root
    deep = (parts >= window) & (whole[order][1:] == whole[order][:-1])
    return order, np.concatenate(([0], np.cumsum(~deep)))


def subtree_hits(rows: DataFrame, window: int, depth: int, at_once: int = 50_000) -> DataFrame:
    """rows as of suffixes() to (path, path2, at) of those whose node of full depth has a smaller document; a group is met as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            name, ids, whole = (table.column(c).to_numpy() for c in (0, 4, 5))
            data = b"".join(table.column(6).to_pylist())
            rest = np.frombuffer(data, np.uint32).reshape(len(name), window - depth)
            group = np.concatenate(([0], np.cumsum(name[1:] != name[:-1])))
            order, node = subtree_nodes(group, rest, whole, depth, window)
            least = np.minimum.reduceat(ids[order], np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))))
            hit = order[least[node] < ids[order]]
            if len(hit):
                found = table.select([1, 2, 3]).take(pa.array(np.sort(hit))).combine_chunks()
                yield from found.to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= at_once:
                table = pa.Table.from_batches(held)
                name = table.column(0).to_numpy()
                last = int(np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))[-1])  # the last group may go on
                if last:
                    yield from flush(table.slice(0, last))
                    held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return rows.repartition("name").sortWithinPartitions("name").mapInArrow(run, "path long, path2 long, at int")


def tree_hits(paths: DataFrame, window: int, k: int = 8, most: int = 50_000) -> DataFrame:
    """paths (path, path2, id, words), distinct fragments with their smallest document, to (path, path2, at), the windows that a smaller
    document has in another fragment. k is what fragments were selected by; most: the suffixes of a group that a task may hold at once."""
    found, before, shorter = [], None, 0
    for length in sorted({max(1, window - x) for x in (16, 8, 4, 0)}):
        rows = prefix_names(paths, window, length, shorter)
        if before is not None:
            rows = guarded_join(rows, before, ["before"], "left_semi")
        nodes = written(rows.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("last"), F.count("*").alias("n")).where("least < last").select("name", "least", "n"))
        if length == window:
            found.append(guarded_join(rows, nodes.select("name", "least"), ["name"]).where("id > least").select("path", "path2", "at"))
            break
        routes = guarded_join(rows, nodes.where(F.col("n") <= most).select("name"), ["name"], "left_semi")
        found.append(subtree_hits(suffixes(paths, routes, window, length), window, length))
        before, shorter = nodes.where(F.col("n") > most).select(F.col("name").alias("before")), length
        if before.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def without_repeats(docs: DataFrame, window: int = 50, k: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), finder: Callable[[DataFrame, int, int], DataFrame] = tree_hits) -> DataFrame:
    """(id, n_words, n_removed, kept, spans) for each row: kept words joined by single spaces; spans (first, end) of words removed.

    A word goes if a window of `window` words around it has a word sequence that a document with a smaller id has too; windows
    are judged on the input. Words are runs of anything but ASCII white space, compared byte by byte. Null and empty texts
    have no words and keep an empty text. Rows that repeat an id are not smaller than each other. A null id is smaller than
    all others. Ids are integers. Nothing is capped: any number of documents may share a window. Columns named in carry are kept, and
    with them `cleaned`: the text as it was where no word went, else the kept words. finder finds, among distinct fragments, the
    windows that a smaller document has. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"), text_bytes(f"`{text_col}`").alias("b"), *[F.col(f"`{c}`") for c in carry])
    base = base.withColumn("tag", F.xxhash64("b"))  # tells rows of one id apart by their text
    runs = written(fragments(base, window, k))
    groups = runs.groupBy("selector").agg(F.min("id").alias("d0"), F.max("id").alias("d1")).where("d0 < d1").select("selector")
    shared = written(guarded_join(runs, written(groups), ["selector"], "left_semi"))
    paths = written(shared.groupBy("selector", "path", "path2").agg(F.min(F.struct("id", "tag", "start", "length")).alias("first")))
    several = written(paths.groupBy("selector").agg(F.count("*").alias("n")).where("n > 1").select("selector"))
    wanted = guarded_join(paths, several, ["selector"], "left_semi").select("first.*", "path", "path2")
    found = finder(written(path_words(base, wanted, window)), window, k)
    hits = found.groupBy("path", "path2").agg(F.sort_array(F.collect_list("at")).alias("hits"))
    known = written(paths.select("path", "path2", F.col("first.id").alias("least")).join(hits, ["path", "path2"], "left"))
    marked = shared.join(known, ["path", "path2"]).where("id > least OR hits IS NOT NULL").withColumn("hits", F.when(F.col("id") == F.col("least"), F.col("hits")))
    per_row = marked.groupBy("id", "tag").agg(F.collect_set(F.struct("start", "length", "hits")).alias("runs"))
    out = cut(base.join(per_row, ["id", "tag"], "left").select("id", "b", "runs", *[F.col(f"`{c}`") for c in carry]), window)
    return out.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))).withColumnRenamed("id", id_col)


def cut(rows: DataFrame, window: int) -> DataFrame:
    """rows (id, b, runs, ...) to (id, n_words, n_removed, kept, spans), and where there are more columns those and `cleaned`."""
    carry = rows.columns[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                total, gone, kept, spans = [], [], [], []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = text.split()
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    for r in runs or ():
                        s = r["start"]
                        if r["hits"] is None:  # the whole fragment is a smaller document's
                            change[s] += 1
                            change[s + r["length"] + window - 1] -= 1
                        else:
                            at = s + np.array(r["hits"])
                            np.add.at(change, at, 1)
                            np.add.at(change, at + window, -1)
                    covered = np.cumsum(change[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
                    spans.append([{"first": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    left, last = [], 0
                    for x, y in zip(edge[::2], edge[1::2], strict=True):
                        left += words[last:x]
                        last = y
                    left += words[last:]
                    total.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "replace"))
                span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
                cols = [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)]
                if carry:
                    cleaned = [k if g else t.decode("utf-8", "replace") for k, g, t in zip(kept, gone, part.column(1).to_pylist(), strict=True)]
                    cols += [pa.array(cleaned, pa.string()), *[part.column(i) for i in range(3, part.num_columns)]]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["id", "n_words", "n_removed", "kept", "spans", *(["cleaned"] if carry else []), *carry]
    more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept string, spans array<struct<first:int,end:int>>" + (", cleaned string" + more if carry else ""))

