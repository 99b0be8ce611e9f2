"""Repeated passages by sparse suffix arrays over words.

Only suffixes at content-selected positions are retained: of the windows of a text, each selects the run of `k` words with the
least hash in it, about one position in twenty. All retained suffixes are sorted by their words, dealt to tasks by range, and
neighbours are compared: suffixes that agree on r words to the right are a stretch of the array without a smaller common prefix.
A match is extended to the left by comparing the words before its positions; a window that holds its position at word o is repeated
where a stretch for r = window - o has the same o words to the left. A stretch that reaches an end of its task's range is put
together with its continuation in the next range, of which only the first and the last suffix have to be known; a range is read piece
by piece, so that no range has to fit in memory. Which positions can
repeat at all, and the cutting of texts, are those of substring_tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import substring_tree
from .common import gram_hashes, guarded_join, mix64, written
from .substring_tree import each_list

_STEP = np.uint64(0xD1342543DE82EF95)


def retained(words: np.ndarray, window: int, k: int) -> list[tuple[int, int]]:
    """(position, first window) of the retained suffixes of a fragment, all of whose windows select runs of one hash.

    Where the selected run occurs more than once, a window belongs to the first one inside it.
    """
    grams, out, first = mix64(gram_hashes(words.view(np.uint64), k)), [], 0
    for at in np.flatnonzero(grams == grams.min()).tolist():
        if first > len(words) - window:
            break
        out.append((at, first))
        first = at + 1
    return out


def retained_suffixes(paths: DataFrame, window: int, k: int) -> DataFrame:
    """paths (path, path2, id, words) to (path, path2, id, at, right, left): up to `window` words from a retained position on, and, from
    there backwards, the words before it that a window of its reaches; 64 bits for each word, big end first."""
    names = ["path", "path2", "id", "at", "right", "left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, right, left = [], [], [], []
            for i, w in enumerate(each_list(b.column(3))):
                data = w.view(np.uint64).astype(">u8")
                for p, first in retained(w, window, k):
                    row.append(i)
                    at.append(p)
                    right.append(data[p : p + window].tobytes())
                    left.append(data[max(first, p - window + k) : p][::-1].tobytes())
            if row:
                keys = [b.column(c).take(pa.array(row)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(at, pa.int32()), pa.array(right, pa.binary()), pa.array(left, pa.binary())], names)

    return paths.select("path", "path2", "id", "words").mapInArrow(run, "path long, path2 long, id long, at int, right binary, left binary")


def word_table(data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each item in a row of `width`, filled up with zeros, and how many each has."""
    sizes = np.array([len(x) // 8 for x in data])
    return np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in data), ">u8").reshape(len(data), width), sizes


def common_words(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many first words the rows of two tables share."""
    same = a == b
    return np.minimum(np.where(same.all(1), a.shape[1], same.argmin(1)), np.minimum(na, nb))


def left_names(left: np.ndarray) -> np.ndarray:
    """Column o: a name of the o words before each position."""
    out = np.zeros((len(left), left.shape[1] + 1), dtype=np.uint64)
    for d in range(left.shape[1]):
        out[:, d + 1] = out[:, d] * _STEP + mix64(left[:, d].astype(np.uint64))
    return out


FOUND = "kind int, path long, path2 long, id long, at int, part int, o int, number int, inner boolean, left long, edge binary"


def chunks_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The batches' rows in tables of about `size` rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def shared_words(a: bytes, b: bytes, window: int) -> int:
    words, sizes = word_table([a, b], window)
    return int(common_words(words[:1], sizes[:1], words[1:], sizes[1:])[0])


def neighbours(sorted_: DataFrame, window: int, k: int, at_once: int = 20_000) -> DataFrame:
    """Sorted retained suffixes to rows of four kinds. 0: window `at` of (path, path2) that a smaller document has. 1: a window whose
    stretch goes on beyond the suffixes that were compared at once, of the smallest document that has it among these; its o, the number
    of its stretch in the range `part` and its name to the left go with it, and whether the stretch goes on inside the range. 2: of
    each range its first (number 0) and last suffix (number 1), and in o the fewest words that neighbours share. 3: the number of the
    range's last stretch for an o. A range is read in pieces of about at_once suffixes.
    """
    names, span = [x.split()[0] for x in FOUND.split(", ")], window - k + 1
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base, fewest = TaskContext.get().partitionId(), np.zeros(span, np.int64), window
        pieces, first_of_all, before = chunks_of(batches, at_once), None, None
        piece = next(pieces, None)
        while piece is not None:
            following = next(pieces, None)
            ends = piece.column(4).to_pylist()
            share_before = shared_words(before, ends[0], window) if before is not None else -1
            share_after = shared_words(ends[-1], following.column(4)[0].as_py(), window) if following is not None else -1
            first_of_all = ends[0] if before is None else first_of_all
            path, path2, ids, at = (piece.column(c).to_numpy() for c in range(4))
            right, n_right = word_table(ends, window)
            left, n_left = word_table(piece.column(5).to_pylist(), span - 1)
            common, name = common_words(right[1:], n_right[1:], right[:-1], n_right[:-1]), left_names(left)
            fewest = min(fewest, int(common.min(initial=window)), share_before if share_before >= 0 else window)

            def rows(kind: int, use: np.ndarray, o: int, number: np.ndarray, inner: np.ndarray, named: np.ndarray) -> pa.RecordBatch:
                same = lambda v: np.full(len(use), v, np.int32)  # noqa: E731, B023
                cols = [same(kind), path[use], path2[use], ids[use], (at[use] - o).astype(np.int32), same(part), same(o), number.astype(np.int32), inner, named.view(np.int64)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(use), pa.binary())], names)

            for o in range(span):
                base[o] += 0 <= share_before < window - o
                stretch = base[o] + np.concatenate(([0], np.cumsum(common < window - o)))  # neighbours that agree on window - o words are in one
                head, base[o] = base[o], stretch[-1]
                use = np.flatnonzero((n_left >= o) & (n_right >= window - o))
                if not len(use):
                    continue
                use = use[np.lexsort((name[use, o], stretch[use]))]
                mine, named = stretch[use], name[use, o]
                first = np.concatenate(([True], (mine[1:] != mine[:-1]) | (named[1:] != named[:-1])))
                least = np.minimum.reduceat(ids[use], np.flatnonzero(first))[np.cumsum(first) - 1]
                hit = use[least < ids[use]]
                if len(hit):
                    yield rows(0, hit, o, np.zeros(len(hit)), np.zeros(len(hit), bool), np.zeros(len(hit), np.uint64))
                inner = (mine == head) & (share_before >= window - o) | (mine == stretch[-1]) & (share_after >= window - o)
                outer = (mine == head) & (share_before < 0) | (mine == stretch[-1]) & (share_after < 0)
                edge = (inner | outer) & (least == ids[use])
                if edge.any():
                    yield rows(1, use[edge], o, mine[edge], inner[edge], named[edge])
            before, piece = ends[-1], following
        if before is not None:
            marks = [(2, fewest, 0, first_of_all), (2, fewest, 1, before), *[(3, o, int(base[o]), None) for o in range(span)]]
            cols = [[x[0] for x in marks], *[[0] * len(marks)] * 4, [part] * len(marks), [x[1] for x in marks], [x[2] for x in marks], [False] * len(marks), [0] * len(marks), [x[3] for x in marks]]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds, strict=True)], names)

    return sorted_.mapInArrow(run, FOUND)


def stretch_numbers(ranges: dict[int, tuple[int, bytes, bytes, dict[int, int]]], window: int, k: int) -> list[tuple[int, int, int, int]]:
    """ranges part: (fewest shared words, first suffix, last suffix, last stretch's number for each o) to (part, o, number, whole), for
    the stretches that several ranges have: those at the ends of neighbouring ranges are one where the suffixes on both sides of the
    cut agree on window - o words."""
    out, before, ends = [], None, {}
    for part, (fewest, first, last, lasts) in sorted(ranges.items()):
        share = 0 if before is None else shared_words(before, first, window)
        for o in range(window - k + 1):
            begin = ends[o] if share >= window - o else 2 * part
            ends[o] = begin if fewest >= window - o else 2 * part + 1
            out += [(part, o, 0, begin)] + ([(part, o, lasts[o], ends[o])] if lasts[o] else [])
        before = last
    parts: dict[tuple[int, int], set[int]] = {}
    for part, o, _, whole in out:
        parts.setdefault((o, whole), set()).add(part)
    return [x for x in out if len(parts[x[1], x[3]]) > 1]


def array_hits(paths: DataFrame, window: int, k: int = 8, at_once: int = 20_000, most: int = 50_000) -> DataFrame:
    """paths (path, path2, id, words), distinct fragments with their smallest document, to (path, path2, at), the windows that a smaller
    document has in another fragment. To the driver go some rows for each range of the sort, whatever the data's size.

    Stretches share k words at least, so ranges are cut between suffixes that differ in these; only where more than `most` suffixes share
    them may a cut go through, and stretches go on beyond it.
    """
    spark = paths.sparkSession
    kept = written(retained_suffixes(paths, window, k).withColumn("head", F.expr(f"substring(right, 1, {8 * k})")))
    common = written(kept.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > most).select("head"))
    if common.isEmpty():
        dealt = kept.repartitionByRange("head")
    else:
        marked = guarded_join(kept, common.withColumn("many", F.lit(True)), ["head"], "left")
        dealt = marked.withColumns({"cut": F.when(F.col("many"), F.col("right")), "cut2": F.when(F.col("many"), F.col("path"))}).repartitionByRange("head", "cut", "cut2")
    columns = ["path", "path2", "id", "at", "right", "left"]
    found = written(neighbours(dealt.select(*columns).sortWithinPartitions("right", "path", "path2", "at"), window, k, at_once))
    ranges: dict[int, tuple] = {}
    for r in found.where("kind > 1").orderBy("part", "kind", "number").select("kind", "part", "o", "number", "edge").collect():
        if r.kind == 3:
            ranges[r.part][3][r.o] = r.number
        elif r.number:
            ranges[r.part] = (r.o, ranges[r.part][1], bytes(r.edge), {})
        else:
            ranges[r.part] = (r.o, bytes(r.edge), b"", {})
    inside, open_ = found.where("kind = 0").select("path", "path2", "at"), found.where("kind = 1")
    numbers = spark.createDataFrame(stretch_numbers(ranges, window, k), "part int, o int, number int, whole long")
    place = ["part", "o", "number"]
    across = guarded_join(open_, numbers, place, max_rows=300_000).withColumn("part", F.lit(-1))
    within = guarded_join(open_.where("inner"), numbers, place, "left_anti", max_rows=300_000).withColumn("whole", F.col("number").cast("long"))
    keys = ["part", "o", "whole", "left"]
    rows = across.select(*keys, "path", "path2", "at", "id").union(within.select(*keys, "path", "path2", "at", "id"))
    least = rows.groupBy(*keys).agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last").drop("last")
    return inside.union(rows.join(least, keys).where("id > least").select("path", "path2", "at"))


def without_repeats(docs: DataFrame, window: int = 50, **how) -> DataFrame:
    """As substring_tree.without_repeats, with the repeated windows found in sparse suffix arrays."""
    return substring_tree.without_repeats(docs, window=window, finder=array_hits, **how)
