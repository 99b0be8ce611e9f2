"""Embedding near-dedup with an inverted multi-index.

Vectors are scaled to length one and halved; each half has a codebook of its own, and the two codes of a vector name its cell of
the product grid. Each half gives a query the least squared distance that a vector of a cell can have from it (the half space
beyond the bisector); a cell's bound is the sum of its halves' bounds. The multi-sequence traversal visits cells by rising bound
and stops where that passes the distance of the threshold: by then every link has been met, so recall is 1. Vectors of
visited cells are verified by cosine in double precision. Codebooks are fitted on a bounded sample; every vector is indexed and is
a query.

Cells in order of their two codes lie on a line whose length is the expected mass before them; the line of a label is cut into
as many stretches as it has blocks of vectors. A query is sent once to each stretch in which it visits a cell, and compared there
cell by cell with those that it visits. A link is met from both sides, so only cells from its own onward need be visited.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, guarded_join, written
from .components import components


def usable(label: str, embedding: str) -> Column:
    """Label known; vector known, finite, without nulls and not zero."""
    e = F.col(embedding)
    return F.coalesce(F.col(label).isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))


def fit_codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids of the rows of x by Lloyd's rounds from evenly spaced rows; no more than there are distinct rows."""
    x = np.unique(x, axis=0)
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = bounds_in_parts(x, c)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], near[order][1:] != near[order][:-1])))
        c[near[order][first]] = np.add.reduceat(x[order], first) / np.diff(np.concatenate((first, [len(x)])))[:, None]
    return np.unique(c, axis=0)


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x: its nearest centroid, and for each centroid the least squared distance to the half space of its cell."""
    squares = (c * c).sum(1)
    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + squares
    near = d.argmin(1)
    apart = np.sqrt(np.maximum(squares[near][:, None] - 2 * c[near] @ c.T + squares, 0.0))
    gap = (d - d[np.arange(len(x)), near][:, None]) / (2 * np.where(apart > 0, apart, 1.0))
    return near, np.maximum(gap, 0.0) ** 2


def multi_sequence(a: np.ndarray, b: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) with a[i] + b[j] <= reach by rising sum: a heap over the two sorted lists, each cell opened by its neighbours."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap = [(a[oa[0]] + b[ob[0]], 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > reach:
            return
        yield int(oa[i]), int(ob[j])
        if i == 0 and j + 1 < len(ob):  # the first row opens columns, every cell the next row of its column
            heapq.heappush(heap, (a[oa[0]] + b[ob[j + 1]], 0, j + 1))
        if i + 1 < len(oa):
            heapq.heappush(heap, (a[oa[i + 1]] + b[ob[j]], i + 1, j))


def visited(a: np.ndarray, b: np.ndarray, reach: float, first: int = 0) -> np.ndarray:
    """The same cells as numbers i * len(b) + j, those with i from `first` on, in order of their numbers: for use in bulk, where all
    of them are met and only the traversal's stop matters."""
    i, j = np.flatnonzero(a[first:] <= reach) + first, np.flatnonzero(b <= reach)
    x, y = np.nonzero(a[i][:, None] + b[j][None, :] <= reach)
    return i[x] * len(b) + j[y]


class Line:
    """Where cells (i, j) begin on a line of length 1: the sample's share of first codes below i, and of i that of second codes below j."""

    def __init__(self, x: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        half = books[0].shape[1]
        shares = [np.bincount(bounds_in_parts(y, c), minlength=len(c)) / len(x) for y, c in ((x[:, :half], books[0]), (x[:, half:], books[1]))]
        self.share = shares[0]
        self.first, self.second = (np.concatenate(([0.0], np.cumsum(p)[:-1])) for p in shares)

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        i, j = np.divmod(cells, len(self.second))
        return self.first[i] + self.share[i] * self.second[j]


def bounds_in_parts(x: np.ndarray, c: np.ndarray, rows: int = 1000) -> np.ndarray:
    """The nearest centroid of each row, some rows at a time."""
    return np.concatenate([((c * c).sum(1) - 2 * x[lo : lo + rows] @ c.T).argmin(1) for lo in range(0, len(x), rows)])


def _unit(rows) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def raw_type(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def indexed(vectors: DataFrame, books: tuple[np.ndarray, np.ndarray] | None, line: Line | None, reach: float) -> DataFrame:
    """vectors (label, id, m, embedding, stretches) to (label, dim, c1, c2, stretch, id, m, raw, visits): the two codes, the stretch of
    the label's line that its cell lies in, and the stretches with cells that it visits, from its own on; raw are its components.

    Vectors of another width than the codebooks' have codes 0, 0 and share stretch -1.
    """
    width = raw_type(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows, count = part.column(3).to_pylist(), part.column(4).to_numpy()
                dims = np.array([len(r) for r in rows])
                codes, own, seen = np.zeros((2, len(rows)), np.int32), np.full(len(rows), -1, np.int32), [[-1]] * len(rows)
                at = np.flatnonzero(dims == books[0].shape[1] + books[1].shape[1]) if books is not None else []
                if len(at):
                    x, half = _unit([rows[i] for i in at]), books[0].shape[1]
                    (n1, g1), (n2, g2) = bounds(x[:, :half], books[0]), bounds(x[:, half:], books[1])
                    codes[0, at], codes[1, at] = n1, n2
                    cells = n1 * len(books[1]) + n2
                    for i, cell, first, p, q in zip(at, cells, n1, g1, g2, strict=True):
                        met = visited(p, q, reach, first)
                        seen[i] = np.unique((line(met[met >= cell]) * count[i]).astype(np.int32))
                        own[i] = int(line(np.array([cell]))[0] * count[i])
                cols = [part.column(0), pa.array(dims, pa.int32()), pa.array(codes[0]), pa.array(codes[1]), pa.array(own), part.column(1), part.column(2), pa.array([np.array(r, dtype=width).tobytes() for r in rows], pa.binary()), pa.array(seen, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["label", "dim", "c1", "c2", "stretch", "id", "m", "raw", "visits"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("label", "id", "m", "embedding", "stretches").mapInArrow(run, f"label {kind}, dim int, c1 int, c2 int, stretch int, id long, m long, raw binary, visits array<int>")


class Block:
    """The vectors of a stretch by cell, the links found with them, and which of them links tie together."""

    def __init__(self, held: list[tuple], books: tuple[np.ndarray, np.ndarray] | None, cosine: float, reach: float):
        held.sort(key=lambda h: h[3:5])
        self.ids, self.mult = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        self.x, self.books, self.cosine, self.reach = _unit(np.stack([h[2] for h in held])), books, cosine, reach
        codes = np.array([h[3:5] for h in held])
        starts = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]).any(1))))
        self.cells = [(tuple(codes[s]), s, e) for s, e in zip(starts, [*starts[1:], len(held)], strict=True)]
        self.links, self.group = np.zeros(len(held), np.int64), np.arange(len(held))

    def meet(self, asked: list[tuple]) -> list[tuple[int, int, int]]:
        """(id, links, one peer) of the queries that link with vectors of cells that they visit, their own cell or a later one."""
        ids, mult = np.array([q[0] for q in asked]), np.array([q[1] for q in asked])
        x, codes = _unit(np.stack([q[2] for q in asked])), np.array([q[3:5] for q in asked])
        near = np.zeros((len(asked), 2, 1))
        if self.books is not None and x.shape[1] == sum(c.shape[1] for c in self.books):
            half = self.books[0].shape[1]
            near = bounds(x[:, :half], self.books[0])[1], bounds(x[:, half:], self.books[1])[1]
        else:
            near = near[:, 0], near[:, 1]
        found, first = np.zeros(len(asked), np.int64), np.full(len(asked), -1)
        for (i, j), s, e in self.cells:
            own = (codes[:, 0] == i) & (codes[:, 1] == j)
            later = (codes[:, 0] < i) | (codes[:, 0] == i) & (codes[:, 1] <= j)
            use = np.flatnonzero(later & (near[0][:, i] + near[1][:, j] <= self.reach))
            if not len(use):
                continue
            hit = x[use] @ self.x[s:e].T >= self.cosine
            hit &= ~own[use][:, None] | (self.ids[s:e][None, :] > ids[use][:, None])
            found[use] += hit @ self.mult[s:e]
            self.links[s:e] += mult[use] @ hit
            for q in np.flatnonzero(hit.any(1)):
                tied = np.flatnonzero(hit[q]) + s
                if first[use[q]] >= 0:
                    tied = np.append(tied, first[use[q]])
                first[use[q]] = tied[0]
                names = np.unique(self.group[tied])
                if len(names) > 1:
                    self.group[np.isin(self.group, names)] = names[0]
        return [(int(ids[q]), int(found[q]), int(self.ids[first[q]])) for q in np.flatnonzero(found)]

    def own_links(self) -> list[tuple[int, int, int]]:
        """(id, links from queries, first of the vectors tied to it) of the block's vectors that have either."""
        return [(int(self.ids[i]), int(self.links[i]), int(self.ids[self.group[i]])) for i in np.flatnonzero((self.links > 0) | (self.group != np.arange(len(self.ids))))]


def verified(dealt: DataFrame, books: tuple[np.ndarray, np.ndarray] | None, cosine: float, reach: float, width: str) -> DataFrame:
    """dealt (g, role, id, m, raw, c1, c2), the vectors of a stretch (role 0) and its queries (role 1) together: (id, links, peer).

    Each link counts once for each of its two ends. Peers tie together what links tie together, without a row for each link.
    """

    def rows_of(found: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["id", "links", "peer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, asked, block = None, [], [], None

        def ask() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if held and asked:
                block = block or Block(held, books, cosine, reach)
                yield from rows_of(block.meet(asked))
            asked.clear()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block
            yield from ask()
            if block:
                yield from rows_of(block.own_links())
            held.clear()
            block = None

        for b in batches:
            for g, role, own, m, raw, c1, c2 in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
                if g != current:
                    yield from close()
                    current = g
                (asked if role else held).append((own, m, np.frombuffer(raw, dtype=width), c1, c2))
                if len(asked) >= 512:
                    yield from ask()
        yield from close()

    return dealt.repartition("g").sortWithinPartitions("g", "role").mapInArrow(run, "id long, links long, peer long")


def near_vectors(embeddings: DataFrame, cosine: float = 0.98, sample: int = 20_000, per_cell: int = 64, block: int = 4096, id_col: str = "vec_id") -> DataFrame:
    """(id, n_links, component_id, kept), one row for each vector id.

    Vectors of equal known labels and equal width are linked if their cosine is at least `cosine`. Vectors that are null,
    zero, or hold null or non-finite components link with nothing. Equal vectors of a label are compared once and count by
    their number. Of rows that repeat an id the least (embedding, label) stands for it; a null id is one vector, below all
    others, shown as null. Empty tables give no rows; further columns are left out. Ids are integers.
    sample: the most vectors that codebooks are fitted on; the number of centroids follows the number of vectors, up to an eighth of
    the sample. A stretch of
    more than two blocks of vectors is split by a hash, and every query of the stretch visits its parts.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"), F.struct("embedding", "label").alias("v"))
    rows = written(rows.groupBy("id").agg(F.min("v").alias("v")).select("id", "v.embedding", "v.label").withColumn("ok", usable("label", "embedding")))
    reps = written(rows.where("ok").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    sizes = written(reps.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("stretches")))
    n, books, line, reach = reps.count(), None, None, 2 - 2 * cosine + 1e-9
    if n:
        every = max(1, n // sample)
        took = reps.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("embedding").limit(sample).toPandas()["embedding"]
        dims = [len(x) for x in took]
        dim = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 0
        if dim >= 2:
            x = _unit([list(v) for v in took if len(v) == dim])
            k = int(max(2, min(np.sqrt(n / per_cell), len(x) / 8)))
            books = (fit_codebook(x[:, : dim // 2], k), fit_codebook(x[:, dim // 2 :], k))
            line = Line(x, books)
    known = guarded_join(reps.select("label", F.col("rep").alias("id"), "m", "embedding"), sizes, ["label"])
    index = written(indexed(known, books, line, reach))
    counts = written(index.groupBy("label", "dim", "stretch").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("parts")))
    place = ["label", "dim", "stretch"]
    held = guarded_join(index, counts, place).select(*place, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"), "id", "m", "raw", "c1", "c2")
    asked = guarded_join(index.select("label", "dim", F.explode("visits").alias("stretch"), "id", "m", "raw", "c1", "c2"), counts, place)
    asked = asked.select(*place, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "id", "m", "raw", "c1", "c2")
    dealt = held.union(asked).select(F.xxhash64(*place, "part").alias("g"), "role", "id", "m", "raw", "c1", "c2")
    found = written(verified(dealt, books, cosine, reach, raw_type(reps)))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("id").alias("a"), F.col("peer").alias("b")))
    whole = reps.select("label", "embedding", "rep", "m").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(named.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("ok").join(whole, ["label", "embedding"]).select("id", "n_links", "component_id")
    out = out.union(rows.where("not ok").select("id", F.lit(0).cast("long"), "id"))
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(shown("id").alias(id_col), "n_links", shown("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
