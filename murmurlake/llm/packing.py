"""Best-fit packing of token pieces by patterns fitted with non-negative least squares.

The corpus is seen only as a histogram of piece lengths, bounded by the sequence length. Patterns of two and three lengths
that fill a sequence exactly are enumerated, their repeat counts fitted to the histogram by non-negative least squares and
rounded, at whichever of a few thresholds takes the fewest sequences in all; what is left is packed best fit, longest first, whole
groups of equal sequences at a time. Ranks of pieces
within their length then say which place of which sequence each piece takes.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, pick, small_batches, text_bytes, written

PIECES = "piece int, start long, length long, ids binary"


def letters(word: bytes) -> bool:
    """Letters only, and still so once composed: some take marks of their own then, to which signs would be joined."""
    x = word.decode("utf-8", "replace")
    return x.isalpha() and unicodedata.is_normalized("NFC", x)


class WordIds:
    """Token ids (little-endian unsigned 32-bit) of white-space separated words, remembered up to a bounded number.

    Holds for tokenizers that drop white space and never join across it, as word-level BPE with word ends does. Unknown
    words are encoded together in one text; each pre-token ends in the one token that carries the end-of-word suffix. Signs at a
    word's end are encoded apart where the tokenizer is seen to do so, and case is dropped where it is seen to drop it.
    """

    SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.t, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.ends = np.zeros(self.t.get_vocab_size(), dtype=bool)
        self.ends[[i for w, i in self.t.get_vocab().items() if w.endswith("</w>")]] = True
        self.tails: dict[bytes, bytes | None] = {b"": b""}
        self.folds = self._one(b"Ab") == self._one(b"ab")

    def _one(self, word: bytes) -> bytes:
        return np.array(self.t.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def tail(self, signs: bytes) -> bytes | None:
        """The ids of signs that end a word; None if they are not encoded by themselves there."""
        if signs not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {b"": b""}
            own = self._one(signs)
            self.tails[signs] = own if self._one(b"ab" + signs) == self._one(b"ab") + own else None
        return self.tails[signs]

    def encoded(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Words of letters only are one pre-token each: many go into one text, cut where a word end stands."""
        plain = [(w, x) for w in words if (x := w.decode("utf-8", "replace")).isalpha()]
        out = {w: self._one(w) for w in words.difference([w for w, _ in plain])}
        for lo in range(0, len(plain), 2000):
            part = plain[lo : lo + 2000]
            ids = np.array(self.t.encode_batch_fast([" ".join([x for _, x in part])], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(part):  # a letter that the normalizer takes apart
                out.update((w, self._one(w)) for w, _ in part)
                continue
            whole, start = ids.tobytes(), 0
            for (w, _), end in zip(part, cuts.tolist(), strict=True):
                out[w] = whole[start:end]
                start = end
        return out

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of all `words` that are not known yet, remembering the short ones while there is room."""
        split, stems, known = {}, set(), self.known
        for w in words.difference(known):
            stem = w.rstrip(self.SIGNS)
            tail = self.tail(w[len(stem) :]) if len(stem) < len(w) else b""
            if tail is None or not stem or tail and not letters(stem):
                stem, tail = w, b""
            elif self.folds:
                stem = stem.lower()
            split[w] = (stem, tail)
            stems.add(stem)
        got = self.encoded(stems.difference(known))
        ids = {w: (got[stem] if stem in got else known[stem]) + tail for w, (stem, tail) in split.items()}
        if len(known) < self.most:
            known.update((w, x) for d in (got, ids) for w, x in d.items() if len(w) <= 40)
        return ids

    def texts(self, texts: list[bytes]) -> list[bytes]:
        words = [x.split() for x in texts]
        extra, known = self.learn(set().union(*words)), self.known
        if all(map(known.__contains__, extra)):
            return [b"".join(map(known.__getitem__, ws)) for ws in words]
        return [b"".join([extra[w] if w in extra else known[w] for w in ws]) for ws in words]


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer with its memory for each Python worker."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Each document's ids, end_id last, cut into pieces of `capacity`; the last piece may be shorter.

    Columns: the id, piece (from 0), start (ids before it), length, ids (binary, little-endian unsigned 32-bit); with digest
    ids_crc32 instead of ids, so that ids need not leave the task. Null text is empty: one piece, end_id alone. Repeated
    rows give repeated pieces. The tokenizer must drop white space (see WordIds).
    """
    width = 4 * capacity
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = word_ids(tokenizer), int(end_id).to_bytes(4, "little")
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in by_bytes(texts):
                row, piece, start, length, ids = [], [], [], [], []
                for r, x in enumerate(known.texts(texts[lo:hi]), lo):
                    x += end
                    for p, s in enumerate(range(0, len(x), width)):
                        part = x[s : s + width]
                        row.append(r)
                        piece.append(p)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        ids.append(zlib.crc32(part) if digest else part)
                cols = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.int64() if digest else pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "piece", "start", "length", "ids_crc32" if digest else "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    tail = PIECES.replace("ids binary", "ids_crc32 long") if digest else PIECES
    return docs.select(F.col(f"`{id_col}`"), text_bytes(f"`{text_col}`").alias("b")).mapInArrow(cut, f"`{id_col}` {kind}, {tail}")


def fitting_patterns(counts: np.ndarray, most: int = 30_000) -> list[tuple[int, ...]]:
    """Exactly full patterns of one to three lengths that occur, at most `most` of them, frequent lengths first."""
    cap = len(counts) - 1
    have = np.flatnonzero(counts)
    have = have[have > 0]
    out = [(cap,)] if counts[cap] else []
    out += [(int(cap - b), int(b)) for b in have if cap - b >= b and counts[cap - b]]
    a, b = np.meshgrid(have, have, indexing="ij")
    c = cap - a - b
    ok = (a >= b) & (b >= c) & (c > 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = counts[c] > 0
    a, b, c = a[ok], b[ok], c[ok]
    best = np.argsort(-np.minimum(np.minimum(counts[a], counts[b]), counts[c]), kind="stable")[: max(0, most - len(out))]
    return out + list(zip(a[best].tolist(), b[best].tolist(), c[best].tolist(), strict=True))


def nnls_counts(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that makes the patterns' lengths meet the histogram in the least-squares sense, long lengths weighing more.

    Multiplicative updates on the sparse incidence: x stays non-negative and the squared error never grows.
    """
    if not patterns:
        return np.zeros(0)
    p = np.repeat(np.arange(len(patterns)), [len(x) for x in patterns])
    length = np.concatenate([np.array(x) for x in patterns])
    n, weight = len(counts), np.arange(len(counts), dtype=float) / len(counts)
    goal = np.bincount(p, (weight * counts)[length], len(patterns))
    x = np.bincount(p, counts[length] / np.maximum(np.bincount(length, minlength=n), 1)[length], len(patterns)) / 3
    for _ in range(rounds):
        made = np.bincount(length, x[p], n)
        x *= goal / np.maximum(np.bincount(p, (weight * made)[length], len(patterns)), 1e-12)
    return x


def plan_sequences(counts: np.ndarray, patterns_most: int = 30_000, thresholds: tuple[float, ...] = (0.02, 0.25, 0.5, 1.0)) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """((pattern, repeats) pairs that use up the histogram counts[length], how many sequences of them the fitted patterns make).

    No pattern is longer than len(counts) - 1 in sum. Fitted counts are rounded up from a fraction of `threshold` on, as far as the
    lengths last, largest first. Of the thresholds the first with the fewest sequences in all is taken: lower ones leave less to
    best fit.
    """
    patterns = fitting_patterns(counts, patterns_most)
    x = nnls_counts(patterns, counts.astype(float))
    best, fitted = None, 0
    for threshold in thresholds:
        left, plan = counts.astype(np.int64).copy(), []
        for i in np.argsort(-x, kind="stable"):
            lengths, times = np.unique(patterns[i], return_counts=True)
            n = int(min(np.floor(x[i] + 1 - threshold + 1e-9), (left[lengths] // times).min()))
            if n > 0:
                left[lengths] -= n * times
                plan.append((patterns[i], n))
        made = sum(n for _, n in plan)
        plan += best_fit(left)
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best, fitted = plan, made
    return best, fitted


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) pairs that use up the histogram: longest lengths first, each into the fullest sequences that still hold it."""
    cap = len(left) - 1
    spaces: list[int] = []  # of open groups, ascending
    groups: dict[int, list[list]] = {}

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        if space not in groups:
            bisect.insort(spaces, space)
            groups[space] = []
        groups[space].append([pattern, n])

    for length in range(cap, 0, -1):
        todo = int(left[length])
        while todo:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                pattern, n = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    spaces.pop(at)
                use = min(n, todo)
                if n > use:
                    put(space, pattern, n - use)
                put(space - length, (*pattern, length), use)
                todo -= use
            else:
                each = min(cap // length, todo)
                n = todo // each
                put(cap - each * length, (length,) * each, n)
                todo -= n * each
    return [(pattern, n) for of in groups.values() for pattern, n in of]


def places(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> pd.DataFrame:
    """Rows (length, lo, hi, sequence, at): rank r of a length in [lo, hi) goes to sequence + r - lo, offset `at`."""
    used, first, rows = [0] * (capacity + 1), 0, []
    for pattern, n in plan:
        at = 0
        for length in pattern:
            rows.append((length, used[length], used[length] + n, first, at))
            used[length] += n
            at += length
        first += n
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "first", "at"]).astype("int64")


def assign_sequences(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id", each: int = 250_000, least: int = 1000, patterns_most: int = 30_000) -> DataFrame:
    """pieces (id, piece, length, ...) plus sequence_id and offset. `pieces` is read three times: pass a written table.

    A length may be most pieces, so its pieces are ranked in parts, shifted by the counts of the parts before: up to 64 parts of `least`
    pieces or more, and as many as it takes for a part to have no more than about `each`. To the driver go the counts by length and part, back go as many shifts and the places of the plan;
    all are bounded by `capacity` and pieces / each. Within one sequence offsets are gapless from 0. No pieces give no rows.
    """
    spark = pieces.sparkSession
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    parts = [1] * (capacity + 1)
    for length, n in lengths.items():
        if n > least:
            parts[length] = max(-(-n // each), min(64, -(-n // least)))
    of = F.expr(f"array({', '.join(map(str, parts))})")[F.col("length")]  # flat: a branch for each length nests deeper than the driver's stack
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64(F.col(f"`{id_col}`"), "piece"), of).cast("int"))
    hist = pieces.groupBy("length", "part").count().toPandas().sort_values(["length", "part"]).reset_index(drop=True)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[list(lengths)] = list(lengths.values())
    table = places(plan_sequences(counts, patterns_most)[0], capacity)
    hist["base"] = hist.groupby("length")["count"].cumsum() - hist["count"]
    small = lambda df, n: F.broadcast(df) if n <= 500_000 else df.hint("merge")
    base = small(spark.createDataFrame(hist[["length", "part", "base"]].astype({"length": "int64", "part": "int32", "base": "int64"}), "length long, part int, base long"), len(hist))
    order = Window.partitionBy("length", "part").orderBy(F.col(f"`{id_col}`").asc_nulls_first(), "piece")
    ranked = pieces.withColumn("nth", F.row_number().over(order)).join(base, ["length", "part"]).withColumn("nth", F.col("nth") - 1 + F.col("base"))
    slots = small(spark.createDataFrame(table, "length long, lo long, hi long, first long, at long"), len(table))
    out = ranked.join(slots, (ranked["length"] == slots["length"]) & (ranked["nth"] >= slots["lo"]) & (ranked["nth"] < slots["hi"])).drop(slots["length"])
    return out.withColumns({"sequence_id": F.col("first") + F.col("nth") - F.col("lo"), "offset": F.col("at")}).drop("part", "base", "nth", "lo", "hi", "first", "at")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, digest: bool = False, **how) -> DataFrame:
    """Tokenize, cut and pack documents (doc_id, text): token_pieces plus sequence_id and offset. Tokens are written once."""
    pieces = written(token_pieces(pick(docs, "doc_id", "text"), tokenizer, capacity, end_id, digest=digest))
    return assign_sequences(pieces, capacity, **how)
