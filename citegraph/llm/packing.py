"""Best-fit packing by a linear grouping scheme.

A first scan tokenises every text and cuts documents over the capacity into pieces; a piece is a row of numbers. The
plan needs only how many pieces there are of each length, at most 2,048 numbers however many pieces there are:

1. the large lengths are put in groups of equal cardinality and rounded up to the longest of their group,
2. configurations of few sizes are optimised by column generation (a linear program whose columns a knapsack finds),
3. the actual pieces take the places of the rounded ones, but for the shortest place of each configuration, whose
   room is what rounding left as well,
4. the pieces of those places and the small pieces go, longest first, where they fit best.

The plan is a list of intervals: pieces of one length with ranks from a to b go to sequences from s on, one each, at one
offset. Ranks come from two-level counts, (length, bucket) and then a row number inside a bucket, so that a length
that a third of all pieces share is still numbered by many tasks.

Defined results: a null text is empty, and an empty document is the one separator token. Repeated rows are packed each.
An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.llm.common import kept, materialize, ship, table, task
from citegraph.llm.tokens import PieceCache, PreTokens, vocabulary_path

CAPACITY = 2048
SEPARATOR = 0
GROUPS = 48
#: Lengths up to one of these shares of the capacity are small: the plan with the fewest sequences is taken.
SMALL_SHARES = (3, 8, 2)
#: Pieces of one length that a bucket should hold, and the fewest buckets.
BUCKET_ROWS, MIN_BUCKETS = 100_000, 64
MAX_COLUMNS = 400


def _ids(path: str) -> PieceCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for word, i in tokenizer.get_vocab().items() if word.endswith("</w>")]] = True

    def encoded(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def of(words: list[str]) -> list[bytes]:
        """The library's ids of each pre-token; a token that ends a word marks where the next one begins."""
        out: list[bytes] = []
        for at in range(0, len(words), 1000):
            own = words[at : at + 1000]
            ids = encoded(" ".join(own))
            cut = np.flatnonzero(ends[ids]) + 1
            if len(cut) == len(own):
                raw, places = ids.tobytes(), [0, *(4 * cut).tolist()]
                out += [raw[a:b] for a, b in zip(places, places[1:], strict=False)]
            else:
                out += [encoded(w).tobytes() for w in own]
        return out

    def whole(pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    return PieceCache(PreTokens(path), of, b"".join, lambda mark: encoded(mark).tobytes(), whole)


def token_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian 32-bit numbers, by the library; tokens never span a blank or line feed."""
    return map(b"".join, kept(f"packing {path}", lambda: _ids(path)).values(texts))


def document_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's tokens and a separator, cut at the capacity."""
    ship(df.sparkSession)
    rows = df.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    end = array("I", [SEPARATOR]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(token_bytes(b.column(1).to_pylist(), path)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *longs], [key, "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(task(f"packing {path}", run), f"`{key}` {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _groups(counts: np.ndarray, small: int, capacity: int) -> list[tuple[int, list[list[int]]]]:
    """(size, [length, rank, count]...) of the large lengths, longest first, in groups of equal cardinality."""
    lengths = [x for x in range(capacity - 1, small, -1) if counts[x]]
    if len(lengths) <= GROUPS:
        return [(x, [[x, 0, int(counts[x])]]) for x in lengths]
    each = -(-int(counts[small + 1 : capacity].sum()) // GROUPS)
    found: list[tuple[int, list[list[int]]]] = []
    room = 0
    for x in lengths:
        rank, left = 0, int(counts[x])
        while left:
            if not room:
                if not found or found[-1][0] != x:  # groups of one and the same length are one size
                    found.append((x, []))
                room = each
            take = min(room, left)
            found[-1][1].append([x, rank, take])
            rank, left, room = rank + take, left - take, room - take
    return found


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """How often to use which configuration (how many of each size), rounded down from the program's solution."""
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse, x = np.diag(1.0 / (capacity // sizes)), demand / (capacity // sizes)
    for _ in range(MAX_COLUMNS):
        value = inverse.sum(axis=0)
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for w in range(int(sizes.min()), capacity + 1):
            best[w], took[w] = best[w - 1], -1
            fits = sizes <= w
            gain = np.where(fits, best[w - sizes * fits] + value, -1.0)
            g = int(gain.argmax())
            if gain[g] > best[w] + 1e-12:
                best[w], took[w] = gain[g], g
        if best[capacity] <= 1 + 1e-7:
            break
        column, w = np.zeros(n), capacity
        while w > 0:
            if took[w] < 0:
                w -= 1
            else:
                column[took[w]] += 1
                w -= int(sizes[took[w]])
        step = inverse @ column
        usable = step > 1e-9
        ratio = np.where(usable, x / np.where(usable, step, 1.0), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0.0)
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        columns[:, out] = column
    return [(columns[:, i].astype(int), int(x[i] + 1e-6)) for i in range(n) if x[i] + 1e-6 >= 1]


class Plan:
    """Intervals [length, rank, count, first sequence, offset] for a histogram of lengths."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, share: int = SMALL_SHARES[0]):
        self.capacity, self.intervals, self.sequences = capacity, [], 0
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: (first sequence, count)
        self.gaps: list[int] = []
        small = capacity // share
        if counts[capacity]:
            self.intervals.append([capacity, 0, int(counts[capacity]), 0, 0])
            self.sequences = int(counts[capacity])
        groups = _groups(counts, small, capacity)
        left = [(x, 0, int(counts[x])) for x in range(1, small + 1) if counts[x]]
        if groups:
            sizes = np.array([s for s, _ in groups])
            demand = np.array([sum(m[2] for m in members) for _, members in groups], float)
            for column, times in _configurations(sizes, demand, capacity):
                slots = [g for g in np.flatnonzero(column) for _ in range(column[g])]
                self._substitute([groups[g][1] for g in slots[:-1]], times)
            left += [tuple(m) for _, members in groups for m in members if m[2]]
        for length, rank, count in sorted(left, key=lambda m: (-m[0], m[1])):
            self._best_fit(length, rank, count)

    def _gap(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if not self.runs[gap]:
                insort(self.gaps, gap)
            self.runs[gap].append((first, count))

    def _substitute(self, slots: list[list[list[int]]], times: int) -> None:
        """times sequences of one configuration; each slot takes the next actual pieces of its group."""
        while times and slots:
            ready = [next((m for m in members if m[2]), None) for members in slots]
            if not all(ready):
                break  # a group ran out: the program rounded in its favour
            need = defaultdict(int)
            for m in ready:
                need[id(m)] += 1
            take = min(times, *(m[2] // need[id(m)] or 1 for m in ready))
            at = 0
            for members in slots:
                m = next((m for m in members if m[2]), None)
                if m is None:
                    continue
                own = min(take, m[2])
                if own < take:
                    take = 1
                    own = 1
                self.intervals.append([m[0], m[1], own, self.sequences, at])
                m[1] += own
                m[2] -= own
                at += m[0]
            self._gap(self.capacity - at, self.sequences, take)
            self.sequences += take
            times -= take

    def _best_fit(self, length: int, rank: int, count: int) -> None:
        while count:
            i = bisect_left(self.gaps, length)
            if i == len(self.gaps):
                more = -(-count // (self.capacity // length))
                self._gap(self.capacity, self.sequences, more)
                self.sequences += more
                continue
            gap = self.gaps[i]
            first, n = self.runs[gap].pop()
            if not self.runs[gap]:
                self.gaps.pop(i)
            each = gap // length
            whole = min(n, count // each)
            bins, per = (whole, each) if whole else (1, count)
            for k in range(per):
                self.intervals.append([length, rank, bins, first, self.capacity - gap + k * length])
                rank += bins
            count -= bins * per
            self._gap(gap - per * length, first, bins)
            self._gap(gap, first + bins, n - bins)


def best_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """The best of the schemes for the shares, or the first that meets the bound of the sum of all lengths."""
    least, best = -(-int(counts @ np.arange(capacity + 1)) // capacity), None
    for share in SMALL_SHARES:
        plan = Plan(counts, capacity, share)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; pieces must be a written table, as it is read three times.

    Placing is a task of its own, so that workers let go of what they remember of tokens.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    plan = np.array(best_plan(counts, capacity).intervals, np.int64).reshape(-1, 5)
    base = np.r_[0, np.cumsum(counts)[:-1]]
    start = base[plan[:, 0]] + plan[:, 1]
    order = np.argsort(start, kind="stable")
    start, first, offset = start[order], plan[order, 3], plan[order, 4]

    buckets = max(MIN_BUCKETS, -(-int(counts.sum()) // BUCKET_ROWS))
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(buckets)))
    dealt = materialize(dealt, "packing-dealt")
    sums = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__bucket").orderBy(key, "piece", "ids_crc32")
    ranked = dealt.withColumn("__own", F.row_number().over(own) - 1).join(sums, ["length", "__bucket"])
    ranked = ranked.select(key, "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__own")).alias("__rank"))
    names = [key, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = base[b.column(3).to_numpy()] + b.column(5).to_numpy()
            i = np.searchsorted(start, place, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first[i] + place - start[i]), pa.array(offset[i])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(task("packing places", run), f"`{key}` {pieces.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(document_pieces(df, path, key, text, capacity), "packing-pieces"), key, capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
