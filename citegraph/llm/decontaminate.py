"""Benchmark decontamination: every training passage queries a BM25 index of the benchmark's items.

Terms are pairs of neighbouring words of an item. A passage is a window of two times the longest item, and windows start
at every half of that, so an item lies whole in one of them. An item's score is its BM25 score as a share of what it
scores against itself, so one threshold serves items of all lengths. Retrieval is block-max WAND over many passages at
once: a passage whose terms' largest impacts do not reach the threshold is left, then blocks of items whose own largest
impacts do not, and only what remains is scored exactly. All items at or above the threshold are then held against the
passage: the runs of words of the item's question and those of its answer (its last sentence) must both be there.

The index is sent to all tasks. Its size is checked: items over INDEX_BYTES are searched in slices, a scan each, with the
frequencies and lengths of all items in each slice's scores.

Defined results: null or empty texts are clean. Items without two words have no term and are never found. Repeated
documents keep a row each; repeated items count once each. Ids of items may have any type that sorts; a null one stands
last. An empty benchmark leaves all clean. Only ids and texts are read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citegraph.llm.common import kept, materialize, ship, table, task
from citegraph.llm.tokens import grouped

THRESHOLD, K1, B, BLOCK = 0.4, 1.2, 0.75, 16
#: Words of a run, and the share of the question's and of the answer's runs that a leak holds.
RUN, OVERLAP = 5, 0.6
INDEX_BYTES = 32 << 20
LEAST_STRIDE = 32
CACHE_WORDS = 800_000

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


def normal(piece: str) -> str:
    return "".join(_WORD.findall(piece.lower()))


def words_of(text: str) -> list[str]:
    return [w for w in map(normal, text.split()) if w]


def runs(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Known(dict):
    """Vocabulary ids of pieces between blanks; -1 for other words, -2 for pieces without letters or digits."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        word = normal(piece)
        found = self.vocabulary.get(word, -1) if word else -2
        if len(piece) <= 64:
            self[piece] = found
        return found


class Statistics(NamedTuple):
    """What scores take from all items: how many, their mean number of pairs, the longest one's words, items by pair."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


class Index:
    """The inverted index: postings by term, largest impacts by term and by (term, block of items).

    statistics: of all items, where these are a slice of them.
    """

    def __init__(self, items: list[tuple[object, str]], statistics: Statistics | None = None):
        kept = [(i, words_of(t), t) for i, t in items]
        kept = [x for x in kept if len(x[1]) > 1]
        self.ids = [i for i, _, _ in kept]
        self.vocabulary: dict[str, int] = {}
        for _, words, _ in kept:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.size = len(self.vocabulary) + 1
        self.stride = max(LEAST_STRIDE, statistics.longest if statistics else max((len(w) for _, w, _ in kept), default=0))
        counts = [Counter(self.vocabulary[a] * self.size + self.vocabulary[b] for a, b in zip(w, w[1:], strict=False)) for _, w, _ in kept]
        self.codes = np.array(sorted(set().union(*counts)) if counts else [], np.int64)
        at = {c: k for k, c in enumerate(self.codes.tolist())}
        n = max(1, len(kept))
        df = Counter(c for own in counts for c in own)
        mean = sum(sum(own.values()) for own in counts) / n or 1.0
        every = n
        if statistics:
            words = list(self.vocabulary)
            every, mean = statistics.items, statistics.mean
            df = {c: statistics.df[f"{words[c // self.size]} {words[c % self.size]}"] for c in df}
        postings = []
        for item, own in enumerate(counts):
            length = sum(own.values())
            norm = K1 * (1 - B + B * length / mean)
            impact = {c: np.log1p((every - df[c] + 0.5) / (df[c] + 0.5)) * f * (K1 + 1) / (f + norm) for c, f in own.items()}
            total = sum(impact.values())
            postings += [(at[c], item, v / total) for c, v in impact.items()]
        postings.sort()
        self.term = np.array([p[0] for p in postings], np.int64)
        self.item = np.array([p[1] for p in postings], np.int64)
        self.impact = np.array([p[2] for p in postings], float)
        self.start = np.searchsorted(self.term, np.arange(len(self.codes) + 1))
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if len(postings) else np.zeros(0)
        block = self.term * (n // BLOCK + 1) + self.item // BLOCK
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(postings) else np.zeros(0, np.int64)
        self.block_of, self.block_term = self.item[first] // BLOCK, self.term[first]
        self.block_most = np.maximum.reduceat(self.impact, first) if len(postings) else np.zeros(0)
        self.block_start = np.searchsorted(self.block_term, np.arange(len(self.codes) + 1))
        self.parts = []
        for _, words, text in kept:
            sentences = [s for s in (words_of(x) for x in _SENTENCE.split(text)) if s]
            answer = len(sentences[-1]) if len(sentences) > 1 else max(1, len(words) // 4)
            own = []
            for part in (words[: len(words) - answer], words[-answer:]):
                k = min(RUN, len(part))
                own.append((k, runs(part, k) if k else set()))
            self.parts.append(own)

    @staticmethod
    def _spread(start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all entries of the terms, and which term each comes from."""
        n = start[terms + 1] - start[terms]
        owner = np.repeat(np.arange(len(terms)), n)
        return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[terms], n), owner

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item, score) at or above the threshold, from distinct pairs of passage and term."""
        if not len(term):
            return []
        numbers, at = np.unique(passage, return_inverse=True)
        bound = np.bincount(at, self.most[term])
        stay = bound[at] >= THRESHOLD
        at, term = at[stay], term[stay]
        entry, owner = self._spread(self.block_start, term)
        n_blocks = int(self.block_of.max()) + 1
        pair = at[owner] * n_blocks + self.block_of[entry]
        pairs, back = np.unique(pair, return_inverse=True)
        open_pairs = pairs[np.bincount(back, self.block_most[entry], len(pairs)) >= THRESHOLD] if len(pairs) else pairs
        if not len(open_pairs):
            return []
        stay = np.isin(at, open_pairs // n_blocks)
        at, term = at[stay], term[stay]
        entry, owner = self._spread(self.start, term)
        pair = at[owner] * n_blocks + self.item[entry] // BLOCK
        keep = np.isin(pair, open_pairs)
        entry, owner = entry[keep], owner[keep]
        scored, back = np.unique(at[owner] * (len(self.ids) + 1) + self.item[entry], return_inverse=True)
        score = np.bincount(back, self.impact[entry], len(scored))
        return [(int(numbers[s // (len(self.ids) + 1)]), int(s % (len(self.ids) + 1)), float(v)) for s, v in zip(scored, score, strict=True) if v >= THRESHOLD - 1e-12]

    def verified(self, item: int, words: list[str]) -> bool:
        for k, wanted in self.parts[item]:
            if wanted and len(wanted & runs(words, k)) < OVERLAP * len(wanted):
                return False
        return True

    def search(self, texts: list[str], known: Known) -> list[dict[int, float]]:
        """For each text the items that leaked into it, with their best score."""
        out: list[dict[int, float]] = [{} for _ in texts]
        if not len(self.codes):
            return out
        pieces = [t.split() for t in texts]
        ids = [np.fromiter(map(known.__getitem__, p), np.int64, len(p)) for p in pieces]
        owners = [np.flatnonzero(i != -2) for i in ids]  # pieces without letters are no words
        ids = [i[o] for i, o in zip(ids, owners, strict=True)]
        lens = np.array([len(i) for i in ids])
        flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
        if len(flat) < 2:
            return out
        begin = np.cumsum(lens) - lens
        doc = np.repeat(np.arange(len(texts)), lens)
        both = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0) & (doc[:-1] == doc[1:]))
        code = flat[both] * self.size + flat[both + 1]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        both, term = both[hit], at[hit]
        if not len(both):
            return out
        windows = lens // self.stride + 2
        base = np.cumsum(windows) - windows
        own = doc[both]
        window = base[own] + (both - begin[own]) // self.stride + 1
        key = np.unique(np.r_[window, window - 1] * len(self.codes) + np.r_[term, term])
        for passage, item, score in self.retrieve(key // len(self.codes), key % len(self.codes)):
            d = int(np.searchsorted(base, passage, side="right")) - 1
            if out[d].get(item, -1.0) >= score:
                continue
            first = max(0, (passage - int(base[d]) - 1) * self.stride)
            places = owners[d][first : first + 2 * self.stride + 1]
            if item in out[d] or self.verified(item, [normal(pieces[d][p]) for p in places]):
                out[d][item] = score
        return out


def _slices(items: DataFrame) -> Iterator[tuple[list[tuple[object, str]], Statistics | None]]:
    """The items by slices of at most about INDEX_BYTES, each of which a task can hold, with statistics of all if several."""
    texts = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // INDEX_BYTES) or 1
    if n == 1:
        yield [tuple(r) for r in texts.orderBy("item_id", "text").collect()], None
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words_of(t) for t in b.column(1).to_pylist()]
            counts, lens = [len(w) - 1 if len(w) > 1 else 0 for w in found], list(map(len, found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(set(pairs_of(w))) for w in found], pa.list_(pa.string())), pa.array(counts, pa.int64()), pa.array(lens, pa.int64())], ["slice", "pairs", "n", "words"])

    sliced = texts.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    made = materialize(sliced.select("slice", "text").mapInArrow(task("decontaminate", run), "slice long, pairs array<string>, n long, words long"), "benchmark-pairs")
    count, mean, longest = made.where("n > 0").agg(F.count("*"), F.avg("n"), F.max("words")).first()
    pairs = made.select("slice", F.explode("pairs").alias("pair"))
    often = materialize(pairs.groupBy("pair").agg(F.count("*").alias("df")), "benchmark-frequencies")
    for k in range(n):
        own = [tuple(r) for r in sliced.where(F.col("slice") == k).select("item_id", "text").orderBy("item_id", "text").collect()]
        df = often.join(pairs.where(F.col("slice") == k).select("pair").distinct(), "pair").collect()
        yield own, Statistics(count, mean or 1.0, longest or 0, dict(map(tuple, df)))


def find_leaks(df: DataFrame, items: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, with the items found in each row's text (item_ids, by id, nulls last) and the best score.

    Items of one slice are searched in one scan. Several slices search a written table of the texts, each in tasks of its
    own, and their hits are summed by the row.
    """
    ship(df.sparkSession)
    rows = df.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    id_type = items.schema["item_id"].dataType
    arrow_id = to_arrow_type(id_type)
    body = f"item_ids array<{id_type.simpleString()}>, score double"

    def searched(texts: DataFrame, own: list[tuple[object, str]], statistics: Statistics | None) -> DataFrame:
        """The columns of texts but the last, the text, with what these items leaked into it."""
        fit = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = kept("decontaminate", dict)
            if fit not in indexes:  # one index a worker at a time
                indexes.clear()
                index = Index(own, statistics)
                indexes[fit] = index, Known(index.vocabulary)
            index, known = indexes[fit]
            for b in batches:
                leaks = [x for group in grouped(b.column(b.num_columns - 1).to_pylist()) for x in index.search(group, known)]
                ids = [sorted({index.ids[i] for i in x}, key=lambda v: (v is None, v)) for x in leaks]
                best = [max([0.0, *x.values()]) for x in leaks]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(arrow_id)), pa.array(best, pa.float64())], [*b.schema.names[:-1], "item_ids", "score"])

        head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1])
        return texts.mapInArrow(task("decontaminate", run), f"{head}, {body}")

    numbered, hits = None, []
    for own, statistics in _slices(items):
        if statistics is None:  # the only one
            return searched(rows, own, None)
        if numbered is None:
            numbered = materialize(rows.withColumn("__at", F.monotonically_increasing_id()), "leak-texts")
        hits.append(materialize(searched(numbered.select("__at", "__text"), own, statistics).where(F.size("item_ids") > 0), "leak-hits"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
    summed = reduce(DataFrame.unionByName, hits).groupBy("__at").agg(ids.alias("item_ids"), F.max("score").alias("score"))
    found = numbered.drop("__text").join(summed, "__at", "left")
    none = F.array().cast(f"array<{id_type.simpleString()}>")
    return found.select(*keep, F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "score")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with the columns they came with."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return find_leaks(whole, items, ["row"]).where(F.size("item_ids") == 0).select("row.*")
