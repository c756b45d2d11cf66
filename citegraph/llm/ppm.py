"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts over whole texts: a text is the bytes of its words, each with an end mark for the
blank after it, and one more symbol for its end. The contexts of a symbol are up to ORDER symbols before it, across
words, back to the start of the text.
A symbol is predicted by the longest context in the trie; an unseen one costs an escape (method C: as likely as the
context has different symbols), and shorter contexts leave out the symbols of the longer ones. So the symbols'
probabilities add up to one, and a text's score is the sum of its symbols' logs.

Training counts every context of all training documents; none is dropped, so the model grows with the corpus. A symbol's
probability depends on its GRAM alone, the ORDER symbols before it and itself, so the counts are one written table of
grams. A gram's log is made where all counts with the same two symbols before the last meet, since a context and all that
it escapes to share them; orders 0 and 1, which the alphabet bounds, are sent there. The logs of the most frequent grams,
at most FREQUENT_GRAMS, are sent to all tasks that score; what they find no log for is joined with the table. Words are
treated alike for the base score: those with a share of SHARE and more of all tokens, at most 1 / SHARE of them, are sent,
rarer ones are joined with the table of counts.

Defined results: a null or empty text is the end token alone. A null id has the fold of ''. Repeated rows are scored
each, and count each in training. Without training documents the model is uniform. Only id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import fold_of, materialize, ship, table, task
from citegraph.llm.tokens import grouped

FOLDS, HELD_OUT = 5, 1
ORDER, SHARE = 5, 1e-6
#: Symbols: bytes, the end of a word, the end of a document; and the start, which is only ever context.
END, DOCUMENT, START = 256, 257, 258
ALPHABET = 258
WIDTH = 9
FREQUENT_GRAMS = 1_000_000
MAX_COUNTER, MERGE_GRAMS, BUCKET_GRAMS = 500_000, 1_000_000, 300_000
#: A gram packs the ORDER symbols before one and itself; SUFFIX takes the two symbols before it.
SYMBOL, SUFFIX = (1 << WIDTH) - 1, (1 << 2 * WIDTH) - 1


def split(text: str) -> list[bytes]:
    """The words, A to Z lower-cased: bytes know only the six ASCII blanks and letters."""
    return text.encode("utf-8", "replace").lower().split()


def _symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, bytes, end of all words in a row; each symbol's place in its word, and its word."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    mask = np.ones(len(out), bool)
    mask[ends - 1] = False
    mask[ends - lens] = False
    out[mask] = np.frombuffer(b"".join(words), np.uint8)
    out[ends - lens], out[ends - 1] = START, END
    owner = np.repeat(np.arange(len(words)), lens)
    return out, np.arange(len(out)) - np.repeat(ends - lens, lens), owner


def _key(symbols: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The packed context of the order and the symbol at each place."""
    key = np.full(len(at), order, np.int64)
    for k in range(order, -1, -1):
        key = (key << WIDTH) | symbols[at - k]
    return key << (WIDTH * (ORDER - order))


def context_counts(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of every context and symbol in the counted words."""
    symbols, place, owner = _symbols(words)
    keys, weights = [], []
    for order in range(ORDER + 1):
        at = np.flatnonzero(place >= max(1, order))
        keys.append(_key(symbols, at, order))
        weights.append(counts[owner[at]])
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(back, np.concatenate(weights), len(unique)).astype(np.int64)


def stream(words: list[bytes]) -> bytes:
    """The words with a blank after each."""
    return b" ".join([*words, b""])


def grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every symbol of the streams, and which stream it belongs to."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces)) + ORDER + 1
    ends = np.cumsum(lens)
    symbols = np.full(int(lens.sum()), START, np.int16)
    byte = np.ones(len(symbols), bool)
    byte[ends - 1] = False
    for k in range(ORDER):
        byte[ends - lens + k] = False
    own = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int16)
    own[own == ord(" ")] = END  # words hold no blank
    symbols[byte] = own
    symbols[ends - 1] = DOCUMENT
    key = np.zeros(max(0, len(symbols) - ORDER), np.int64)
    for k in range(ORDER + 1):
        key <<= WIDTH
        key |= symbols[k : k + len(key)]
    real = symbols[ORDER:] != START
    return key[real], np.repeat(np.arange(len(pieces), dtype=np.int32), lens - ORDER)


def all_orders(keys: np.ndarray, counts: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of the contexts, of order least and more, of counted grams; one start is a context, more are not."""
    place = ORDER + 1 - np.maximum(1, sum((keys >> (WIDTH * k)) & SYMBOL == START for k in range(1, ORDER + 1)))
    found, weights = [], []
    for order in range(least, ORDER + 1):
        own = place >= order
        low = keys[own] & ((1 << (WIDTH * (order + 1))) - 1)
        key, back = np.unique((np.int64(order) << (WIDTH * (ORDER + 1))) | low << (WIDTH * (ORDER - order)), return_inverse=True)
        found.append(key)
        weights.append(np.bincount(back, counts[own], len(key)).astype(np.int64))
    return np.concatenate(found), np.concatenate(weights)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(back, np.concatenate(counts), len(unique)).astype(np.int64)


class Trie:
    """Log10 probabilities of tokens from counted contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, counts = keys[order], counts[order].astype(float)
        self.log = np.log10(np.maximum(counts, 1.0))
        depth = self.keys >> (WIDTH * (ORDER + 1))
        shift = WIDTH * (ORDER - depth)
        symbol = (self.keys >> shift) & ((1 << WIDTH) - 1)
        context = self._context(self.keys, depth)
        self.nodes, first = np.unique(context, return_index=True)
        node = np.searchsorted(self.nodes, context)
        n, q = np.bincount(node, counts, len(self.nodes)), np.bincount(node, minlength=len(self.nodes)).astype(float)
        node_depth = depth[first] if len(first) else depth
        # The same symbol in the context that is one symbol shorter, and that context's node.
        above = depth > 0
        own = (self.keys[above] >> shift[above]) & ((1 << (WIDTH * depth[above])) - 1)
        parent_key = ((depth[above] - 1) << (WIDTH * depth[above]) | own) << (WIDTH * (ORDER - depth[above] + 1))
        at = np.minimum(np.searchsorted(self.keys, parent_key), max(0, len(self.keys) - 1))
        self.parent = np.full(len(self.nodes), -1, np.int64)
        shared = np.zeros(len(self.nodes))
        if len(at):
            np.add.at(shared, node[above], counts[at])
            self.parent[node[above]] = node[at]
        total = n + q
        self.top, self.top_escape = np.log10(total), np.log10(q / total)
        p = np.maximum(self.parent, 0)
        rest, new = np.maximum(n[p] - shared, 0.0), np.maximum(q[p] - q, 0.0)
        # With symbols left out: none are left of an equal set, and the escape is certain.
        self.below = np.where(rest + new > 0, np.log10(np.maximum(rest + new, 1e-300)), 0.0)
        self.below_escape = np.where(new > 0, np.log10(np.maximum(new, 1.0)) - self.below, 0.0)
        root = np.flatnonzero(node_depth == 0)
        left = ALPHABET - (q[root[0]] if len(root) else 0)
        self.last = -np.log10(max(left, 1.0))
        del symbol

    @staticmethod
    def _context(keys: np.ndarray, depth: np.ndarray) -> np.ndarray:
        shift = WIDTH * (ORDER - depth + 1)
        return (keys >> shift) << shift

    def _find(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def _code(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log10 probability of each symbol, 0 for starts."""
        out = np.zeros(len(symbols))
        todo = np.flatnonzero(place > 0)
        if not len(self.keys):
            out[todo] = -np.log10(ALPHABET)
            return out
        child = np.full(len(todo), -1, np.int64)
        for order in range(ORDER, -1, -1):
            deep = place[todo] >= order
            rows = np.flatnonzero(deep)
            if not len(rows):
                continue
            at = todo[rows]
            key = _key(symbols, at, order)
            entry = self._find(self.keys, key)
            own = child[rows]
            hit = entry >= 0
            node = np.full(len(rows), -1, np.int64)
            fresh = own < 0
            look = np.flatnonzero(fresh)
            node[look] = self._find(self.nodes, self._context(key[look], np.int64(order)))
            node[~fresh] = self.parent[own[~fresh]]
            scale = np.where(fresh, self.top[np.maximum(node, 0)], self.below[np.maximum(own, 0)])
            escape = np.where(fresh, self.top_escape[np.maximum(node, 0)], self.below_escape[np.maximum(own, 0)])
            there = node >= 0
            out[at] += np.where(there, np.where(hit, self.log[np.maximum(entry, 0)] - scale, escape), 0.0)
            child[rows] = np.where(there, node, own)
            stay = np.ones(len(todo), bool)
            stay[rows[hit & there]] = False
            todo, child = todo[stay], child[stay]
        out[todo] += self.last
        return out

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's last symbol after the others."""
        symbols = np.stack([(keys >> (WIDTH * k)) & SYMBOL for k in range(ORDER, -1, -1)], 1)
        place = np.zeros(symbols.shape, np.int64)
        place[:, -1] = ORDER + 1 - np.maximum(1, (symbols[:, :-1] == START).sum(1))
        return self._code(symbols.ravel(), place.ravel())[ORDER :: ORDER + 1]


class Model(NamedTuple):
    """What scoring needs: the table of grams and how many, (key, count) of orders 0 and 1, (key, log) of frequent grams,
    frequent words, all words, and the totals."""

    grams: DataFrame
    types_of_grams: int
    low: tuple[np.ndarray, np.ndarray]
    logs: tuple[np.ndarray, np.ndarray]
    frequent: dict[bytes, int]
    counts: DataFrame
    tokens: int
    types: int
    documents: int


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of texts (one text column), counted inside each task first."""

    def rows(counter: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], ["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                counter.update(split(t.as_py()))
                if len(counter) > MAX_COUNTER:
                    yield rows(counter)
                    counter = Counter()
        yield rows(counter)

    return texts.mapInArrow(task("ppm", run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _spread(key: np.ndarray | Column) -> np.ndarray | Column:
    """A number that grams with the same two symbols before the last share."""
    if isinstance(key, Column):
        return F.shiftright(F.shiftright(key, WIDTH).bitwiseAND(SUFFIX) * F.lit(2654435761), 15)
    return ((key >> WIDTH & SUFFIX) * 2654435761) >> 15


def count_grams(texts: DataFrame) -> DataFrame:
    """(key, n): how often each gram occurs in all rows of texts (one text column), as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, known = [], [], 0, 0
        for b in batches:
            for group in grouped(b.column(0).to_pylist()):
                key, n = np.unique(grams([stream(split(t)) for t in group])[0], return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > MERGE_GRAMS + known:
                    key, n = _merged(keys, counts)
                    known = held = len(key)
                    keys, counts = [key], [n]
                    if known > MERGE_GRAMS:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
                        keys, counts, held, known = [], [], 0, 0
        if keys:
            yield pa.RecordBatch.from_arrays([*map(pa.array, _merged(keys, counts))], ["key", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if own:
            yield pa.RecordBatch.from_arrays([*map(pa.array, _merged(*map(list, zip(*own, strict=True))))], ["key", "n"])

    return materialize(texts.mapInArrow(task("ppm", run), "key long, n long").repartition("key").mapInArrow(task("ppm", add), "key long, n long"), "grams")


def train(texts: DataFrame, share: float = SHARE) -> Model:
    """The model of all rows of texts, which has one text column without nulls."""
    ship(texts.sparkSession)
    counts = materialize(count_words(texts), "word-counts")
    types, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    documents = texts.count()
    counted = count_grams(texts)
    pairs = counted.groupBy(F.col("key").bitwiseAND(SUFFIX).alias("pair")).agg(F.sum("n").alias("n")).toArrow()  # at most one row for two symbols
    pair, n = (c.to_numpy().astype(np.int64) for c in pairs.columns)
    start = sum(START << (WIDTH * k) for k in range(2, ORDER + 1))
    keys, n = all_orders(pair | start, n)
    low = keys >> (WIDTH * (ORDER + 1)) < 2
    found = counts.where(F.col("c") >= share * max(1, tokens)).select("word", "c").toArrow()  # at most 1 / share rows
    frequent = dict(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True))
    del found
    least, total = _least_count(counted)
    model = Model(counted, total, (keys[low], n[low]), (np.zeros(0, np.int64), np.zeros(0)), frequent, counts, tokens + documents, types + (1 if documents else 0), documents)
    logs = gram_logs(model, counted.where(F.col("n") >= least).select("key")).toArrow()  # at most FREQUENT_GRAMS rows
    return model._replace(logs=(logs["key"].to_numpy(), logs["log"].to_numpy()))


def _least_count(counted: DataFrame) -> tuple[float, int]:
    """The count that at most FREQUENT_GRAMS grams reach, in steps of a sixteenth, and the number of all grams."""
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["step"], r["size"]) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("size")).collect()), reverse=True)
    reached, least = 0, float("inf")
    for at, size in sizes:
        reached += size
        if reached > FREQUENT_GRAMS:
            break
        least = 2.0 ** (at / 16) * (1 - 1e-9)
    return least, sum(size for _, size in sizes)


def gram_logs(model: Model, wanted: DataFrame) -> DataFrame:
    """(key, log10 probability of the last symbol after the others) of distinct grams."""
    low = model.low

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not own:
            return
        key, n = map(np.concatenate, zip(*own, strict=True))
        asked = key[n == 0]
        contexts, total = all_orders(key[n > 0], n[n > 0], 2)
        trie = Trie(np.r_[low[0], contexts], np.r_[low[1], total])
        for i in range(0, len(asked), 250_000):
            part = asked[i : i + 250_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(trie.logs(part))], ["key", "log"])

    buckets = max(16, int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-model.types_of_grams // BUCKET_GRAMS))
    rows = model.grams.select("key", "n").union(wanted.select("key", F.lit(0).cast("long")))
    dealt = rows.select(F.pmod(_spread(F.col("key")), F.lit(buckets)).alias("bucket"), "key", "n").repartition(buckets, "bucket")
    return dealt.mapInArrow(task("ppm", answer), "key long, log double")


class Lookup:
    """Values of integer keys by hashed arrays: keys that lost their place in one array go to the next, smaller one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        while len(keys) or not self.levels:
            bits = len(keys).bit_length() + 1
            slot = self._slot(keys, bits)
            own, value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
            own[slot], value[slot] = keys, values
            self.levels.append((bits, own, value))
            left = own[slot] != keys
            keys, values = keys[left], values[left]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        spread = (keys * np.int64(0x1E3779B97F4A7C15 + 2 * bits)).view(np.uint64)
        return (spread >> np.uint64(64 - bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' values, 0 for those that are not there, and the places of these."""
        bits, own, value = self.levels[0]
        slot = self._slot(keys, bits)
        out = value[slot]
        todo = np.flatnonzero(own[slot] != keys)
        for bits, own, value in self.levels[1:]:
            key = keys[todo]
            slot = self._slot(key, bits)
            hit = own[slot] == key
            out[todo[hit]] = value[slot[hit]]
            todo = todo[~hit]
        out[todo] = 0.0
        return out, todo


def _listed(owner: np.ndarray, keys: np.ndarray, n: int) -> pa.ListArray:
    """For each of n texts its distinct grams (key, tf)."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]) if len(keys) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[first, len(keys)])
    ends = np.cumsum(np.bincount(owner[first], minlength=n))
    entries = pa.StructArray.from_arrays([pa.array(keys[first]), pa.array(tf)], ["key", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), entries)


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, with n_tokens, n_known, base_score and score of each row's text."""
    ship(df.sparkSession)
    rows = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    base = float(np.log10(model.tokens + 0.5 * (model.types + 1)))
    words = list(model.frequent)
    place = {w: i for i, w in enumerate(words)}
    by_word = np.log10(np.fromiter(model.frequent.values(), float, len(words)) + 0.5) - base
    end = float(np.log10(model.documents + 0.5) - base)
    end_known = 1 if model.documents else 0
    logs = model.logs
    names = [*keep, "n_tokens", "known", "own", "rare", "sum", "grams", "__row"]
    word_type = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, frequent = place.get, Lookup(*logs)
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            n, known, own, rare, sums, lists = [], [], [], [], [], []
            for group in grouped(b.column(b.num_columns - 1).to_pylist()):
                pieces = []
                for t in group:
                    tokens = split(t)
                    pieces.append(stream(tokens))
                    at = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
                    hit = at >= 0
                    tail = Counter(tokens[i] for i in np.flatnonzero(~hit))
                    at = at[hit]
                    n.append(len(tokens) + 1)
                    known.append(len(at) + end_known)
                    own.append(float(by_word[at].sum()) + end)
                    rare.append([{"word": w, "tf": k} for w, k in tail.items()])
                keys, owner = grams(pieces)
                log, other = frequent.find(keys)
                sums.append(np.bincount(owner, log, len(group)))
                lists.append(_listed(owner[other], keys[other], len(group)))
            columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(own, pa.float64()), pa.array(rare, word_type), pa.array(np.concatenate(sums)), pa.concat_arrays(lists), pa.array(np.arange(row, row + len(n)))]
            row += len(n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    made = rows.mapInArrow(task("ppm", run), f"{kept}, n_tokens long, known long, own double, rare array<struct<word: binary, tf: long>>, sum double, grams array<struct<key: long, tf: long>>, __row long")
    made = materialize(made, "scored-parts")
    asked = made.select("__row", F.explode("grams").alias("x")).select("__row", "x.key", "x.tf")
    more = asked.join(gram_logs(model, asked.select("key").distinct()), "key").groupBy("__row").agg(F.sum(F.col("tf") * F.col("log")).alias("more"))
    tails = made.select("__row", F.explode("rare").alias("x")).select("__row", "x.word", "x.tf")
    seen = tails.join(model.counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = seen.groupBy("__row").agg(F.sum(F.col("tf") * (F.log10(F.col("c") + 0.5) - F.lit(base))).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_known"))
    out = made.drop("rare", "grams").join(more, "__row", "left").join(sums, "__row", "left")
    return out.select(
        *keep,
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        (F.col("own") + F.coalesce("tail", F.lit(0.0))).alias("base_score"),
        (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold_of() != HELD_OUT).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    scored = score(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", (fold_of() == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
