"""Toxicity: a linear-chain conditional random field over words.

The field has two states, clean and toxic. Its potentials are weights of a word's features (the word and its prefixes
of four to eight letters) and of the step from one state to the next. Labelled tokens come from labelled documents:
in a toxic one, the words with a feature that toxic documents have far more often than clean ones. The weights of features
and of steps then follow the likelihood: its expectations of tokens and of steps, those inside runs of words without
evidence too, come from forward and backward passes.

A word without a weighted feature has equal potentials, so a run of such words is a power of the step matrix: passes
visit the words with evidence alone and are still exact. A document's score is a logistic function, fitted on the same
labelled documents, of the largest marginal, of the expected number of toxic words and of their share.

Learning reads at most max_docs labelled documents outside the held-out fold (those with the lowest hash of the id), in
one task; the model is bounded by max_features. Scoring is one scan without a shuffle over whole texts.

Defined results: a null or empty text has no word and gets the score of no evidence. Repeated rows are scored each. With
no labelled document, or none of one class, every score is 0. Only id and text are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import fold_of, ship, table, task
from citegraph.llm.tokens import grouped

MAX_DOCS = 8_000
MAX_FEATURES = 20_000
FOLDS, HELD_OUT = 5, 0
PREFIXES = (4, 5, 6, 7, 8)
#: A feature is evidence from this log odds ratio and this many toxic documents on, near copies counted once.
LEAST_ODDS, LEAST_DOCS, LEAST_SHARE = 3.0, 4, 0.01
COPY_SEEDS = (0, 0x5BD1E995, 0x9E3779B9, 0x85EBCA6B)
#: Measures of a document in the logistic function.
HEAD = 4
CACHE_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")
STEPS, RATE, RIDGE, STEP_PRIOR = 40, 0.5, 1e-3, 5.0


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]


class Field:
    """The fitted field: weights of features for the toxic state, the step matrix, and the document's logistic."""

    def __init__(self, weights: dict[str, float], steps: list[float], head: list[float]):
        self.weights = weights
        self.steps, self.head = np.array(steps, float).reshape(2, 2), np.array(head, float)
        self.known: dict[str, float] = {}
        self._step()

    def _step(self) -> None:
        """The powers of the step matrix by its eigenvalues: m**n = one + r**n * rest, up to the largest value's scale."""
        values, vectors = np.linalg.eig(np.exp(self.steps))
        order = np.argsort(-np.abs(values))
        values, vectors = values[order].real, vectors[:, order].real
        inverse = np.linalg.inv(vectors)
        self.ratio, self.log_top, self.scaled = values[1] / values[0], float(np.log(values[0])), np.exp(self.steps) / values[0]
        self.one, self.rest = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1])
        self.first = np.ones(2)

    def power(self, n: int) -> np.ndarray:
        return self.one + self.ratio**n * self.rest

    def weight(self, piece: str) -> float:
        """The evidence of a piece between blanks: that of its letters' runs."""
        return max((sum(self.weights.get(f, 0.0) for f in features(w)) for w in WORD.findall(piece.lower())), key=abs, default=0.0)

    def evidence(self, text: str) -> tuple[list[int], list[float], int, list[str]]:
        pieces = text.replace("\n", " ").split(" ")
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = self.weight(p)
        found = [(i, w) for i, w in enumerate(map(known.__getitem__, pieces)) if w]
        return [i for i, _ in found], [w for _, w in found], len(pieces), pieces

    def passes(self, places: list[int], weights: list[float], n: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of the toxic state at the places; the expected number of each step; the log partition."""
        m = self.scaled
        forward, befores, scale, a, last = [], [], 0.0, self.first, 0
        for at, w in zip(places, weights, strict=True):
            befores.append(a)
            a = (a @ self.power(at - last)) * (1.0, np.exp(w))
            total = a.sum()
            a, scale, last = a / total, scale + np.log(total), at
            forward.append(a)
        b = self.power(n - 1 - last) @ np.ones(2)
        scale += np.log(a @ b) + (n - 1) * self.log_top
        steps, after = self._steps(a, np.ones(2), n - 1 - last, m), []
        for i in range(len(places) - 1, -1, -1):
            after.append(b)
            gap = places[i] - (places[i - 1] if i else 0)
            b = b * (1.0, np.exp(weights[i]))
            steps = steps + self._steps(befores[i], b, gap, m)
            b = self.power(gap) @ b
            b = b / b.sum()
        after.reverse()
        both = np.array(forward) * np.array(after)
        return both[:, 1] / both.sum(axis=1), steps, scale

    def _steps(self, a: np.ndarray, b: np.ndarray, gap: int, m: np.ndarray) -> np.ndarray:
        """Expected steps over a gap of so many, from forward weights a before it and backward weights b after it.

        The k-th step has the weight (a power(k))_i m_ij (power(gap - 1 - k) b)_j; powers are sums of two geometric rows.
        """
        if gap < 1:
            return np.zeros((2, 2))
        r = self.ratio
        a0, a1, b0, b1 = a @ self.one, a @ self.rest, self.one @ b, self.rest @ b
        run = gap if abs(1 - r) < 1e-12 else (1 - r**gap) / (1 - r)
        last = gap * r ** (gap - 1)
        found = gap * np.outer(a0, b0) + run * (np.outer(a1, b0) + np.outer(a0, b1)) + last * np.outer(a1, b1)
        return found * m / (a @ self.power(gap) @ b)

    def summary(self, text: str) -> tuple[np.ndarray, list[int], np.ndarray, list[str]]:
        places, weights, n, pieces = self.evidence(text)
        if not places:
            return np.eye(HEAD)[0], places, np.zeros(0), pieces
        toxic, _, _ = self.passes(places, weights, n)
        return np.array([1.0, toxic.max(), np.log1p(toxic.sum()), np.log1p(200 * toxic.sum() / n)]), places, toxic, pieces

    def score(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """The document's score and the offsets (code points) of pieces that are toxic rather than not."""
        x, places, toxic, pieces = self.summary(text)
        spans = []
        if len(places) and toxic.max() >= 0.5:
            starts = np.cumsum([0, *[len(p) + 1 for p in pieces]])
            spans = [(int(starts[i]), int(starts[i] + len(pieces[i]))) for i, t in zip(places, toxic, strict=True) if t >= 0.5]
        return float(1 / (1 + np.exp(-np.clip(x @ self.head, -30, 30)))), spans


def _distinct(texts: list[str]) -> list[bool]:
    """False for a text that shares the least of its hashed three-word runs, by one of four orders, with an earlier one."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        words = text.split()
        hashes = [zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))]
        keys = {(k, min(zlib.crc32(h.to_bytes(4, "little"), seed) for h in hashes)) for k, seed in enumerate(COPY_SEEDS)}
        out.append(not keys & seen)
        seen |= keys
    return out


def _observed(places: list[int], n: int) -> np.ndarray:
    """How often a labelled sequence takes each step: toxic at the places, clean elsewhere."""
    inner = sum(b == a + 1 for a, b in zip(places, places[1:], strict=False))
    into, out = sum(p > 0 for p in places) - inner, sum(p < n - 1 for p in places) - inner
    return np.array([[max(0, n - 1 - inner - into - out), into], [out, inner]], float)


def fit(texts: list[str], labels: list[int], max_features: int = MAX_FEATURES) -> Field:
    """Lexicon of labelled tokens, then the field, then the logistic of documents."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    total = [0, 0]
    single = iter(_distinct([t for t, label in zip(texts, labels, strict=True) if label]))
    for text, label in zip(texts, labels, strict=True):
        if label and not next(single):
            continue
        own = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
        seen[label].update(own)
        total[label] += 1
    if not min(total):
        return Field({}, [0.0] * 4, [-30.0, *[0.0] * (HEAD - 1)])
    odds = {
        f: float(np.log((n + 0.5) / (total[1] + 1)) - np.log((seen[0][f] + 0.5) / (total[0] + 1)))
        for f, n in seen[1].items()
        if n >= max(LEAST_DOCS, LEAST_SHARE * total[1])
    }
    chosen = sorted((f for f, v in odds.items() if v >= LEAST_ODDS), key=lambda f: (-seen[1][f], f))[:max_features]
    at = {f: i for i, f in enumerate(chosen)}
    field = Field({f: 1.0 for f in chosen}, [0.0] * 4, [0.0] * HEAD)

    # Rows of the likelihood: per document the places with evidence, their features, and whether the token is toxic.
    rows = []
    for text, label in zip(texts, labels, strict=True):
        places, _, n, pieces = field.evidence(text)
        if places:
            own = [[at[f] for w in WORD.findall(pieces[i].lower()) for f in features(w) if f in at] for i in places]
            rows.append((places, own, n, label))
    rate, weights, bias = RATE, np.zeros(len(chosen)), np.array([[0.0, -2.0], [0.0, 0.0]])
    size = max(1, sum(len(r[0]) for r in rows))
    for step in range(STEPS):
        field.steps = bias
        field._step()
        gradient, seen_steps, expected = np.zeros(len(chosen)), np.zeros((2, 2)), np.zeros((2, 2))
        for places, own, n, label in rows[step % 4 :: 4]:  # a quarter of the documents each step
            w = [float(weights[f].sum()) for f in own]
            toxic, steps, _ = field.passes(places, w, n)
            miss = (label - toxic) / size * 4
            for f, m in zip(own, miss, strict=True):
                gradient[f] += m
            expected += steps
            seen_steps += _observed(places if label else [], n)
        weights += rate * 200 * (gradient - RIDGE * weights / max(1, len(chosen)))
        # Iterative scaling of the steps; what both states share is no freedom, so clean to clean stays 0.
        bias = bias + rate * np.log((seen_steps + STEP_PRIOR) / (expected + STEP_PRIOR))
        bias = np.clip(bias - bias[0, 0], -12.0, 12.0)
    field = Field({f: float(w) for f, w in zip(chosen, weights, strict=True) if w}, bias.ravel().tolist(), [0.0] * HEAD)

    x = np.array([field.summary(t)[0] for t in texts])
    y, head = np.array(labels, float), np.zeros(HEAD)
    for _ in range(50):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(HEAD)
        change = np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * head)
        head = head + change
        if np.abs(change).max() < 1e-6:
            break
    field.head = head
    return field


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Field:
    """Fit on the labelled documents outside the held-out fold whose ids have the lowest hashes, at most max_docs."""
    ship(docs.sparkSession)
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of() != HELD_OUT))
    ids = ids.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Repeated rows of a document teach once, and only one of them is sent: the least text.
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += b.column(1).to_pylist()
            labels += [int(y > 0) for y in b.column(2).to_pylist()]
        model = fit(texts, labels)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([model.weights, model.steps.ravel().tolist(), model.head.tolist()])])], ["model"])

    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(task("toxicity", run), "model string").first()
    return fit([], []) if found is None else Field(*json.loads(found[0]))  # without rows there is no task to fit in


def score_documents(df: DataFrame, model: Field, keep: list[str]) -> DataFrame:
    """The columns in keep, with score and spans (start, end, in code points) of each row's text."""
    ship(df.sparkSession)
    rows = df.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    spec = (model.weights, model.steps.ravel().tolist(), model.head.tolist())
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*spec)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            found = [own.score(t) for group in grouped(texts) for t in group]
            score = pa.array([f[0] for f in found], pa.float64())
            places = pa.array([[{"start": a, "end": e} for a, e in f[1]] for f in found], spans)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], score, places], [*keep, "score", "spans"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(task("toxicity", run), f"{kept}, score double, spans array<struct<start: long, end: long>>")


def op6_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (fold_of() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with the columns they came with."""
    names = [f"`{c}`" for c in docs.columns]
    whole = docs.select(F.struct(*names).alias("row"), "text")
    return score_documents(whole, train(docs, labels), ["row"]).where("score < 0.5").select("row.*")
