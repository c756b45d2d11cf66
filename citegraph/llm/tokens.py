"""Token counts by rank-synchronous array merging.

Texts are cut at blanks and line feeds, which no token of the vocabulary spans, and each new piece is normalised and
split into pre-tokens once a worker. The pre-tokens of many pieces lie in one ragged numpy array of symbol ids; a round
finds the lowest-rank adjacent pair of every sequence at once and merges it everywhere, until no pair has a rank. The
surviving symbols are the count.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens. Special strings inside a text are one token
each, which is the library's default. Repeated rows keep a row each; only id and text are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import kept, ship, table, task

MAX_TOKENS = 2048
#: Pieces that a worker remembers, some 150 MB, and the longest one that it does.
CACHE_PIECES, CACHE_LENGTH = 800_000, 64
#: Characters of text whose pieces are held at once.
GROUP_CHARS = 1 << 20

#: In all other characters there are white space, combining marks, and a capital I whose lower case is two characters.
ODD = re.compile("[^\x20-\x7e\xa1-\u012f\u0131-\u017f\u2010-\u2027]").search


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def grouped(texts: list[str], limit: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about limit characters; a longer text is a run of its own."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > limit:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


class PreTokens:
    """A vocabulary file's normaliser and pre-tokenizer, for many pieces at once.

    Printable ASCII and the Latin letters and marks beside ODD, on which all Unicode tables agree and whose normal form is
    themselves, are normalised and split here, by the file's own pattern; all else is by the library, whose tables are
    its own.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.find = regex.compile(pattern + r"|\n").findall
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = Split(Regex(pattern), behavior="removed", invert=True).pre_tokenize_str

    def words(self, pieces: list[str]) -> list[list[str]]:
        """The pre-tokens of each plain piece; pieces hold no line feed and no special string."""
        out: list[list[str]] = [[]]
        for word in self.find("\n".join(pieces).lower()):
            if word == "\n":
                out.append([])
            else:
                out[-1].append(word)
        return out if pieces else []

    def odd_words(self, piece: str) -> list[str]:
        return [w for w, _ in self.split(self.normalize(piece))]


class PieceCache:
    """Values of pieces (a text cut at blanks and line feeds) from values of pre-tokens, both remembered up to a bound.

    of: values for a list of pre-tokens; join: a piece's value from those of its pre-tokens; special: the value of a
    special string; whole: the values of pieces with ODD characters, where not by their pre-tokens.
    """

    def __init__(self, pre: PreTokens, of: Callable[[list[str]], list], join: Callable[[list], object], special: Callable[[str], object], whole: Callable[[list[str]], list] | None = None):
        self.pre, self.of, self.join, self.special, self.whole = pre, of, join, special, whole
        self.known: dict[str, object] = {}
        self.words: dict[str, object] = {}

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 20_000):
            own = pieces[at : at + 20_000]
            odd = list(filter(ODD, own))
            if odd:
                own = list(set(own).difference(odd))
            if odd and self.whole:
                self.known.update(zip(odd, self.whole(odd), strict=True))
                odd = []
            found = self.pre.words(own) + list(map(self.pre.odd_words, odd))
            own += odd
            new = list(set(chain.from_iterable(found)).difference(self.words))
            self.words.update(zip(new, self.of(new), strict=True)) if new else None
            get, join = self.words.__getitem__, self.join
            self.known.update(zip(own, [join(list(map(get, ws))) for ws in found], strict=True))

    def values(self, texts: list[str]) -> Iterator[list]:
        """The values of each text's pieces."""
        for group in grouped(texts):
            if len(self.known) > CACHE_PIECES:
                self.known.clear()
            if len(self.words) > CACHE_PIECES:
                self.words.clear()
            cut = [t.replace("\n", " ").split(" ") for t in group]
            new = set()
            for pieces in cut:
                new.update(filterfalse(self.known.__contains__, pieces))
            odd = [p for p in new if "<|" in p and self.pre.special.search(p)]
            new.difference_update(odd)
            self._learn(list(new))
            for p in odd:
                plain, marks = self.pre.special.split(p), self.pre.special.findall(p)
                self._learn(plain)
                parts = [self.known[plain[0]]]
                for mark, text in zip(marks, plain[1:], strict=True):
                    parts += [self.special(mark), self.known[text]]
                self.known[p] = self.join(parts)
                new.update(plain, [p])
            get = self.known.__getitem__
            for pieces in cut:
                yield list(map(get, pieces))
            for p in new:
                if len(p) > CACHE_LENGTH:
                    self.known.pop(p, None)
                    self.words.pop(p.lower(), None)


def _byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ArrayMerger:
    """Counts of symbols that are left of pre-tokens when all merges of a vocabulary file are done."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = len(vocab) + len(spec["added_tokens"])
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        first = np.full(self.size, len(pairs), np.int64)  # the lowest rank in which a symbol takes part
        np.minimum.at(first, left, np.arange(len(pairs)))
        np.minimum.at(first, right, np.arange(len(pairs)))
        #: A merge whose result can join again at a lower rank is done one place at a time, as the library does.
        self.single = first[made] < np.arange(len(pairs))
        letters = _byte_symbols()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        out = np.zeros(len(raw), np.int64)
        ids = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(lens) - 1
        ids[ends] = self.last[np.frombuffer(bytes(r[-1] for r in raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), lens)
        none = len(self.made)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[starts, len(ids)])
            key = np.r_[ids[:-1] * self.size + ids[1:], -1]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], none)
            rank[np.r_[starts[1:] - 1, len(ids) - 1]] = none
            low = np.minimum.reduceat(rank, starts)
            done = low == none
            out[seq[starts[done]]] = size[done]
            low = np.repeat(low, size)
            merge = (rank == low) & (low < none)
            place = np.arange(len(ids))
            before = np.maximum.accumulate(np.where(merge, -1, place))  # the last place before that does not merge
            merge &= (place - before) % 2 == 1  # in a run of equal symbols every other place
            if self.single[np.minimum(low, none - 1)].any():
                head = np.repeat(np.minimum.reduceat(np.where(merge, place, len(ids)), starts), size)
                merge &= ~self.single[np.minimum(low, none - 1)] | (place == head)
            ids = np.where(merge, self.made[np.minimum(rank, none - 1)], ids)
            keep = low < none
            keep[1:] &= ~merge[:-1]
            ids, seq = ids[keep], seq[keep]
        return out


def _counter(path: str) -> PieceCache:
    merger = ArrayMerger(path)
    return PieceCache(PreTokens(path), lambda words: merger.counts(words).tolist(), sum, lambda mark: 1)


def count_tokens(texts: list[str], path: str) -> list[int]:
    return list(map(sum, kept(f"tokens {path}", lambda: _counter(path)).values(texts)))


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = MAX_TOKENS) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row."""
    ship(df.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias(key), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_tokens(b.column(2).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], [key, "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(task(f"tokens {path}", run), f"`{key}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > most)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
