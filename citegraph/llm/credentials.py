"""Secret scans: fixed patterns, and formats inferred from what they find.

Credentials that the patterns find are labelled examples. A sample of each kind's distinct values is put in a prefix tree
with counts; states whose next-symbol and stop frequencies are compatible by Hoeffding's bound, below them too, are merged
(red and blue states, in the order of the tree), which leaves a probabilistic automaton of the format. Automata of
candidates that no pattern found, with and without digits, are the other side. Every candidate, a maximal run of credential
characters apart from the patterns' spans, is then scored by its likelihood under each format: it is a span of kind
"grammar" if the best format makes it 2**MARGIN_BITS times likelier than the best of the others.

One scan of the texts writes spans and candidates; what follows reads that table. The sample that formats are learned from
is bounded (MAX_LABELLED values a kind and side, those with the smallest hashes, of up to MAX_LENGTH characters); every
text, match and candidate is judged.

Defined results: a null text is empty and has no spans. Positions are code points, ends exclusive. A pattern's match is its
whole span, the name before a value too; letters in names are ASCII letters in either case. A value that occurs in many
texts is learned once. Repeated rows keep a row each, null ids too. Without a labelled credential nothing is added. Only id
and text are read.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import Batches, kept, materialize, ship, table, task, text_of

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
#: Candidates: runs of at least so many characters, with a digit, or without.
CHARS_DIGIT, CHARS_PLAIN = 10, 16
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % CHARS_DIGIT)
DIGIT = re.compile("[0-9]").search

MAX_LABELLED, MAX_LENGTH = 2_000, 256
ALPHA, SMOOTHING, MARGIN_BITS = 0.05, 0.5, 20.0
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
STOP = len(SYMBOLS)
_CODES = np.full(128, STOP, np.int64)
_CODES[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(STOP)
SCORED_TOKENS = 400_000

Span = tuple[str, int, int]


def base_spans(text: str) -> tuple[list[Span], list[tuple[str, str]], list[Span]]:
    """What the patterns find, the credentials in it (kind, value), and the candidates apart from it (token, start, end)."""
    spans, values = [], []
    low = text.lower()
    if any(n in low for n in NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_CHARS:
                spans.append(("assign", *m.span()))
                values.append(("assign", m[2]))
    runs = [(m[0], *m.span()) for m in RUN.finditer(text)]
    for token, start, _ in runs:  # both patterns' characters are those of runs
        for kind, pattern, least in (("access", ACCESS, ACCESS_CHARS), ("hex", HEX, HEX_CHARS)):
            if len(token) >= least:
                for m in pattern.finditer(token):
                    if len(m[0]) >= least:
                        spans.append((kind, start + m.start(), start + m.end()))
                        values.append((kind, m[0]))
    taken: list[list[int]] = []  # the spans' union
    for a, b in sorted(s[1:] for s in spans):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    starts, candidates = [a for a, _ in taken], []
    for token, start, end in runs:
        if len(token) < CHARS_PLAIN and not DIGIT(token):
            continue
        before = bisect_left(starts, end)  # parts that start before the run ends
        if not before or taken[before - 1][1] <= start:
            candidates.append((token, start, end))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))), values, candidates


class Tree:
    """Strings as a prefix tree, whose states are merged where their futures are statistically alike."""

    def __init__(self, strings: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]  # how often each symbol follows
        self.stops = [0]
        for s in strings:
            at = 0
            for c in s:
                self.seen[at][c] = self.seen[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.stops.append(0)
                at = self.next[at][c]
            self.stops[at] += 1
        self._merge()

    def total(self, state: int) -> int:
        return self.stops[state] + sum(self.seen[state].values())

    def compatible(self, a: int, b: int) -> bool:
        """Whether a state and the root of a subtree differ by no more than chance, nor any states below them."""
        reach = (0.5 * np.log(2 / ALPHA)) ** 0.5
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            bound = reach * (n**-0.5 + m**-0.5)
            if bound >= 1:
                pass  # no difference of shares is larger
            elif abs(self.stops[a] / n - self.stops[b] / m) > bound or any(
                abs(self.seen[a].get(c, 0) / n - self.seen[b].get(c, 0) / m) > bound for c in self.seen[a].keys() | self.seen[b].keys()
            ):
                return False
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the subtree at b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.stops[a] += self.stops[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        """Settle states in the order of the tree: each is merged into the first compatible red state, or turns red."""
        self.red, red, queued, settled = [0], {0}, set(), {}
        blue: deque[tuple[int, str]] = deque()

        def reach(state: int) -> None:
            for c in sorted(self.next[state]):
                if self.next[state][c] not in red and (state, c) not in queued:
                    queued.add((state, c))
                    blue.append((state, c))

        reach(0)
        while blue:
            parent, c = blue.popleft()
            state = self.next[parent][c]
            match = next((r for r in self.red if self.compatible(r, state)), None)
            if match is None:
                self.red.append(state)
                red.add(state)
                reach(state)
            else:
                self.next[parent][c] = match
                self.fold(match, state)
                for r in self.red:  # folding may have given red states new children
                    if len(self.next[r]) > settled.get(r, 0):
                        reach(r)
                        settled[r] = len(self.next[r])


class Automaton(NamedTuple):
    """Bits of each symbol, and of the stop, by state; the state after it. The last state is where unseen symbols lead."""

    bits: np.ndarray
    next: np.ndarray

    @classmethod
    def of(cls, strings: list[str]) -> Automaton:
        tree = Tree(strings)
        number = {s: i for i, s in enumerate(tree.red)}
        counts, after = np.zeros((len(tree.red) + 1, STOP + 1)), np.full((len(tree.red) + 1, STOP + 1), len(tree.red), np.int64)
        for s, i in number.items():
            counts[i, STOP] = tree.stops[s]
            for c, n in tree.seen[s].items():
                counts[i, SYMBOLS.index(c)], after[i, SYMBOLS.index(c)] = n, number[tree.next[s][c]]
        counts += SMOOTHING
        return cls(-np.log2(counts / counts.sum(1, keepdims=True)), after)

    def cost(self, tokens: list[str]) -> np.ndarray:
        """The bits of each token and its stop; a symbol at a time for all tokens that are as long."""
        lengths = np.array([len(t) for t in tokens])
        order = np.argsort(-lengths, kind="stable")
        codes = _CODES[np.frombuffer("".join(tokens[i] for i in order).encode(), np.uint8)]
        sizes = lengths[order]
        first = np.cumsum(sizes) - sizes
        state, total = np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
        for k in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -k, side="left"))  # tokens longer than k
            c = codes[first[:n] + k]
            total[:n] += self.bits[state[:n], c]
            state[:n] = self.next[state[:n], c]
        total += self.bits[state, STOP]
        out = np.empty(len(tokens))
        out[order] = total
        return out


class Formats(NamedTuple):
    """Automata of credentials, and of what is none."""

    credentials: list[Automaton]
    others: list[Automaton]

    def gain(self, tokens: list[str]) -> np.ndarray:
        """By how many bits the best format of credentials is shorter than the best other one, or than even odds of all symbols.

        -inf without formats.
        """
        if not self.credentials or not tokens:
            return np.full(len(tokens), -np.inf)
        even = np.array([(len(t) + 1) * np.log2(STOP + 1) for t in tokens])
        return np.min([even, *(a.cost(tokens) for a in self.others)], axis=0) - np.min([a.cost(tokens) for a in self.credentials], axis=0)


def scanned(rows: DataFrame, text: str) -> DataFrame:
    """The columns of rows but text, with spans, values and candidates of each text."""
    ship(rows.sparkSession)
    rest = [c for c in rows.columns if c != text]
    ordered = rows.select(*[F.col(f"`{c}`") for c in rest], text_of(text).alias(text))
    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema[:-1]]
    span, value, candidate = "array<struct<kind:string,start:int,end:int>>", "array<struct<kind:string,value:string>>", "array<struct<token:string,start:int,end:int>>"
    names = ["__spans", "__values", "__candidates"]
    kinds = [
        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
        pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])),
        pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
    ]

    def run(batches: Batches) -> Batches:
        for b in batches:
            found = [base_spans(t.as_py()) for t in b.column(b.num_columns - 1)]
            columns = []
            for part, kind in zip(zip(*found, strict=True) if found else ([], [], []), kinds, strict=True):
                fields = [f.name for f in kind.value_type]
                columns.append(pa.array([[dict(zip(fields, x, strict=True)) for x in own] for own in part], kind))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], [*b.schema.names[:-1], *names])

    body = ", ".join([*keep, *(f"{n} {k}" for n, k in zip(names, (span, value, candidate), strict=True))])
    return ordered.mapInArrow(task("credentials", run), body)


def learn(found: DataFrame) -> Formats:
    """Formats from a sample of the distinct values and candidates of scanned rows."""
    value = found.select(F.explode("__values").alias("v")).select(F.col("v.kind").alias("side"), F.col("v.value").alias("token"))
    token = found.select(F.explode("__candidates").alias("c")).select("c.token")
    other = token.select(F.when(F.col("token").rlike("[0-9]"), "digit").otherwise("plain").alias("side"), "token")
    fit = F.length("token") <= MAX_LENGTH
    samples: dict[str, list[str]] = {}
    for rows, sides in ((value, KINDS[:3]), (other, ("digit", "plain"))):
        for side in sides:
            own = rows.where((F.col("side") == side) & fit).groupBy("token").agg(F.lit(1)).select("token")
            samples[side] = [r["token"] for r in own.orderBy(F.xxhash64("token"), "token").limit(MAX_LABELLED).collect()]
    made = {side: Automaton.of(tokens) for side, tokens in samples.items() if tokens}
    return Formats([made[k] for k in KINDS[:3] if k in made], [made[k] for k in ("digit", "plain") if k in made])


def find(df: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns in keep, with the spans (kind, start, end) of each text, by start and kind."""
    spark = df.sparkSession
    rows = df.select(F.struct(F.lit(0), *keep).alias("__keep"), F.col(f"`{text}`").alias("__text"))
    found = materialize(scanned(rows, "__text"), "credentials")
    formats, fit = learn(found), uuid.uuid4().hex
    body = f"`__keep` {found.schema['__keep'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Batches) -> Batches:
        known = kept("credentials", dict)
        if fit not in known:  # judged by other formats
            known.clear()
        memory: dict[str, bool] = known.setdefault(fit, {})
        for b in batches:
            spans, candidates = b.column(1).to_pylist(), b.column(2).to_pylist()
            new = sorted({c["token"] for own in candidates for c in own if c["token"] not in memory})
            judged = dict(zip(new, (formats.gain(new) >= MARGIN_BITS).tolist(), strict=True))
            out = []
            for own, more in zip(spans, candidates, strict=True):
                added = [{"kind": "grammar", "start": c["start"], "end": c["end"]} for c in more if judged.get(c["token"], memory.get(c["token"]))]
                out.append(sorted(own + added, key=lambda s: (s["start"], KINDS.index(s["kind"]))) if added else own)
            if len(memory) + len(judged) > SCORED_TOKENS:
                memory.clear()
            memory.update((t, v) for t, v in judged.items() if len(t) <= MAX_LENGTH)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["__keep", "spans"])

    names = [f.name for f in found.schema["__keep"].dataType.fields[1:]]
    judged = found.select("__keep", "__spans", "__candidates").mapInArrow(task("credentials", run), body)
    return judged.select(*[F.col(f"__keep.`{c}`") for c in names], "spans")


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), [F.col("doc_id")])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
