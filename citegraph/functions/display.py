"""What is shown of a text: secrets taken out with their kinds, the window of a snippet, chunks of a table.

Their matches must pass a check, or move a window, which no built-in function does; rows go through Arrow batches, and
searches apply them to the few texts that are shown.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.functions import text as T
from citegraph.functions.rules import folded

SNIPPET_WORDS, CHUNK_WORDS = 24, 500


def luhn(digits: str) -> bool:
    own = [int(c) for c in digits if c.isdigit()][::-1]
    return len(own) > 1 and (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def iban(code: str) -> bool:
    own = code.replace(" ", "").upper()
    return 15 <= len(own) <= 34 and own.isalnum() and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


#: Kind, pattern, and what a match must pass, in the order in which they are taken out.
SECRETS: list[tuple[str, re.Pattern, Callable[[str], bool] | None]] = [("iban", re.compile(T.IBAN), iban), ("card", re.compile(T.CARD), luhn), ("api_key", re.compile(T.API_KEY), None), ("password", re.compile(T.PASSWORD), None)]


def redacted(text: str) -> tuple[str, list[str]]:
    """The text with each secret that passes its check replaced, and their kinds; of a password the word before stays."""
    kinds: list[str] = []
    for kind, pattern, good in SECRETS:
        out, at = [], 0
        for m in pattern.finditer(text):
            if good is None or good(m[0]):
                out += [text[at : m.start()], m[1] if kind == "password" else "", f"[REDACTED:{kind}]"]
                kinds.append(kind)
                at = m.end()
        text = "".join([*out, text[at:]])
    return text, kinds


def snippet(text: str, terms: list[tuple[str, bool]], words: int = SNIPPET_WORDS) -> str:
    """The window of so many words with the most different terms, then the most hits, then the first; hits in brackets."""
    places = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    own = [folded(text[a:b]) for a, b in places]
    hits = [next((k for k, (t, prefix) in enumerate(terms) if (w.startswith(t) if prefix else w == t)), -1) for w in own]
    if not places:
        return ""
    counts, distinct, total, best = [0] * len(terms), 0, 0, (-1, -1, 0)
    for i, k in enumerate(hits):  # the window ends at i
        for place, step in ((k, 1), (hits[i - words] if i >= words else -1, -1)):
            if place >= 0:
                distinct += (counts[place] == 0) if step > 0 else -(counts[place] == 1)
                counts[place] += step
                total += step
        first = max(0, i - words + 1)
        if (distinct, total) > best[:2]:
            best = (distinct, total, first)
    first, last = best[2], min(len(places), best[2] + words) - 1
    out, at = [], places[first][0]
    for i in range(first, last + 1):
        if hits[i] >= 0:
            out += [text[at : places[i][0]], "[", text[places[i][0] : places[i][1]], "]"]
            at = places[i][1]
    out.append(text[at : places[last][1]])
    return ("… " if first else "") + "".join(out) + (" …" if last < len(places) - 1 else "")


def chunk_table(text: str, words: int = CHUNK_WORDS) -> list[str]:
    """The rows of a table in chunks of so many words, the header at the head of each; a longer row is a chunk."""
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) < 2:
        return lines
    room = max(1, words - len(lines[0].split()))
    out: list[list[str]] = [[]]
    used = 0
    for row in lines[1:]:
        n = max(1, len(row.split()))
        if out[-1] and used + n > room:
            out.append([])
            used = 0
        out[-1].append(row)
        used += n
    return ["\n".join([lines[0], *rows]) for rows in out]


def shown(df: DataFrame, text: str = "text", terms: list[tuple[str, bool]] | None = None) -> DataFrame:
    """df with its text redacted, kinds of what was taken out, and with terms its snippet; null counts as empty."""
    rows = df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    at, names = df.columns.index(text), [*df.columns, "kinds", *(["snippet"] if terms else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [redacted(t) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array([t for t, _ in found], pa.string())
            columns.append(pa.array([k for _, k in found], pa.list_(pa.string())))
            if terms:
                columns.append(pa.array([snippet(t, terms) for t, _ in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, schema + ", kinds array<string>" + (", snippet string" if terms else ""))
