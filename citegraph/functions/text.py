"""Text and identifier functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of what is removed, redacted or normalised.
INVISIBLE = "[­᠎​-‏‪-‮⁠-⁤⁦-⁩﻿\\x{e0000}-\\x{e007f}]"
BASE64_RUN = r"[A-Za-z0-9+/]{40,}={0,2}"
HEX_RUN = r"\b[0-9a-fA-F]{40,}\b"
API_KEY = r"\b(?:sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|github_pat_\w{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})"
PASSWORD = r"(?i)\b((?:password|passwd|pwd|mot de passe|mdp)\s*[:=]\s*)(\S+)"
CARD = r"\b(?:\d[ -]?){12,18}\d\b"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"
EMAIL = r"^[^@\s<>]+@[^@\s<>]+\.[^@\s<>]+$"
BIRTHDAY = r"^(?:(\d{4})-?|--)(\d{2})-?(\d{2})(?:T.*)?$"
TOKEN = r"[\p{L}\p{N}]+"
#: Weights of the risk score.
INVISIBLE_RISK, PHRASE_RISK, ENCODED_RISK, FLAG_AT = 0.1, 0.6, 0.8, 0.5

#: Letters of the Latin blocks with marks, and the plain letters that they fold to.
_MARKED = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xE0, 0x250) if len(unicodedata.normalize("NFKD", chr(i))) > 1]
_MARKED = [(a, b) for a, b in _MARKED if a.islower() and b.isascii() and b.isalpha()]
ACCENTED, PLAIN = "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, not for each element of a lambda inside use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(c: Column) -> Column:
    """Lower case without the accents of Latin letters: the fast path of case and accent folding."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def has_invisible(c: Column) -> Column:
    return c.rlike(INVISIBLE)


def scramble_key(word: Column) -> Column:
    """Words that differ in the order of inner letters alone have one key; words under four letters only equal themselves."""
    inner = F.array_join(F.array_sort(F.split(F.substring(word, F.lit(2), F.length(word) - 2), "")), "")
    return F.when(F.length(word) < 4, word).otherwise(F.concat(F.left(word, F.lit(1)), F.right(word, F.lit(1)), F.length(word).cast("string"), inner))


def holds_phrase(words: Column, phrases: list[str]) -> Column:
    """Whether an array of folded words holds one of the phrases, inner letters in any order."""

    def found(keys: Column) -> Column:
        out = F.lit(False)
        for phrase in phrases:
            parts = phrase.split()
            starts = F.when(F.size(keys) >= len(parts), F.sequence(F.lit(1), F.size(keys) - len(parts) + 1)).otherwise(F.array().cast("array<int>"))
            out = out | F.exists(starts, _is_at(keys, parts))
        return out

    return let(F.transform(words, scramble_key), found)


def _is_at(keys: Column, parts: list[str]) -> Callable[[Column], Column]:
    wanted = F.array(*[scramble_key(F.lit(p)) for p in parts])
    return lambda i: F.slice(keys, i, F.lit(len(parts))) == wanted


def risk_score(text: Column, phrases: list[str]) -> Column:
    """0.1 for invisible characters, 0.6 for an injection phrase, 0.8 for one inside an encoded run; at most 1."""
    runs = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(BASE64_RUN), F.lit(0)), lambda x: F.try_to_binary(x, F.lit("base64"))),
        F.transform(F.regexp_extract_all(text, F.lit(HEX_RUN), F.lit(0)), lambda x: F.try_to_binary(x, F.lit("hex"))),
    )
    decoded = F.array_join(F.transform(runs, lambda x: F.coalesce(F.try_validate_utf8(x.cast("string")), F.lit(""))), " ")
    return F.least(
        F.lit(1.0),
        F.when(has_invisible(text), INVISIBLE_RISK).otherwise(0.0)
        + F.when(holds_phrase(tokens(fold(strip_invisible(text))), phrases), PHRASE_RISK).otherwise(0.0)
        + F.when(holds_phrase(tokens(fold(decoded)), phrases), ENCODED_RISK).otherwise(0.0),
    )


def hex_runs(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(HEX_RUN), F.lit(0)), lambda x: F.length(x) % 2 == 0)


def chunk_words(text: Column, size: int = 500) -> Column:
    """Paragraphs packed up to size words; a longer paragraph ends the open chunk and is cut in slices of size words."""
    # Not F.trim itself, whose second argument would be the paragraph's position: the characters to trim.
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    state = "struct<done: array<struct<text: string, tokens: int>>, open: string, n: int>"

    def words(p: Column) -> Column:
        return F.filter(F.split(p, r"\s+"), lambda w: F.length(w) > 0)

    def flush(s: Column) -> Column:
        closed = F.array(F.struct(s["open"].alias("text"), s["n"].alias("tokens")))
        return F.when(s["n"] > 0, F.concat(s["done"], closed)).otherwise(s["done"])

    def step(s: Column, p: Column) -> Column:
        w = words(p)
        n = F.size(w)
        slices = F.transform(F.sequence(F.lit(0), ((n - 1) / size).cast("int")), lambda i: F.struct(F.array_join(F.slice(w, i * size + 1, F.lit(size)), " ").alias("text"), F.least(F.lit(size), n - i * size).alias("tokens")))
        long = F.struct(F.concat(flush(s), slices).alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
        new = F.struct(flush(s).alias("done"), p.alias("open"), n.alias("n"))
        more = F.struct(s["done"].alias("done"), F.concat_ws("\n\n", F.when(s["n"] > 0, s["open"]), p).alias("open"), (s["n"] + n).alias("n"))
        return F.when(n > size, long).when(s["n"] + n > size, new).otherwise(more).cast(state)

    start = F.struct(F.array().alias("done"), F.lit("").alias("open"), F.lit(0).alias("n")).cast(state)
    return F.aggregate(paragraphs, start, step, flush)


def _in(values: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(values)


def language(text: Column, stopwords: dict[str, list[str]], least: int = 3, most_words: int = 2000) -> Column:
    """The language with the most stopword hits in the first words: at least three and no tie, else null."""
    words = F.slice(tokens(text), 1, most_words)
    hits = F.array(*[F.struct(F.size(F.filter(words, _in(s))).alias("n"), F.lit(lang).alias("lang")) for lang, s in sorted(stopwords.items())])

    def best(h: Column) -> Column:
        top = F.array_max(h)
        ties = F.size(F.filter(h, lambda x: x["n"] == F.array_max(h)["n"]))
        return F.when((top["n"] >= least) & (ties == 1), top["lang"])

    return let(hits, best)


def norm_email(c: Column) -> Column:
    v = F.lower(F.regexp_replace(F.trim(c), r"^[<>]+|[<>]+$", ""))
    v = F.regexp_replace(v, "^mailto:", "")
    return F.when(v.rlike(EMAIL), v)


def norm_phone(c: Column, country: str | None = None) -> Column:
    """International form; a national number needs the country's code."""
    raw = F.regexp_replace(F.regexp_replace(F.trim(c), "^tel:", ""), "@.*$", "")
    plus = F.startswith(raw, F.lit("+"))
    digits = F.regexp_replace(F.when(plus, F.replace(raw, F.lit("(0)"), F.lit(""))).otherwise(raw), r"\D", "")
    national = F.concat(F.lit(f"+{country}"), F.substring(digits, F.lit(2), F.length(digits))) if country else F.lit(None).cast("string")
    return (
        F.when(F.length(digits) < 6, F.lit(None))
        .when(plus, F.concat(F.lit("+"), digits))
        .when(F.startswith(digits, F.lit("00")), F.concat(F.lit("+"), F.substring(digits, F.lit(3), F.length(digits))))
        .when(F.startswith(digits, F.lit("0")), national)
        .otherwise(F.concat(F.lit("+"), digits))
    )


def norm_birthday(c: Column) -> Column:
    """MM-DD or YYYY-MM-DD; the years 1604 and 0000 mean none."""
    v = F.trim(c)
    y, m, d = (F.regexp_extract(v, BIRTHDAY, i) for i in (1, 2, 3))
    good = v.rlike(BIRTHDAY) & F.try_to_number(m, F.lit("99")).between(1, 12) & F.try_to_number(d, F.lit("99")).between(1, 31)
    return F.when(good & (y != "") & ~y.isin("1604", "0000"), F.concat_ws("-", y, m, d)).when(good, F.concat_ws("-", m, d))


def norm_name(c: Column) -> Column:
    v = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when((v != "") & norm_email(v).isNull() & ~v.rlike(r"^[+\d\s().-]+$"), v)


def luhn_valid(c: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(c, r"\D", ""))


def iban_valid(c: Column) -> Column:
    """Remainder 1 by 97 of the rearranged digits, 15 to 34 characters."""
    s = F.upper(F.replace(c, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        return F.when(v >= 65, (acc * 100 + v - 55) % 97).otherwise((acc * 10 + v - 48) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch)).cast("int"))
    return F.length(s).between(15, 34) & s.rlike("^[A-Z0-9]+$") & (rest == 1)


def _redact_checked(text: Column, pattern: str, kind: str, good) -> Column:
    """Every match that passes its check gives way to a mark. Matches are cut out in order, so equal strings are one."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), good))
    return F.aggregate(found, text, lambda acc, m: F.replace(acc, m, F.lit(f"[REDACTED:{kind}]")))


def redact_cards(text: Column) -> Column:
    return _redact_checked(text, CARD, "card", luhn_valid)


def redact_ibans(text: Column) -> Column:
    return _redact_checked(text, IBAN, "iban", iban_valid)


def redact_api_keys(text: Column) -> Column:
    return F.regexp_replace(text, API_KEY, "[REDACTED:api_key]")


def redact_passwords(text: Column) -> Column:
    return F.regexp_replace(text, PASSWORD, "$1[REDACTED:password]")


def redact(text: Column) -> Column:
    """All kinds, each on what the one before left: iban, card, api key, password."""
    return redact_passwords(redact_api_keys(redact_cards(redact_ibans(text))))


def fence(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)<(/?\s*data\b)", "&lt;$1")


def locale_number(c: Column) -> Column:
    """The last separator is the decimal one; a lone separator is decimal when one or two digits follow."""
    digits = F.regexp_replace(c, r"[\s  ']", "")
    last = F.regexp_extract(digits, r"([.,])(\d+)$", 1)
    tail = F.regexp_extract(digits, r"([.,])(\d+)$", 2)
    marks = F.length(F.regexp_replace(digits, r"[^.,]", ""))
    kinds = F.size(F.array_distinct(F.regexp_extract_all(digits, F.lit("[.,]"), F.lit(0))))
    decimal = (last != "") & ((kinds == 2) | ((marks == 1) & (F.length(tail) <= 2)))
    whole = F.regexp_replace(F.when(decimal, F.substring(digits, F.lit(1), F.length(digits) - F.length(tail) - 1)).otherwise(digits), "[.,]", "")
    return F.when(decimal, F.concat(whole, F.lit("."), tail)).otherwise(whole).try_cast("double")


def item_id(source: Column, external: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit("\0"), external), 256), 1, 32)


def entity_id(kind: Column, key: Column) -> Column:
    return F.concat(F.lit("e_"), F.substring(F.sha2(F.concat(kind, F.lit("\0"), key), 256), 1, 24))


def next_occurrence(value: Column, today: Column) -> Column:
    """The next date of MM-DD (29 February waits for a leap year) or YYYY-MM-DD, null when past or no date."""
    year = F.year(today)
    annual = F.array_min(F.filter(F.transform(F.sequence(year, year + 5), lambda y: F.try_to_date(F.concat(y.cast("string"), F.lit("-"), value))), lambda d: d >= today))
    once = F.try_to_date(value)
    return F.when(value.rlike(r"^\d\d-\d\d$"), annual).when(value.rlike(r"^\d{4}-\d\d-\d\d$") & (once >= today), once)


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Counts of words by the last byte of their md5, scaled to length one: a deterministic embedding."""
    slots = F.transform(tokens(text), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), -2, 2), 16, 10).cast("int") % dims)

    def scaled(counts: Column) -> Column:
        squares = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
        return let(squares, lambda norm: F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)))

    counts = let(slots, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double")))
    return let(counts, scaled)
