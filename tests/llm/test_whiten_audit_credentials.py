"""Whitening, the filter audit and the secret scan against brute force: nulls, ties, repeated rows, empty tables, odd names."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<double>, __key string, n string"  # clashing names


def exact_whitening(vectors, components=8):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    covariance = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    w = np.array(y, float) / n @ axes[:, order] / np.sqrt(values[order])
    return [sum(v * v for v in r) for r in y], w, values[order] / covariance.trace()


def test_whitening_equals_exact_arithmetic(spark):
    from citegraph.llm.whiten import whiten

    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(90, 10)) * np.arange(1, 11)).tolist()
    rows = [(i, v, "k", "m") for i, v in enumerate(vectors)]
    odd = [None, [None] * 10, [1.0, math.nan] + [0.0] * 8, [math.inf] + [0.0] * 9, [1e300] * 10]
    rows += [(900 + i, v, "k", "m") for i, v in enumerate(odd)] + [(None, vectors[0], "k", "m"), (3, vectors[3], "k", "m")]
    got = whiten(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    kept = [*vectors, vectors[0], vectors[3]]
    deviation, w, explained = exact_whitening(kept)
    assert len(got) == 8 * len(kept) and {r.n for r in got} == {len(kept)}
    of = {(r.vec_id, r.component): r for r in got}
    signs = [math.copysign(1, of[0, c + 1].whitened * w[0, c]) for c in range(8)]
    for i in range(len(vectors)):
        for c in range(8):
            r = of[i, c + 1]
            assert r.deviation == deviation[i] and r.whitened == pytest.approx(signs[c] * w[i, c], abs=1e-9) and r.explained == pytest.approx(explained[c], rel=1e-9)
    assert sum(r.vec_id == 3 for r in got) == 16 and of[None, 1].whitened == of[0, 1].whitened
    assert 0 <= got[0].identity_error < 1e-9


def test_whitening_of_large_short_constant_and_no_vectors(spark):
    from citegraph.llm.whiten import LARGEST, whiten

    large = [[2.0**50, 1.0], [-(2.0**50), 2.0], [2.0**49, -3.0], [2.0, 2.0**48]]
    frame = lambda vectors: spark.createDataFrame([(i, v, "", "") for i, v in enumerate(vectors)], VECTORS)
    deviation, _, _ = exact_whitening(large)
    assert max(deviation) > LARGEST and {(r.vec_id, int(r.deviation)) for r in whiten(frame(large)).collect()} == set(enumerate(deviation))
    ragged = [[0.5, 1.0, 2.0], [1.5], [], [2.0, -1.0], [0.25, 0.0, 1.0]]
    padded = [[*v, *[0.0] * (3 - len(v))] for v in ragged]
    got = {(r.vec_id, r.component): r for r in whiten(frame(ragged).repartition(4)).collect()}
    deviation, w, _ = exact_whitening(padded)
    assert len(got) == 15 and all(got[i, c + 1].deviation == deviation[i] and abs(got[i, c + 1].whitened) == pytest.approx(abs(w[i, c]), abs=1e-9) for i in range(5) for c in range(3))
    for same in ([[1.0, 2.0]], [[1.0, 2.0]] * 3):
        assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in whiten(frame(same)).collect()} == {(0, None, None, None)}
    flat = whiten(frame([[1.0, 5.0], [2.0, 5.0]])).collect()  # one direction varies
    assert {r.component for r in flat if r.whitened is not None} == {1} and flat[0].identity_error < 1e-9
    assert whiten(frame([None])).collect() == [] and whiten(frame([[]])).collect() == [] and whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_residues_carry_any_integer():
    from citegraph.llm.whiten import primes_below, primes_for, reconstructed

    rng = random.Random(2)
    for bits in (4, 30, 90, 200):
        bound = 2**bits
        primes = primes_for(bound)
        assert math.prod(primes) > 2 * bound and math.prod(primes[1:]) <= 2 * bound * max(primes) and len(set(primes)) == len(primes)
        values = [bound, -bound, 0, *(rng.randint(-bound, bound) for _ in range(50))]
        residues = np.array([[v % p for v in values] for p in primes])
        assert reconstructed(residues, primes).tolist() == values
    first = list(itertools.islice(primes_below(), 3))
    assert first == [1048573, 1048571, 1048559]


DOCS = "doc_id long, text string, lang string, part string, A string, digest string"


def audit_docs():
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "delta", "e", "#", "ÄÖ", "fin"]
    texts = [None, "", " \n\t ", "one", "X" * 300, "$ " * 250]
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice([5, 150, 199, 200, 230]))) for _ in range(40)]
    texts += [" ".join(f"w{i}" for i in range(250)), " ".join(f"W{i} |" for i in range(250)), " ".join(f"w{i}" for i in range(250))]
    rows = [(i, t, rng.choice(["en", "de", None, ""]), "p", "a", "d") for i, t in enumerate(texts)]
    again = [(100 + i, rng.choice(rows)[1], rng.choice(["en", "de"]), "p", "a", "d") for i in range(30)]
    return [*rows, *again, rows[7], rows[7], (None, rows[8][1], "en", "p", "a", "d")]


def brute_audit(rows, good, toxic):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if d[1][f]]
                alive = [d for d in alive if not d[1][f]]
                failing = sum(d[1][f] for d in own)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                out[part, "".join(order), step] = [len(alive), len(gone), failing - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_matches_brute_force_and_sql(spark):
    import duckdb
    import pandas as pd

    from citegraph.llm.audit import OP12_SQL, edges, report, text_failures

    rows = audit_docs()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 130, 2)] + [(1, 0, 0), (1, 1, 1), (7, 1, None), (None, 1, 1), (5000, 1, 1)]
    good = {1, 7} | {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {1} | {i for i, _, t in labels if t == 1 and i is not None}
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lost = ["good_lost", "toxic_lost"]
    found = edges(text_failures(spark.createDataFrame(rows, DOCS).repartition(3), marks), list("ABCDE"), "part", lost)
    assert found.count() == 3 * 80  # unordered states: 5 * 16 edges a part
    names = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in report(found, list("ABCDE"), lost).collect()}
    want = brute_audit(rows, good, toxic)
    assert len(got) == 1800 and got == want
    db = duckdb.connect()
    for name, data, columns in (("documents", rows, DOCS), ("labels", labels, "doc_id long, quality int, toxic int")):
        db.register(name, pd.DataFrame(data, columns=[c.split()[0] for c in columns.split(", ")]).convert_dtypes())
    cursor = db.execute(OP12_SQL)
    at = [d[0] for d in cursor.description]
    sql = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in (dict(zip(at, x, strict=True)) for x in cursor.fetchall())}
    assert sql == want


def test_audit_of_other_filters_and_of_nothing(spark):
    from citegraph.llm.audit import edges, report, text_failures

    rows = spark.createDataFrame([("a", True, None), ("a", True, True), ("b", False, True)], "p string, short boolean, odd boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in report(edges(rows, ["short", "odd"], "p", []), ["short", "odd"], []).collect()}
    assert got["a", "shortodd", 1] == (0, 2, 3) and got["a", "oddshort", 1] == (1, 1, 1) and got["b", "shortodd", 2] == (0, 1, 2) and len(got) == 8
    none = text_failures(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert report(edges(none, list("ABCDE"), "part", ["good_lost"]), list("ABCDE"), ["good_lost"]).count() == 0


TEXTS = "doc_id long, text string, spans string, __text string"


def plain_spans(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def secret_texts(rng):
    value = lambda n, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n))
    upper = "ABCDEFGHJKLMNPQRSTUVWXYZ234567"
    made = [f"so the password={value(18)} was é {value(40)} used" for _ in range(60)]
    made += [f"key AKIA{value(16, upper)}, then Secret: '{value(18)}'" for _ in range(60)]
    made += [" ".join(value(rng.randint(3, 14), "etaoinshrdlu") for _ in range(30)) + f" 4{value(15, '0123456789')} host{value(1, '123')}.example.com" for _ in range(60)]
    odd = [None, "", "password=short", "password=abc", "api_key = \"abcdef\"", "APIKEY:xyzxyz token= tok", "AKIA" * 30, "f" * 30_000, "ſecret=abcdefg", "passİword=abcdefgh token=abcdefgh", "x" * 23 + "a" * 24 + "-" + "b" * 24]
    return made + odd


def test_patterns_counts_and_digests(spark):
    from citegraph.llm.credentials import base_spans, op13_secret_scan

    rng = random.Random(8)
    pieces = ["password", "PASSWD", "token", "api_key", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH2345", "deadbeef00112233", "é", "\n", "zz", "-", "secret", "_"]
    for _ in range(3_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert base_spans(text)[0] == plain_spans(text)
    texts = secret_texts(rng)
    for t in texts:
        assert base_spans(t or "")[0] == plain_spans(t)
    assert op13_secret_scan


def test_formats_find_what_no_pattern_does(spark, tmp_path):
    from citegraph.llm.credentials import find, op13_secret_scan

    rng = random.Random(9)
    bare = "".join(rng.choice("0123456789abcdef") for _ in range(18))
    texts = [*secret_texts(rng), f"here {bare} stands alone", f"here {bare} stands alone", "internationalization of 4111111111111111 at mail3.example.com"]
    frame = spark.createDataFrame([(i if i else None, t, "s", "t") for i, t in enumerate(texts)], TEXTS).repartition(3)
    got = {r.doc_id: r.spans for r in find(frame, [frame["doc_id"], frame["__text"]]).collect()}
    assert len(got) == len(texts)
    added = {(i, tuple(s)) for i, own in got.items() for s in own if s["kind"] == "grammar"}
    n = len(texts)
    assert added == {(n - 3, ("grammar", 5, 23)), (n - 2, ("grammar", 5, 23))}
    frame.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op13_secret_scan(spark, str(tmp_path)).collect():
        base = plain_spans(texts[r.doc_id or 0])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == s[0] for s in base) for k in ("assign", "access", "hex"))
        assert r.spans == (f"grammar:5:23" if r.n_grammar else joined)
    assert find(spark.createDataFrame([], TEXTS), []).count() == 0
    only = spark.createDataFrame([(1, f"{bare} 1234567890123"), (2, None)], "doc_id long, text string")  # nothing to learn from
    assert all(r.spans == [] for r in find(only, [only["doc_id"]]).collect())


def test_automata_are_distributions_and_merge_like_states():
    from citegraph.llm.credentials import STOP, SYMBOLS, Automaton, Tree

    rng = random.Random(3)
    strings = ["AKIA" + "".join(rng.choice("ABCDEFGH") for _ in range(12)) for _ in range(300)]
    tree = Tree(strings)
    assert sum(tree.stops[s] for s in tree.red) == 300 and len(tree.red) < 60  # from some thousand states
    assert sum(sum(tree.seen[s].values()) for s in tree.red) == 16 * 300  # merging keeps every count
    a = Automaton.of(strings)
    assert np.allclose((2**-a.bits).sum(1), 1) and a.bits.shape[1] == STOP + 1
    tokens = ["AKIAABCDEFGH", "zz", "", "AKIA" * 50]
    for t, cost in zip(tokens, a.cost(tokens), strict=True):
        state, total = 0, 0.0
        for c in t:
            total, state = total + a.bits[state, SYMBOLS.index(c)], a.next[state, SYMBOLS.index(c)]
        assert cost == pytest.approx(total + a.bits[state, STOP])
    mixed = Tree(["ab"] * 40 + ["b"] * 40)
    assert len(mixed.red) >= 2 and mixed.total(mixed.red[0]) >= 80
