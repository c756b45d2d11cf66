"""The ten operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, empty tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, n_words long, row string, __text string"  # clashing names
PROSE = "The old house by the river was sold to a man from the city who has never lived in it and does not want to. "


def rows(*texts):
    return [(i, t, -1, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = [None, "", "  \n\t ", "one", "é" * 5, PROSE * 3, "a b c d e f g h " * 4, "# # # * " * 20, "word " * 30_000]
    made = rows(*odd)
    return spark.createDataFrame([*made, made[5], (None, "no id here", 1, "r", "t")], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_measures_and_rules(spark, docs):
    from citegraph.llm.quality import apply_rules, quality_measures, verdict

    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.n_symbols): r for r in quality_measures(docs, [docs["doc_id"]]).collect()}
    assert (0, 0, 0, 0) in got and (1, 0, 0, 0) in got and (2, 0, 0, 0) in got
    assert (6, 32, 32, 0) in got and (7, 80, 80, 80) in got and (8, 30_000, 30_000, 0) in got
    for text in ("a b c d e f g h i a b c d e f g h j", "x y " * 9 + "z", PROSE + "q " + PROSE):
        words = text.split()
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
        one = quality_measures(spark.createDataFrame([(0, text)], "doc_id long, text string"), []).first()
        assert one.n_repeat_words == len(covered)
    kept = apply_rules(docs)
    assert kept.columns == docs.columns and kept.count() == 0  # the prose repeats itself
    clean = spark.createDataFrame(rows(PROSE + "There is more in the letters that he wrote."), SCHEMA)
    assert apply_rules(clean).count() == 1 and apply_rules(empty(spark)).count() == 0
    assert verdict()


@pytest.mark.parametrize("limit", [30, 100, 1000, 10**9])
def test_shards_fit_and_split_only_where_needed(spark, limit):
    from citegraph.llm.sharding import extendible_shards

    rng = random.Random(3)
    texts = ["x" * rng.randint(0, 60) for _ in range(200)]
    frame = spark.createDataFrame([*rows(*texts), *[(7, "y" * 20, 0, "", "")] * 50, (None, None, 0, "", "")], SCHEMA)
    got = extendible_shards(frame, limit=limit).collect()
    assert len(got) == 251
    sums = Counter()
    for r in got:
        sums[r.depth, r.prefix] += r.n_bytes
    for r in got:
        assert sums[r.depth, r.prefix] == r.shard_bytes and (r.shard_bytes <= limit or r.oversized)
    assert extendible_shards(empty(spark), limit=limit).count() == 0


def test_one_key_with_many_rows_loses_none(spark):
    from citegraph.llm.sharding import BITS, _shards, extendible_shards

    frame = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 60).alias("text")).unionByName(spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("y" * 90).alias("text")))
    got = _shards(frame, "doc_id", "text", 100).select("key", "n_bytes", "depth", "prefix", "shard_bytes", "oversized").collect()
    sums = Counter()
    for r in got:
        sums[r.depth, r.prefix] += r.n_bytes
    assert len(got) == 20_500 and sum(r.key is None for r in got) == 500 and all(sums[r.depth, r.prefix] == r.shard_bytes <= 100 for r in got)
    assert max(r.depth for r in got) > BITS  # two rows shared all 62 bits
    assert extendible_shards(frame, limit=10).where("oversized").count() == 20_500


def test_shards_match_sql(spark, tmp_path):
    import duckdb

    from citegraph.llm.sharding import extendible_shards, shards_sql

    texts = ["z" * (i % 37) for i in range(300)]
    frame = spark.createDataFrame(rows(*texts), SCHEMA).select("doc_id", "text")
    db = duckdb.connect()
    documents = frame.toPandas()
    db.register("documents", documents)
    want = sorted(db.execute(shards_sql(500)).fetchall())
    names = [d[0] for d in db.description]
    assert sorted(tuple(r[n] for n in names) for r in extendible_shards(frame, limit=500).collect()) == want


def test_token_counts_and_ids_are_the_library_s(spark, docs):
    from tokenizers import Tokenizer

    from citegraph.llm import packing, tokens

    path = tokens.vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    letters = "aAbBtheΣσ'’sS1٣²_-$é́<|>\n \t\x1f\xa0😀ßİ"
    texts = ["<|endoftext|>", "a<|startoftext|>b", "don't WE'LL", "$" * 400 + "a" * 300, "\x1cfoo\x85bar\xa0q", *["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.count_tokens(texts, path) == list(map(len, want))
    assert [np.frombuffer(b, np.uint32).tolist() for b in packing.token_bytes(texts, path)] == want
    got = {r.doc_id: r for r in tokens.token_counts(docs, path).collect()}
    assert got[0].n_bytes == got[0].n_tokens == 0 and got[8].over_limit and got[None].n_tokens == 3
    assert tokens.token_counts(empty(spark), path).count() == 0


def test_packing_places_every_piece_once(spark, docs):
    from citegraph.llm import packing, tokens

    path = tokens.vocabulary_path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, capacity=64).collect()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    own = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 8)
    assert sum(x[2] for x in own) == 30_001 and own[0] == (0, 0, 64)
    assert next(r for r in got if r.doc_id == 0).ids_crc32 == zlib.crc32(b"\0\0\0\0")
    assert packing.pack_documents(empty(spark), path).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "mid", "few", "one"])
def test_plan_is_whole_and_tight(kind):
    from citegraph.llm.packing import best_plan

    rng = np.random.default_rng(1)
    lengths = {"uniform": rng.integers(1, 2049, 5000), "mid": rng.integers(600, 1000, 900), "few": rng.integers(1, 2049, 12), "one": np.full(1000, 700)}[kind]
    counts = np.bincount(lengths, minlength=2049)
    plan = best_plan(counts)
    used, placed = np.zeros(plan.sequences, int), np.zeros(2049, int)
    for length, _, n, first, _ in plan.intervals:
        used[first : first + n] += length
        placed[length] += n
    assert (placed == counts).all() and used.max() <= 2048 and used.min() > 0
    if kind == "uniform":
        assert plan.sequences <= 1.02 * lengths.sum() / 2048 + 1
    if kind == "one":
        assert plan.sequences == 500


def classes_by_brute_force(texts):
    """The least row of each row's class: all pairs of sets of five-word runs."""

    def runs(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [runs(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        same = (texts[i] or "") == (texts[j] or "")
        if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return find


def test_near_duplicates_match_brute_force(spark):
    from citegraph.llm.neardup import keep_one, near_duplicates

    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    bases = [[rng.choice(words) for _ in range(rng.randint(3, 120))] for _ in range(40)]
    texts = []
    for b in bases:
        for _ in range(rng.randint(1, 6)):
            own = list(b)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [None, "", "", texts[0], texts[0].upper(), " ", "one", "one"]
    frame = spark.createDataFrame(rows(*texts), SCHEMA)

    find = classes_by_brute_force(texts)
    classes, _ = near_duplicates(frame)
    from citegraph.llm.neardup import _keyed

    got = {r.id: r.class_id for r in _keyed(frame, "doc_id", "text").join(classes.withColumnRenamed("text_key", "key"), "key").collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})
    assert keep_one(empty(spark)).count() == 0


def test_large_groups_of_near_copies_lose_no_link(spark):
    from citegraph.llm.neardup import _keyed, near_duplicates

    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(110)]
    texts = [" ".join(base)]
    for _ in range(420):
        own = list(base)
        for _ in range(rng.randint(1, 5)):  # some changes are shared by copies, so that links run past the first text
            at = rng.randrange(12) * 9 if rng.random() < 0.6 else rng.randrange(len(own))
            change, at = rng.random(), min(at, len(own) - 1)
            if change < 0.6:
                own[at] = f"x{rng.randrange(3)}" if rng.random() < 0.7 else rng.choice(words)
            elif change < 0.8:
                del own[at : at + rng.randint(1, 12)]
            else:
                own.insert(at, rng.choice(words))
        texts.append(" ".join(own))
    find = classes_by_brute_force(texts)
    frame = spark.createDataFrame(rows(*texts), SCHEMA)
    classes, links = near_duplicates(frame)
    got = {r.id: r.class_id for r in _keyed(frame, "doc_id", "text").join(classes.withColumnRenamed("text_key", "key"), "key").collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    sizes = Counter(got.values()).values()
    assert max(sizes) > 100 and len(sizes) > 20 and links.count() < 8 * len(texts)


def rows_of_joins(spark, keys):
    """The most rows that a join by these first keys has made since the session began."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" not in node.name() or not re.search(keys, node.desc()):
                continue
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                made = values.get(metric.accumulatorId()) if metric.name() == "number of output rows" else None
                most = max(most, int(made.get().replace(",", ""))) if made is not None and made.isDefined() else most
    return most


def test_copies_that_lost_passages_are_not_compared_in_pairs(spark):
    from citegraph.llm.neardup import _keyed, near_duplicates

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for _ in range(500):
        own, at = list(base), rng.randrange(100)
        del own[at : at + rng.randint(5, 50)]
        own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    frame = spark.createDataFrame(rows(*texts), SCHEMA)
    classes, _ = near_duplicates(frame)
    got = {r.id: r.class_id for r in _keyed(frame, "doc_id", "text").join(classes.withColumnRenamed("text_key", "key"), "key").collect()}
    find = classes_by_brute_force(texts)
    assert got == {i: find(i) for i in range(len(texts))}
    assert rows_of_joins(spark, r"\[p#\d+, e#\d+L?") < 125 * len(texts)


def test_signatures_estimate_weighted_similarity():
    from citegraph.llm.neardup import signature

    x, y = np.array([0.5, 2.5, 3.0, 1.0]), np.array([1.0, 2.0, 3.0, 0.25])
    elements = np.arange(4).astype(np.uint64) * np.uint64(7919)
    hits = [(signature(elements + np.uint64(i * 100003), x) == signature(elements + np.uint64(i * 100003), y)).mean() for i in range(80)]
    assert abs(np.mean(hits) - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


def test_main_text():
    from citegraph.llm.html import main_text, minimum_cut

    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies.</div>"
        "<article><h1>A  title</h1><p>Some <b>bold</b> text &amp; a <a href=x>link</a> in a long\nsentence of prose.<p>More &eacute; text<br>goes on here.</article>"
        "<aside>Side</aside><div id=comments><p>I liked this whole long article very much indeed.</p></div><form><p>Mail</p></form><footer>End</footer></body></html>"
    )
    assert main_text(page) == "A title\nSome bold text & a link in a long sentence of prose.\nMore é text goes on here."
    assert main_text("") == main_text("<nav>x</nav>") == "" and main_text("<p>cut off in a ta<b") == "cut off in a ta"
    rng = random.Random(4)
    for _ in range(60):  # the cut against all labellings
        n = rng.randint(1, 7)
        s, t = [rng.random() for _ in range(n)], [rng.random() for _ in range(n)]
        ties = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda own: sum(t[i] if own[i] else s[i] for i in range(n)) + sum(w for a, b, w in ties if own[a] != own[b])  # noqa: B023, E731
        assert math.isclose(cost(minimum_cut(s, t, ties)), min(map(cost, itertools.product([False, True], repeat=n))), abs_tol=1e-9)


def test_main_text_judges_blocks_not_inline_runs():
    from citegraph.llm.html import main_text

    prose = "a long text of the article that goes on for a while."
    for inline in ("<span class='tag'>New</span>", "<a class='share' href=x>Share</a>", "<span hidden>x</span>", "<b aria-hidden='true'>x</b>", "<i style='display:none'>x</i>"):
        assert main_text(f"<p>{inline} Here is {prose}</p>") == main_text(f"<p>Here is {prose} {inline}</p>") == f"Here is {prose}"
    for name in ("layout has-sidebar", "no-sidebar", "layout--with-sidebar", "page without-ads"):
        assert main_text(f"<div class='{name}'><p>Here is {prose}</p></div>") == f"Here is {prose}"
    assert main_text(f"<div class='sidebar no-print'><p>Here is {prose}</p></div>") == main_text(f"<div hidden><p>Here is <b>{prose}</b></p></div>") == ""
    formula = "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='application/x-tex'>x=1</annotation></math>"
    assert main_text(f"<p>Where {formula} is {prose}</p>") == f"Where x=1 is {prose}"


WRAPPERS = [
    "<form id=aspnetForm>{}</form>", '<div class="wrapper right-sidebar">{}</div>', '<div class="site sidebar-right"><article>{}</article></div>', '<div class="post comments-open">{}</div>',
    '<div class="post category-promo">{}</div>', '<div class="nav-collapsed">{}</div>', '<div class="legal">{}</div>', '<div class="modal-open">{}</div>', '<form action="/"><div class="social"><main>{}</main></div></form>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_wrapper_s_name_does_not_hide_the_article(wrapper):
    from citegraph.llm.html import main_text

    lines = ["The house by the river", *(f"Paragraph {i} of the article has a dozen words or so and it ends with a stop." for i in range(6))]
    article = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{t}</p>" for t in lines[1:])
    menu = '<ul class="menu"><li><a href=x>Home</a><li><a href=y>About us</a></ul><form><p>Search for words on all of the pages of this site here.</p><input></form>'
    rest = '<div class="sidebar"><p>Our books are very good and cheap this week, and they have many pages.</p></div>'
    rest += '<div class="comments"><article class="comment-body"><p>This reader is sure that the article is wrong in several ways, really.</p></article></div>'
    for page in (menu + wrapper.format(article) + rest, wrapper.format(menu + article + rest), menu + wrapper.format(article + rest)):
        assert main_text(f"<html><body>{page}<footer><p>All rights are with the owner of the pages.</p></footer></body></html>").split("\n") == lines


def test_named_blocks_beside_the_article_stay_out():
    from citegraph.llm.html import main_text

    long = "".join(f"<p>Remark {i} by a reader who has a lot of time and fills the page with it.</p>" for i in range(30))
    assert main_text(f"<h1>A short one</h1><p>Only this paragraph was written by the author of the page.</p><div id=comments>{long}</div>").split("\n")[-1].startswith("Only this")
    notice = '<div class="cookie-notice"><p>We use cookies on this site and on all the others that we have as well.</p></div>'
    assert main_text(f"<nav><a href=x>Home</a></nav>{notice}") == ""


def test_html_operator_rows(spark):
    from citegraph.llm.html import extract

    frame = spark.createDataFrame([(1, "u", None, "a"), (None, None, "<p>Hello you all there.</p>", "b")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(frame).collect()) == [(0, "Hello you all there.", 20), (1, "", 0)]


def test_leaks_are_found_and_verified(spark):
    from citegraph.llm.decontaminate import Index, Known, drop_leaks, find_leaks

    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("an", "el", "ir", "ot", "um", "ax", "en")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{text(rng.randint(12, 30))}. {text(6)}") for i in range(60)]
    texts = [text(300) for _ in range(40)]
    for i in range(0, 40, 4):
        texts[i] = f"{texts[i]} {items[i][1].upper()}\n{texts[i]}"
    texts += [items[5][1].split(". ")[0] + " " + text(100), None, "", items[7][1]]
    frame = spark.createDataFrame(rows(*texts), SCHEMA)
    bench = spark.createDataFrame([*items, (60, None), (61, "one")], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in find_leaks(frame, bench, ["doc_id"]).collect()}
    assert all(got[i] == ([i] if i % 4 == 0 else []) for i in range(40))
    assert got[40] == [] and got[41] == got[42] == [] and got[43] == [7]  # a question without its answer is no leak
    assert drop_leaks(frame, bench).columns == frame.columns and drop_leaks(frame, bench).count() == len(texts) - 11
    assert find_leaks(empty(spark), bench, ["doc_id"]).count() == 0
    assert drop_leaks(frame, bench.where("false")).count() == len(texts)
    index, known = Index(items), None
    known = Known(index.vocabulary)
    assert index.search(["", "x y z"], known) == [{}, {}]


@pytest.mark.parametrize("limit", [32 << 20, 200])
def test_leaks_of_items_with_null_and_text_ids(spark, monkeypatch, limit):
    from citegraph.llm import decontaminate

    monkeypatch.setattr(decontaminate, "INDEX_BYTES", limit)
    sentence = lambda w: " ".join(f"{w}{i}" for i in range(20)) + f". {w} answer is here now"
    items = [("b", sentence("one")), (None, sentence("two")), ("a", sentence("three")), ("a", sentence("three"))]
    texts = [sentence("two") + " " + sentence("one"), sentence("three"), "nothing of it", None]
    for kind, of in (("string", str), ("long", lambda x: ord(x))):
        bench = spark.createDataFrame([(i if i is None else of(i), t) for i, t in items], f"item_id {kind}, text string")
        got = {r.doc_id: r.item_ids for r in decontaminate.find_leaks(spark.createDataFrame(rows(*texts), SCHEMA), bench, ["doc_id"]).collect()}
        assert got == {0: [of("b"), None], 1: [of("a")], 2: [], 3: []}


def test_block_max_retrieval_is_exact():
    from citegraph.llm.decontaminate import THRESHOLD, Index

    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 12)))) for i in range(90)]
    index = Index(items)
    passage, term = [], []
    for p in range(50):
        for t in rng.sample(range(len(index.codes)), rng.randint(1, 30)):
            passage.append(p)
            term.append(t)
    got = {(p, i): s for p, i, s in index.retrieve(np.array(passage), np.array(term))}
    want = Counter()
    for p, t in zip(passage, term, strict=True):
        for k in range(index.start[t], index.start[t + 1]):
            want[p, int(index.item[k])] += index.impact[k]
    want = {k: v for k, v in want.items() if v >= THRESHOLD}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_field_marginals_match_enumeration():
    from citegraph.llm.toxicity import Field

    field = Field({}, [0.1, -1.3, 0.2, 0.4], [0.0] * 4)
    for places, weights, n in (([0], [1.2], 1), ([1, 4], [2.0, -0.5], 7), ([0, 1, 6], [0.3, 1.5, 2.5], 7), ([5], [0.7], 6)):
        evidence = dict(zip(places, weights, strict=True))
        total, toxic = 0.0, [0.0] * n
        for states in itertools.product((0, 1), repeat=n):
            score = sum(evidence.get(i, 0.0) for i in range(n) if states[i]) + sum(field.steps[a, b] for a, b in itertools.pairwise(states))
            total += math.exp(score)
            for i in range(n):
                toxic[i] += states[i] * math.exp(score)
        got, _, _ = field.passes(places, weights, n)
        assert np.allclose(got, [toxic[p] / total for p in places])


def test_toxicity_learns_words(spark):
    from citegraph.llm.toxicity import drop_toxic, score_documents, train

    rng = random.Random(0)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "r", "st")]
    texts, labels = [], []
    for i in range(300):
        own = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            for _ in range(4):
                own[rng.randrange(60)] = rng.choice(["scoundrel", "knavery"])
        texts.append(" ".join(own))
        labels.append((i, int(i % 3 == 0)))
    frame = spark.createDataFrame(rows(*texts, None, ""), SCHEMA)
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_documents(frame, train(frame, known), ["doc_id"]).collect()}
    assert all((got[i].score >= 0.5) == (i % 3 == 0) for i in range(300)) and got[300].score < 0.5
    span = got[0].spans[0]
    assert texts[0][span.start : span.end] in ("scoundrel", "knavery")
    assert drop_toxic(frame, known).count() == 202 and drop_toxic(frame, known.where("false")).count() == 302
    assert drop_toxic(empty(spark), known).count() == 0


def test_url_parts_rules_and_segmentation(spark):
    from citegraph.llm.urls import Segmenter, judge, unigrams

    urls = ["http://A.Example.COM/en/7?x", "https://x.example.net/de/81#a", "http://y.net/de/", "q.org/es/", None, "ftp://ORG/es/1", "http://freecasinobets.test/p", "http://daily-news.test/page"] + [f"http://casino{i}.win.test/" for i in range(9)] + [f"http://gardenclub{i}.test/page" for i in range(40)]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in judge(frame).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(6)] == [
        ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("x.example.net", "/de/81", "example.net/de/8", "block"),
        ("y.net", "/de/", "net/de/", "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("org", "/es/1", "org/es/", "block"),
    ]
    assert got[6].verdict == "block" and got[7].verdict == "allow"
    assert Segmenter(unigrams()).split("freecasinobets") == ["free", "casino", "bets"]


def test_ppm_probabilities(spark):
    from citegraph.llm import ppm

    words, c = [b"abra", b"cadabra", b"abc", b"the", b"then", b"thin", b"a"], np.array([5, 3, 2, 10, 4, 1, 7])
    keys, n = ppm.context_counts(words, c)
    ends = [ppm._key(np.array([ppm.START, ppm.DOCUMENT]), np.array([1]), o)[0] for o in (0, 1)]
    keys, n = np.r_[keys, ends], np.r_[n, [4, 4]]
    for least in (1, 4):
        trie = ppm.Trie(keys[n >= least], n[n >= least])
        for context in (b"", b"a", b"abr", b"th", b"zz", b"thx", b"cadab"):
            total = 0.0
            for s in range(ppm.ALPHABET):
                own = np.array([ppm.START, *context, s])
                total += 10 ** trie._code(own, np.arange(len(own)))[-1]
            assert abs(total - 1) < 1e-9
    texts = ["The cat and the dog", None, "", "the THE\tthe", "zebra"] * 3
    frame = spark.createDataFrame(rows(*texts), SCHEMA)
    train = frame.where("doc_id < 10").selectExpr("coalesce(text, '') AS text")
    got = {r.doc_id: r for r in ppm.score(frame, ppm.train(train), ["doc_id"]).collect()}
    counts = Counter(w for t in texts[:10] for w in (t or "").lower().split())
    counts["\n"] = 10
    total, types = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        own = [*(t or "").lower().split(), "\n"]
        assert got[i].n_tokens == len(own) and got[i].n_known == sum(counts[w] > 0 for w in own)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own), rel_tol=1e-9)
        assert got[i].score < 0
    assert ppm.score(empty(spark), ppm.train(train.where("false")), ["doc_id"]).count() == 0


def test_ppm_keeps_rare_contexts(spark):
    from citegraph.llm import ppm

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.8 else "".join(rng.choices("abcde", k=5)) for _ in range(60)) for _ in range(30)]
    frame = spark.createDataFrame(rows(*texts, "zzz abcde", "é the"), SCHEMA)
    train = frame.where("doc_id < 20").select("text")
    got = [{r.doc_id: r.score for r in ppm.score(frame, ppm.train(train, share), ["doc_id"]).collect()} for share in (1e-6, 0.02)]
    assert got[0].keys() == got[1].keys() and all(math.isclose(got[0][i], got[1][i], rel_tol=1e-9) for i in got[0])
    grams = Counter(ppm.grams([ppm.stream(ppm.split(t)) for t in texts[:20]])[0].tolist())
    assert {r.key: r.n for r in ppm.train(train).grams.collect()} == grams


def test_ppm_contexts_cross_words(spark):
    from citegraph.llm import ppm

    def stream(text):
        return [*(ppm.END if c == 32 else c for c in "".join(w + " " for w in text.lower().split()).encode()), ppm.DOCUMENT]

    texts = ["the old house by the river", "the old man and the old house", "by the river a man", "a b a b a b", "", "é à é"]
    seen = {}
    for t in texts:
        own = [ppm.START, *stream(t)]
        for i in range(1, len(own)):
            for k in range(min(i, ppm.ORDER) + 1):
                seen.setdefault(tuple(own[i - k : i]), Counter())[own[i]] += 1

    def log(text):
        own, total = [ppm.START, *stream(text)], 0.0
        for i in range(1, len(own)):
            out, p = set(), 1.0
            for k in range(min(i, ppm.ORDER), -1, -1):
                left = {s: c for s, c in seen.get(tuple(own[i - k : i]), {}).items() if s not in out}
                if not left:
                    continue
                weight = sum(left.values()) + len(left)
                if own[i] in left:
                    p *= left[own[i]] / weight
                    break
                p *= len(left) / weight
                out |= set(left)
            else:
                p /= ppm.ALPHABET - len(out)
            total += math.log10(p)
        return total

    new = [*texts, "the river house", "house river the", "the old house the old house the old house", "zebra \t zoo", None]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.doc_id: r.score for r in ppm.score(spark.createDataFrame(rows(*new), SCHEMA), ppm.train(train), ["doc_id"]).collect()}
    assert len(got) == len(new) and all(math.isclose(got[i], log(t or ""), rel_tol=1e-9) for i, t in enumerate(new))
    assert got[6] != got[7]


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "decontamination", "best_fit_packing"]


def test_the_cut_mends_what_the_classifier_gets_wrong():
    from citegraph.llm.html import blocks, costs, main_text

    prose = "The old house by the river was sold to a man from the city who has never lived in it, and does not want to."
    links = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(4))
    inside = f"<html><body><div><h1>The house</h1><p>{prose}</p><p>Quite so</p><p>{prose}</p><div>and more</div><p>{prose}</p></div></body></html>"
    alone = [a > b for a, b in (costs(x, False) for x in blocks(inside))]
    assert alone == [True, True, False, True, False, True]  # short lines look like boilerplate, but not among prose
    assert main_text(inside).split("\n") == ["The house", prose, "Quite so", prose, "and more", prose]
    outside = f"<body><ul>{links}<li>A short remark that stands alone among them here.</li>{links}</ul><div><p>{prose}</p><p>{prose}</p></div></body>"
    found = blocks(outside)
    assert costs(found[4], False)[0] > 0 and main_text(outside).split("\n") == [prose, prose]


def test_tags_are_read_as_browsers_do():
    from citegraph.llm.html import main_text

    assert main_text('<p title="a"b">Hello to the first.</p><p title="c"d">Hello to the second.</p>') == "Hello to the first.\nHello to the second."
    assert main_text("<p data-x=it's>Hello to all of you.</p><p>Don't you go away.</p>") == "Hello to all of you.\nDon't you go away."
    for name in ("side-by-side", "related-work", "legal-history", "post-header"):
        assert main_text(f"<article><div class={name}><p>Here is a text of the article.</p></div></article>") == "Here is a text of the article."
    deep = "<div>" * 3000 + "<p>A sentence at the bottom of it.</p>" + "</div>" * 3000
    assert main_text(deep) == "A sentence at the bottom of it." and main_text("<p>Some words here.</p>" + "<p title='" * 3000) == "Some words here."
    assert main_text("1 < 2 is true, and so is 3 </4 here.") == "1 < 2 is true, and so is 3"  # a bogus comment to the end


def test_url_words_generalise(spark):
    from citegraph.llm.urls import Segmenter, judge, unigrams

    urls = [f"http://casinolounge{i}.test/x" for i in range(30)] + [f"http://green{w}{i}.test/x" for w in ("market", "garden", "field") for i in range(60)]
    urls += [f"http://a{i}.test/farmers/market/lounge/field" for i in range(5)] + ["http://lounge-lounge.test/x", "http://farmersmarket.test/x", "http://trackandfield.test/x", None, ""]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in judge(frame).collect()}
    assert len(got) == len(urls) and all(got[i].verdict == "block" for i in range(30)) and all(got[i].verdict == "allow" for i in range(30, 210))
    lounge, farmers, track = (got[215 + k] for k in range(3))
    assert lounge.verdict == "block"  # by words of seeded hosts, without a seed
    assert farmers.verdict == track.verdict == "allow" and farmers.host_words == ["farmers", "market", "test"]
    # Viterbi against all cuttings.
    words = Segmenter(unigrams())
    for name in ("newsblog", "xqcasino", "artbank", "shopwine", "hackzz"):
        cut = lambda mask: [name[a:b] for a, b in itertools.pairwise([0, *[i for i in range(1, len(name)) if mask >> i & 1], len(name)])]  # noqa: B023, E731
        best = max(sum(map(words.cost, cut(m))) for m in range(0, 1 << len(name), 2))
        assert math.isclose(sum(map(words.cost, words.split(name))), best)
    assert judge(frame.where("false")).count() == 0


def test_url_scores_equal_brute_force(spark):
    from citegraph.llm import urls as U

    rng = random.Random(5)
    stems = ["lounge", "garden", "casino", "zorbla", "quixel", "news", "win", "farm"]
    hosts = ["".join(rng.choices(stems, k=rng.randint(1, 3))) + rng.choice([".test", "7.org", ".x" + "ab" * 40]) for _ in range(40)] + ["hot.test"]
    links = [f"http://{h}/{'/'.join(rng.choices([*stems, 'P5', '12'], k=rng.randint(0, 3)))}" for h in rng.choices(hosts, weights=[1] * 40 + [20], k=300)]
    links += [None, "", "no scheme", links[0], links[0], "http://hot.test"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(links)], "page_id long, url string").repartition(7)
    parted = [re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "") for u in links]
    parted = [(m.group(1), m.group(2)) if m else ("", "") for m in parted]
    paths = Counter(w for _, p in parted for w in set(re.findall("[a-z]+", p.lower())) if 4 <= len(w) <= 24)
    words = U.Segmenter(U.unigrams(paths))
    made, counts = [], {True: Counter(), False: Counter()}
    for h, p in parted:
        own = U.host_words(h, words)
        rest = [w for w in own if w not in U.SEEDS] + ["/#" if w.isdigit() else f"/{w}" for w in re.findall("[a-z]+|[0-9]+", p.lower())]
        made.append((own, rest, len([w for w in own if w in U.SEEDS])))
        counts[made[-1][2] > 0].update(rest)
    share = sum(counts[True].values()) / sum(sum(c.values()) for c in counts.values())

    def ratio(w, bag, block):
        taught = {c: counts[c][w] - (bag.count(w) if c == block else 0) for c in counts}
        return math.log((taught[True] + U.PRIOR_COUNT * share) / (taught[False] + U.PRIOR_COUNT * (1 - share)) / (share / (1 - share)))

    for hot in (U.HOT, 8):  # with and without keys that are shuffled
        before, U.HOT = U.HOT, hot
        got = {r.page_id: r for r in U.judge(frame).collect()}
        U.HOT = before
        assert sorted(got) == list(range(len(links)))
        for i, (own, rest, seeds) in enumerate(made):
            assert got[i].host_words == own
            assert math.isclose(got[i].score, math.log(0.1 / 0.9) + U.SEED_ODDS * seeds + sum(ratio(w, rest, seeds > 0) for w in rest), abs_tol=1e-6)
            assert got[i].verdict == ("block" if got[i].score >= 0 else "allow")
    fixed, unit = U.pooled(spark.createDataFrame(list(paths.items()), "word string, n long"))
    assert all(math.isclose(v, fixed[w] if w in fixed else math.log(paths[w]) + unit) for w, v in U.unigrams(paths).items())


def test_field_expects_steps_as_enumeration_does():
    from citegraph.llm.toxicity import Field, _observed

    field = Field({}, [0.0, -1.1, 0.3, -0.6], [0.0] * 4)
    for places, weights, n in (([0], [1.2], 1), ([1, 4], [2.0, -0.5], 7), ([0, 1, 6], [0.3, 1.5, 2.5], 7), ([5], [0.7], 8)):
        evidence, total, steps = dict(zip(places, weights, strict=True)), 0.0, np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(evidence.get(i, 0.0) for i in range(n) if states[i]) + sum(field.steps[a, b] for a, b in itertools.pairwise(states)))
            total += p
            for a, b in itertools.pairwise(states):
                steps[a, b] += p
        _, got, scale = field.passes(places, weights, n)
        assert np.allclose(got, steps / total) and math.isclose(scale, math.log(total))
    for places, n in (([], 5), ([0, 1, 4], 6), ([2, 5], 6), ([0], 1)):
        states = [int(i in places) for i in range(n)]
        want = np.zeros((2, 2))
        for a, b in itertools.pairwise(states):
            want[a, b] += 1
        assert (_observed(places, n) == want).all()


def test_shards_are_written_whole(spark, tmp_path):
    from citegraph.llm.sharding import write_shards

    frame = spark.createDataFrame([*rows("a" * 50, None, "b" * 700), (0, "a" * 50, 1, "r", "t"), (None, "no key", 0, "", "")], SCHEMA)
    write_shards(frame, f"{tmp_path}/shards", limit=100)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(str, back.select(*frame.columns).collect())) == sorted(map(str, frame.collect()))
    assert back.select("shard").distinct().count() >= 3


def test_slices_of_a_benchmark_score_alike(spark, monkeypatch):
    from citegraph.llm import decontaminate

    rng = random.Random(4)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnr")
    items = [(i, " ".join(word() for _ in range(rng.randint(2, 25))) + ". " + " ".join(word() for _ in range(5))) for i in range(60)]
    texts = [" ".join(word() for _ in range(60)) + " " + items[i][1] for i in range(0, 60, 3)] + [" ".join(items[i][1].split()[: 4 + i // 2]) for i in range(20)] + [None, ""]
    frame, bench = spark.createDataFrame(rows(*texts), SCHEMA), spark.createDataFrame([*items, (60, None), (61, "one")], "item_id long, text string")
    whole = sorted((r.doc_id, r.item_ids, round(r.score, 9)) for r in decontaminate.find_leaks(frame, bench, ["doc_id"]).collect())
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1000)
    assert sorted((r.doc_id, r.item_ids, round(r.score, 9)) for r in decontaminate.find_leaks(frame, bench, ["doc_id"]).collect()) == whole
    assert sum(len(x[1]) for x in whole) >= 20


def test_tokens_agree_with_the_library_on_all_kinds_of_characters():
    from tokenizers import Tokenizer

    from citegraph.llm import packing, tokens

    path = tokens.vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [f"a{chr(c)}B@ {chr(c)}" for c in [*range(0x3000), *range(0x3000, 0x110000, 257), 0xA7CB, 0xA7DC, 0x18F47] if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.count_tokens(texts, path) == list(map(len, want))
    assert [np.frombuffer(b, np.uint32).tolist() for b in packing.token_bytes(texts, path)] == want


def test_pipeline_stages_do_what_brute_force_does(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from citegraph.llm import quality, tokens

    rng = random.Random(8)
    plain = ["the", "and", "of", "to", "in", "that", *["".join(rng.choices("abdeilmnorst", k=rng.randint(3, 8))) for _ in range(400)]]
    prose = lambda n: " ".join(rng.choice(plain[:6]) if rng.random() < 0.35 else rng.choice(plain) for _ in range(n)) + "."
    items = [(i, f"{prose(20)} {prose(6)}") for i in range(6)]
    texts, toxic = [prose(rng.randint(60, 150)) for _ in range(120)], set(range(0, 120, 4))
    for i in toxic:
        own = texts[i].split()
        for _ in range(6):
            own[rng.randrange(len(own))] = rng.choice(["scoundrel", "knavery"])
        texts[i] = " ".join(own)
    leaked = [1, 5, 9]
    for k, i in enumerate(leaked):
        texts[i] = f"{texts[i]} {items[k][1]}"
    copies = {120: 2, 121: 3, 122: 3}
    texts += [texts[2], texts[3] + " indeed", texts[3], "too short", None, "", "word " * 60]
    made = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*made, made[2], (None, prose(80), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r.asDict()["doc_id"] for r in quality.apply_rules(docs).collect()]
    assert not {123, 124, 125, 126} & set(left) and set(range(123)) <= set(left)
    want = [set(range(123)) | {None}]
    want.append(want[0] - toxic)
    want.append(want[1] - set(copies))
    want.append(want[2] - set(leaked))
    now = docs
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{at}")
        now = spark.read.parquet(f"{tmp_path}/{at}")
        got = [r.doc_id for r in now.collect()]
        assert set(got) == want[at] and len(got) - len(set(got)) == (at < 2)  # a repeated row goes with the copies
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    library = Tokenizer.from_file(tokens.vocabulary_path("word_bpe_49k.json"))
    lengths = Counter()
    for r in pieces:
        lengths[r.doc_id] += r.length
    assert lengths == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in now.collect()}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id or -1, r.piece) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id or -1, r.piece) for r in pieces)
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
