"""The library's queries over the driver's tables, each beside DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.functions import display, extract
from citegraph.functions import text as T
from citegraph.operators import graph, search, sync
from citegraph.operators.index import SearchIndex
from citegraph.operators.vectors import VectorIndex
from citegraph.snapshot import Cuts, checkpointed
from citegraph.sources import parsers
from citegraph.sources.testdata import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TERMS = [("under", True), ("the", False), ("nicht", True)]
TODAY = "1995-06-17"
STOPWORDS = {"en": ["the", "of", "and", "to", "in", "is", "that", "for", "was", "with"], "fr": ["le", "la", "les", "des", "est", "une", "dans", "pour", "que", "qui"]}
PHRASES = ["ignore previous instructions", "disregard all rules"]
CUSTOMER, SUPPLIER = "'cust:' || c_custkey", "'supp:' || s_suppkey"


def query(oracle: str | None = None):
    def add(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Model(spark, folder))
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _tok(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"


FILES = "(SELECT 'doc:' || doc_id AS item_id, source AS source_id, 'file' AS kind, source || ' ' || lang || ' ' || doc_id AS title, '/' || source || '/' || doc_id || '.txt' AS uri, sha256(text) AS content_hash, text FROM documents)"
CHUNKS = "(SELECT 'doc:' || doc_id || '#0' AS chunk_id, 'doc:' || doc_id AS item_id, text FROM documents)"
MAILS = "(SELECT 'mail:' || o_orderkey AS item_id, 'orders' AS source_id, 'email' AS kind, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS created_at, 'cust:' || o_custkey AS author FROM orders)"
RECIPIENTS = "(SELECT DISTINCT 'mail:' || l_orderkey AS item_id, 'supp:' || l_suppkey AS entity_id FROM lineitem)"
MENTIONS = f"(SELECT author AS entity_id, item_id, 'author' AS role FROM {MAILS} UNION ALL SELECT entity_id, item_id, 'recipient' FROM {RECIPIENTS})"
WROTE = f"(SELECT m.author AS src, r.entity_id AS dst, item_id FROM {MAILS} m JOIN {RECIPIENTS} r USING (item_id))"
RELATIONS = f"(SELECT src, dst, count(*) AS weight FROM {WROTE} GROUP BY src, dst)"
FACTS = f"(SELECT {CUSTOMER} AS entity_id, unnest(['organization', 'address']) AS key, unnest([c_mktsegment, n_name]) AS value, 0.95::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey)"
ENTITIES = f"(SELECT {CUSTOMER} AS entity_id, c_name AS name FROM customer UNION ALL SELECT {SUPPLIER}, s_name FROM supplier)"


def _bm25_sql(source: str, key: str, columns: dict[str, float], terms: list[tuple[str, bool]]) -> str:
    def hits(term: str, prefix: bool) -> str:
        test = f"starts_with(t, '{term}')" if prefix else f"t = '{term}'"
        return " + ".join(f"{w} * len(list_filter({_tok(f'strip_accents({c})')}, lambda t: {test}))" for c, w in columns.items())

    n = range(len(terms))
    fs = ", ".join(f"{hits(*t)} AS f{i}" for i, t in enumerate(terms))
    idf = [f"(CASE WHEN (n - n{i} + 0.5) / (n{i} + 0.5) > 1 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END)" for i in n]
    score = " + ".join(f"{idf[i]} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in n)
    return f"""(WITH r AS (SELECT {key}, {" + ".join(f"len({_tok(c)})" for c in columns)} AS length, {fs} FROM {source}),
s AS (SELECT count(*) AS n, avg(length) AS mean, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in n)} FROM r)
SELECT {key}, {score} AS score FROM r, s WHERE {" OR ".join(f"f{i} > 0" for i in n)} ORDER BY round(score, 9) DESC, {key} LIMIT 200)"""


BODY_SQL = _bm25_sql(CHUNKS, "chunk_id", {"text": 1.0}, TERMS)


_indexes: dict[tuple[str, str, str], SearchIndex | VectorIndex] = {}
_builds = {
    "bodies": lambda m: SearchIndex.build(m.chunks(), "chunk_id", {"text": 1.0}, carried=("item_id",)),
    "titles": lambda m: SearchIndex.build(m.files(), "item_id", search.TITLE_COLUMNS),
    "vectors": lambda m: VectorIndex.build(m.table("embeddings")),
}


def _index(m: Model, name: str) -> SearchIndex | VectorIndex:
    """One of the stored indexes, made when a query first asks for it, once an application and folder."""
    at = m.spark.sparkContext.applicationId, m.folder, name
    if at not in _indexes:
        _indexes[at] = _builds[name](m)
    return _indexes[at]


def indexes(m: Model) -> tuple[SearchIndex, SearchIndex, VectorIndex]:
    """The stored indexes of chunks, titles and vectors."""
    return _index(m, "bodies"), _index(m, "titles"), _index(m, "vectors")


def _bm25(m: Model, terms: list[tuple[str, bool]], n: int) -> DataFrame:
    return _index(m, "bodies").top(terms, n).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT chunk_id, round(score, 6) AS score FROM {BODY_SQL}")
def bm25_search(m: Model) -> DataFrame:
    return _bm25(m, TERMS, 200)


@query(f"SELECT chunk_id, round(score, 6) AS score FROM {_bm25_sql(CHUNKS, 'chunk_id', {'text': 1.0}, [('thou', True)])}")
def bm25_prefix_search(m: Model) -> DataFrame:
    return _bm25(m, [("thou", True)], 200)


@query(f"SELECT chunk_id, round(score, 6) AS score FROM {BODY_SQL}")
def bm25_scan(m: Model) -> DataFrame:
    """Without an index: a scan of all texts."""
    found = search.bm25(m.chunks(), "chunk_id", {"text": 1.0}, TERMS)
    return search.top(found, "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT chunk_id, round(score, 6) AS score FROM {BODY_SQL}")
def bm25_indexed(m: Model) -> DataFrame:
    """All matches by the stored index, then the best."""
    return search.top(_index(m, "bodies").bm25(TERMS), "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT chunk_id, round(score, 6) AS score FROM {BODY_SQL}")
def bm25_after_updates(m: Model) -> DataFrame:
    """An index of the texts in one language, from which they are taken and to which all others are added in two updates."""
    chunks = m.chunks().join(m.table("documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("item_id"), "lang"), "item_id")
    index = SearchIndex.build(chunks.where("lang = 'en'").withColumn("text", F.concat(F.lit("under the "), "text")), "chunk_id", {"text": 1.0})
    index.update(chunks.where("lang = 'en'"), chunks.where("lang is null or lang not in ('en', 'de')"))
    index.update(chunks.limit(0), chunks.where("lang in ('en', 'de')"))
    return index.top(TERMS, 200).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT item_id, round(2 * score, 6) AS score FROM {_bm25_sql(FILES, 'item_id', {'title': 5.0, 'uri': 1.0}, [('src3', True), ('fr', False)])}")
def title_search(m: Model) -> DataFrame:
    found = _index(m, "titles").top([("src3", True), ("fr", False)], search.CANDIDATES)
    return found.select("item_id", F.round(F.col("score") * search.TITLE_WEIGHT, 6).alias("score"))


@query(
    f"""SELECT item_id, round(coalesce(b.score, 0) + coalesce(2 * t.score, 0), 6) AS score, left(c.text, 200) AS snippet
FROM (SELECT item_id, max(score) AS score FROM {BODY_SQL} JOIN {CHUNKS} USING (chunk_id) GROUP BY item_id) b
FULL JOIN {_bm25_sql(FILES, "item_id", {"title": 5.0, "uri": 1.0}, TERMS)} t USING (item_id)
JOIN {FILES} f USING (item_id) LEFT JOIN {CHUNKS} c USING (item_id) WHERE f.source_id = 'src0' ORDER BY 2 DESC, 1 LIMIT 10"""
)
def search_filtered(m: Model) -> DataFrame:
    bodies, titles = _index(m, "bodies"), _index(m, "titles")
    body = bodies.top(TERMS, search.CANDIDATES)
    found = search.search(m.chunks(), m.files(), TERMS, 10, F.col("source_id") == "src0", body, titles.top(TERMS, search.CANDIDATES), bodies.rows_of(body))
    return found.select("item_id", F.round("score", 6).alias("score"), "snippet")


def _vector(m: Model) -> list[float]:
    row = m.table("embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [0.0] * 64


KNN_SQL = "SELECT e.vec_id, sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, vec_id LIMIT 20"


@query(f"SELECT vec_id, round(distance, 6) AS distance FROM ({KNN_SQL})")
def knn_l2(m: Model) -> DataFrame:
    return search.nearest(m.table("embeddings"), _vector(m), 20, None).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(distance, 6) AS distance FROM ({KNN_SQL})")
def knn_cells_exact(m: Model) -> DataFrame:
    """By the stored cells, going on until no other cell can hold a nearer vector."""
    return _index(m, "vectors").search(_vector(m), 20, exact=True).select("vec_id", F.round("distance", 6).alias("distance"))


@query()
def knn_cells(m: Model) -> DataFrame:
    """By the nearest stored cells alone; the tests measure its recall."""
    return _index(m, "vectors").search(_vector(m), 20)


@query(f"SELECT vec_id, round(distance, 6) AS distance FROM ({KNN_SQL}) WHERE distance <= 1.22")
def knn_filtered(m: Model) -> DataFrame:
    return search.nearest(m.table("embeddings"), _vector(m), 20).select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH a AS (SELECT split_part(split_part(chunk_id, '#', 1), ':', 2)::BIGINT AS id, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) - 1 AS r FROM {BODY_SQL}),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) - 1 AS r FROM ({KNN_SQL}))
SELECT id, round(coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b USING (id)"""
)
def rrf_fusion(m: Model) -> DataFrame:
    words = _index(m, "bodies").top(TERMS, search.CANDIDATES)
    words = search.ranked(words, "chunk_id", [F.desc(F.round("score", 9)), F.col("chunk_id")]).select(F.split(F.split("chunk_id", "#")[0], ":")[1].cast("long").alias("id"), "rank")
    near = search.ranked(_index(m, "vectors").search(_vector(m), 20, exact=True), "vec_id", [F.col("distance"), F.col("vec_id")]).withColumnRenamed("vec_id", "id")
    return search.fuse(words, near, "id").select("id", F.round("score", 9).alias("score"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, E' \n\t'), '\s+'), lambda x: x <> '') AS words, trim(text) AS body FROM documents)
SELECT doc_id, i::INT AS ord, least(500, len(words) - i * 500)::INT AS tokens,
  md5(CASE WHEN len(words) > 500 THEN array_to_string(words[i * 500 + 1:(i + 1) * 500], ' ') ELSE body END) AS digest
FROM (SELECT *, unnest(range(0, (len(words) + 499) // 500)) AS i FROM w)"""
)
def chunk_words(m: Model) -> DataFrame:
    rows = m.table("documents").select("doc_id", F.posexplode(T.chunk_words(F.col("text"))).alias("ord", "c"))
    return rows.select("doc_id", "ord", F.col("c.tokens").alias("tokens"), F.md5(F.col("c.text").cast("binary")).alias("digest"))


def _lang_sql(lang: str) -> str:
    return f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in STOPWORDS[lang])})))"


@query(
    f"""WITH t AS (SELECT doc_id, {_tok("text")}[1:2000] AS w FROM documents), n AS (SELECT doc_id, {_lang_sql("en")} AS en, {_lang_sql("fr")} AS fr FROM t)
SELECT doc_id, CASE WHEN greatest(en, fr) < 3 OR en = fr THEN NULL WHEN en > fr THEN 'en' ELSE 'fr' END AS lang FROM n"""
)
def lang_detect(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", T.language(F.col("text"), STOPWORDS).alias("lang"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(text, '\b(?:sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|github_pat_\w{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})', '[REDACTED:api_key]', 'g')) AS digest FROM documents"""
)
def redact_api_keys(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", F.md5(T.redact_api_keys(F.col("text")).cast("binary")).alias("digest"))


@query(
    r"""SELECT doc_id, regexp_replace(text, '(?i)\b((?:password|passwd|pwd|mot de passe|mdp)\s*[:=]\s*)(\S+)', '\1[REDACTED:password]', 'g') <> text AS changed,
md5(regexp_replace(text, '(?i)\b((?:password|passwd|pwd|mot de passe|mdp)\s*[:=]\s*)(\S+)', '\1[REDACTED:password]', 'g')) AS digest FROM documents"""
)
def redact_passwords(m: Model) -> DataFrame:
    done = T.redact_passwords(F.col("text"))
    return m.table("documents").select("doc_id", (done != F.col("text")).alias("changed"), F.md5(done.cast("binary")).alias("digest"))


CARDS_SQL = r"""SELECT doc_id, c, regexp_replace(c, '\D', '', 'g') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:\d[ -]?){12,18}\d\b')) AS c FROM documents)"""


@query(
    f"""WITH c AS ({CARDS_SQL}), x AS (SELECT doc_id, c, list_sum(list_transform(range(0, length(d)),
  lambda i: CASE WHEN i % 2 = 0 THEN substr(d, (length(d) - i)::INT, 1)::INT ELSE (2 * substr(d, (length(d) - i)::INT, 1)::INT) % 10 + (2 * substr(d, (length(d) - i)::INT, 1)::INT) // 10 END)) % 10 = 0 AS valid FROM c)
SELECT doc_id, c AS card, valid FROM x"""
)
def luhn_valid(m: Model) -> DataFrame:
    rows = m.table("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.CARD), F.lit(0))).alias("card"))
    return rows.select("doc_id", "card", T.luhn_valid(F.col("card")).alias("valid"))


@query(
    """SELECT doc_id, 'Card ' || CASE WHEN doc_id % 2 = 0 THEN '[REDACTED:card]' ELSE '4111 1111 1111 1112' END || ', account ' || CASE WHEN doc_id % 3 = 0 THEN '[REDACTED:iban]' ELSE 'GB83 WEST 1234 5698 7654 32' END
|| ', password: [REDACTED:password] of ' || source AS text, list_concat(list_concat(CASE WHEN doc_id % 3 = 0 THEN ['iban'] ELSE [] END, CASE WHEN doc_id % 2 = 0 THEN ['card'] ELSE [] END), ['password']) AS kinds FROM documents"""
)
def redact_cards(m: Model) -> DataFrame:
    """A line for each document with a card and an account that pass their checks or do not, and a password."""
    card = F.when(F.col("doc_id") % 2 == 0, "4111 1111 1111 1111").otherwise("4111 1111 1111 1112")
    account = F.when(F.col("doc_id") % 3 == 0, "GB82 WEST 1234 5698 7654 32").otherwise("GB83 WEST 1234 5698 7654 32")
    text = F.concat(F.lit("Card "), card, F.lit(", account "), account, F.lit(", password: hunter2 of "), "source")
    return display.shown(m.table("documents").select("doc_id", text.alias("text")))


@query(r"""SELECT doc_id, list_filter(regexp_extract_all(text, '\b[0-9a-fA-F]{40,}\b'), lambda x: length(x) % 2 = 0) AS runs FROM documents""")
def hex_runs(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", T.hex_runs(F.col("text")).alias("runs"))


@query(
    """SELECT c_custkey, ('32142829' || lpad(c_custkey::VARCHAR, 14, '0') || '1611' || lpad(((c_custkey * 7) % 98)::VARCHAR, 2, '0'))::HUGEINT % 97 = 1 AS valid FROM customer"""
)
def iban_valid(m: Model) -> DataFrame:
    key = F.col("c_custkey")
    iban = F.concat(F.lit("GB"), F.lpad(((key * 7) % 98).cast("string"), 2, "0"), F.lit("WEST"), F.lpad(key.cast("string"), 14, "0"))
    return m.table("customer").select("c_custkey", T.iban_valid(iban).alias("valid"))


@query("SELECT doc_id, 0.0::DOUBLE AS risk FROM documents WHERE NOT regexp_matches(text, '[­​-‏]')")
def risk_score_basic(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", T.risk_score(F.col("text"), PHRASES).alias("risk"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '+33612' || lpad(c_custkey::VARCHAR, 6, '0') WHEN 1 THEN '+33612' || lpad(c_custkey::VARCHAR, 6, '0') WHEN 2 THEN '+44' || lpad(c_custkey::VARCHAR, 8, '0') WHEN 3 THEN '+33' || lpad(c_custkey::VARCHAR, 9, '6') ELSE NULL END AS phone FROM customer""")
def norm_phone(m: Model) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    raw = (
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("tel:+33 (0)6 12-"), F.lpad(k, 6, "0")))
        .when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("33612"), F.lpad(k, 6, "0"), F.lit("@s.whatsapp.net")))
        .when(F.col("c_custkey") % 5 == 2, F.concat(F.lit("0044 "), F.lpad(k, 8, "0")))
        .when(F.col("c_custkey") % 5 == 3, F.concat(F.lit("0"), F.lpad(k, 9, "6")))
        .otherwise(F.lit("12-34"))
    )
    return m.table("customer").select("c_custkey", T.norm_phone(raw, "33").alias("phone"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'user' || c_custkey || '@example.org' END AS email FROM customer")
def norm_email(m: Model) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" <User"), k, F.lit("@Example.ORG> "))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("mailto:user"), k, F.lit("@example.org"))).otherwise(F.concat(F.lit("user "), k, F.lit("@example")))
    return m.table("customer").select("c_custkey", T.norm_email(raw).alias("email"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%m-%d') ELSE NULL END AS birthday FROM orders"""
)
def norm_bday(m: Model) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00Z"))).when(k == 2, F.concat(F.lit("1604-"), F.date_format(d, "MM-dd"))).otherwise(F.lit("2001-13-41"))
    return m.table("orders").select("o_orderkey", T.norm_birthday(raw).alias("birthday"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN replace(c_name, '#', ' ') WHEN 1 THEN NULL ELSE NULL END AS name FROM customer")
def norm_name(m: Model) -> DataFrame:
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("  \t")))).when(k == 1, F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("@b.org"))).otherwise(F.concat(F.lit("+33 "), F.col("c_custkey").cast("string")))
    return m.table("customer").select("c_custkey", T.norm_name(raw).alias("name"))


@query("SELECT doc_id, substr(sha256(source || chr(0) || doc_id::VARCHAR), 1, 32) AS item_id FROM documents")
def item_id_hash(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", T.item_id(F.col("source"), F.col("doc_id").cast("string")).alias("item_id"))


@query("SELECT c_custkey, 'e_' || substr(sha256('person' || chr(0) || 'cust:' || c_custkey), 1, 24) AS entity_id FROM customer")
def entity_id_hash(m: Model) -> DataFrame:
    return m.table("customer").select("c_custkey", T.entity_id(F.lit("person"), F.concat(F.lit("cust:"), F.col("c_custkey").cast("string"))).alias("entity_id"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, list_transform({_tok("text")}, lambda w: ('0x' || right(md5(w), 2))::INT % 64) AS s FROM conversations),
c AS (SELECT conv_id, turn, list_transform(range(0, 64), lambda i: len(list_filter(s, lambda x: x = i))::DOUBLE) AS v FROM t)
SELECT conv_id, turn, round(list_sum(list_transform(list_zip(v, range(0, 64)), lambda z: z[1] * z[2])) / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 6) AS moment FROM c"""
)
def hash_embedding(m: Model) -> DataFrame:
    e = T.hash_embedding(F.col("text"))
    moment = F.aggregate(F.zip_with(e, F.sequence(F.lit(0), F.lit(63)), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return m.table("conversations").select("conv_id", "turn", F.round(moment, 6).alias("moment"))


@query("SELECT o_orderkey, round(floor(o_totalprice) + 0.25, 2) AS value FROM orders")
def locale_number(m: Model) -> DataFrame:
    whole = F.floor("o_totalprice").cast("long")
    english, german = F.concat(F.format_number(whole, 0), F.lit(".25")), F.concat(F.translate(F.format_number(whole, 0), ",", "."), F.lit(",25"))
    return m.table("orders").select("o_orderkey", F.round(T.locale_number(F.when(F.col("o_orderkey") % 2 == 0, english).otherwise(german)), 2).alias("value"))


@query(f"SELECT src, dst, weight::BIGINT AS weight FROM {RELATIONS}")
def relation_weight(m: Model) -> DataFrame:
    return graph.relation_weights(m.wrote())


@query(
    f"""SELECT entity_id, other_id, weight::BIGINT AS weight FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY weight DESC, other_id) AS n FROM
(SELECT src AS entity_id, dst AS other_id, weight FROM {RELATIONS} UNION ALL SELECT dst, src, weight FROM {RELATIONS})) WHERE n <= 5"""
)
def related_entities(m: Model) -> DataFrame:
    edges = graph.neighbours(graph.relation_weights(m.wrote()), m.entities().select("entity_id"))
    return graph.first_of(edges, ["entity_id"], [F.desc("weight"), F.col("other_id")], 5)


@query(
    f"""SELECT DISTINCT x.other AS entity_id, e.name, (SELECT count(*) FROM {MENTIONS} m WHERE m.entity_id = x.other)::BIGINT AS n
FROM (SELECT dst AS other FROM {RELATIONS} WHERE src = 'cust:1' UNION SELECT src FROM {RELATIONS} WHERE dst = 'cust:1') x JOIN {ENTITIES} e ON e.entity_id = x.other"""
)
def neighbourhood(m: Model) -> DataFrame:
    one = m.entities().where("entity_id = 'cust:1'").select("entity_id")
    near = graph.neighbours(graph.relation_weights(m.wrote()), one).select(F.col("other_id").alias("entity_id")).distinct()
    counts = graph.mention_counts(m.mentions().join(near, "entity_id", "left_semi"), False)
    return near.join(m.entities(), "entity_id").join(counts, "entity_id", "left").select("entity_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


NODES_SQL = f"(SELECT entity_id, count(DISTINCT item_id) AS n FROM {MENTIONS} GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 50)"


def _nodes(m: Model) -> DataFrame:
    return graph.mention_counts(m.mentions(), True).orderBy(F.desc("n"), "entity_id").limit(50)


@query(f"SELECT entity_id, n::BIGINT AS n FROM {NODES_SQL}")
def subgraph_nodes(m: Model) -> DataFrame:
    return _nodes(m)


@query(f"SELECT src, dst, weight::BIGINT AS weight FROM {RELATIONS} WHERE src IN (SELECT entity_id FROM {NODES_SQL}) AND dst IN (SELECT entity_id FROM {NODES_SQL})")
def subgraph_edges(m: Model) -> DataFrame:
    return graph.edges_among(graph.relation_weights(m.wrote()), _nodes(m))


@query(f"SELECT item_id, created_at FROM {MAILS} WHERE item_id IN (SELECT item_id FROM {MENTIONS} WHERE entity_id = 'supp:1') AND created_at >= '1994-01-01' AND created_at <= '1996-12-31' ORDER BY created_at DESC, item_id LIMIT 50")
def timeline(m: Model) -> DataFrame:
    return graph.timeline(m.mails(), m.mentions(), "supp:1", "1994-01-01", "1996-12-31", 50).select("item_id", "created_at")


@query("SELECT turn, role, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) ORDER BY turn LIMIT 200")
def thread(m: Model) -> DataFrame:
    rows = m.messages()
    first = rows.agg(F.min("conv_id").alias("conv_id"))
    return rows.join(F.broadcast(first), "conv_id").orderBy("turn", "item_id").limit(200).select("turn", "role", "text")


@query(f"SELECT entity_id, max(created_at) FILTER (created_at <= '{TODAY}') AS last_contact, min(created_at) FILTER (created_at > '{TODAY}') AS next_meeting FROM {MENTIONS} JOIN {MAILS} USING (item_id) GROUP BY entity_id")
def last_contact(m: Model) -> DataFrame:
    return graph.contact_dates(m.mails(), m.mentions(), TODAY)


@query(f"SELECT item_id, left(text, 200) AS head FROM {CHUNKS}")
def item_head_chunk(m: Model) -> DataFrame:
    return m.chunks().groupBy("item_id").agg(F.left(F.min_by("text", "ord"), F.lit(200)).alias("head"))


@query(f"SELECT item_id, other_id FROM (SELECT a.item_id, b.item_id AS other_id, row_number() OVER (PARTITION BY a.item_id ORDER BY b.item_id) AS n FROM {FILES} a JOIN {FILES} b ON a.content_hash = b.content_hash AND a.item_id <> b.item_id) WHERE n <= 5")
def origins(m: Model) -> DataFrame:
    return graph.same_content(m.files(), m.files(), 5)


@query(f"SELECT content_hash, count(*)::BIGINT AS copies, min(item_id) AS first_item FROM {FILES} GROUP BY content_hash HAVING count(*) > 1")
def duplicate_texts(m: Model) -> DataFrame:
    return m.files().groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("item_id").alias("first_item")).where("copies > 1")


EVIDENCE = f"(SELECT author AS entity_id, item_id, created_at FROM {MAILS})"


@query(
    f"""SELECT entity_id, key, value, item_id FROM (SELECT f.*, e.item_id, row_number() OVER (PARTITION BY entity_id, key, value ORDER BY created_at DESC, item_id) AS n
FROM {FACTS} f JOIN {EVIDENCE} e USING (entity_id)) WHERE n <= 10"""
)
def facts_with_evidence(m: Model) -> DataFrame:
    evidence = m.mails().select(F.col("author").alias("entity_id"), "item_id")
    return graph.facts_with_evidence(m.facts(), evidence, m.mails()).select("entity_id", "key", "value", "item_id")


@query(f"SELECT DISTINCT item_id, entity_id, key, value FROM {FACTS} JOIN {EVIDENCE} USING (entity_id)")
def item_facts(m: Model) -> DataFrame:
    evidence = m.mails().select(F.col("author").alias("entity_id"), "item_id")
    return m.facts().join(evidence, "entity_id").select("item_id", "entity_id", "key", "value").distinct()


@query(f"SELECT entity_id, list_sort(list(DISTINCT role)) AS roles, count(*)::BIGINT AS n FROM {MENTIONS} GROUP BY entity_id")
def item_entities(m: Model) -> DataFrame:
    return m.mentions().groupBy("entity_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count("*").alias("n"))


@query(
    f"""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders),
n AS (SELECT o_orderkey, value, CASE WHEN length(value) = 5 THEN (SELECT min(d) FROM (SELECT try_cast((1995 + i)::VARCHAR || '-' || value AS DATE) AS d FROM range(0, 6) r(i)) WHERE d >= DATE '{TODAY}')
  WHEN value::DATE >= DATE '{TODAY}' THEN value::DATE END AS date FROM v)
SELECT o_orderkey, value, date::VARCHAR AS date FROM n WHERE date IS NOT NULL AND date <= DATE '{TODAY}' + 45"""
)
def dated_facts_upcoming(m: Model) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = m.table("orders").select("o_orderkey", value.alias("value"))
    today = F.lit(TODAY).cast("date")
    return rows.withColumn("date", T.next_occurrence(F.col("value"), today)).where(F.col("date") <= F.date_add(today, 45)).withColumn("date", F.col("date").cast("string"))


@query(
    """WITH e AS (SELECT 'f' || (o_custkey % 97) AS fact_id, CASE WHEN o_orderkey % 501 = 0 THEN 'user:fix' WHEN o_orderkey % 101 = 0 THEN 'contact' ELSE 'greeting' END AS method, strftime(o_orderdate, '%Y') AS y FROM orders)
SELECT fact_id, round(CASE WHEN max(method LIKE 'user:%') THEN 1.0 WHEN max(method = 'contact') THEN 0.95 ELSE least(0.9, 0.5 + 0.15 * (count(DISTINCT CASE WHEN method = 'greeting' THEN y END) - 1)) END::DOUBLE, 6) AS confidence FROM e GROUP BY fact_id"""
)
def greeting_confidence(m: Model) -> DataFrame:
    k = F.col("o_orderkey")
    e = m.table("orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 97).cast("string")).alias("fact_id"), F.when(k % 501 == 0, "user:fix").when(k % 101 == 0, "contact").otherwise("greeting").alias("method"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    return graph.greeting_confidence(e).select("fact_id", F.round("confidence", 6).alias("confidence"))


@query(
    f"""WITH n AS (SELECT entity_id, count(DISTINCT item_id) AS items FROM {MENTIONS} GROUP BY entity_id HAVING count(DISTINCT item_id) >= 2), w AS (SELECT dst AS entity_id, sum(weight) AS w FROM {RELATIONS} WHERE src = 'cust:1' GROUP BY dst)
SELECT entity_id, items::BIGINT AS items, (items + 2 * coalesce(w, 0))::BIGINT AS score FROM n LEFT JOIN w USING (entity_id) ORDER BY score DESC, entity_id LIMIT 20"""
)
def top_people(m: Model) -> DataFrame:
    n = m.mentions().groupBy("entity_id").agg(F.countDistinct("item_id").alias("items")).where("items >= 2")
    mine = graph.relation_weights(m.wrote().where("src = 'cust:1'")).groupBy(F.col("dst").alias("entity_id")).agg(F.sum("weight").alias("w"))
    rows = n.join(mine, "entity_id", "left").select("entity_id", "items", (F.col("items") + 2 * F.coalesce("w", F.lit(0))).alias("score"))
    return rows.orderBy(F.desc("score"), "entity_id").limit(20)


@query("SELECT source, count(*)::BIGINT AS items, count(DISTINCT lang)::BIGINT AS langs, max(n_chars)::BIGINT AS longest FROM documents GROUP BY source")
def items_per_source(m: Model) -> DataFrame:
    return m.table("documents").groupBy("source").agg(F.count("*").alias("items"), F.countDistinct("lang").alias("langs"), F.max("n_chars").alias("longest"))


@query("SELECT 'file' AS kind, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'email', count(*) FROM orders UNION ALL SELECT 'message', count(*) FROM conversations UNION ALL SELECT 'event', count(*) FROM events")
def table_counts(m: Model) -> DataFrame:
    one = lambda t, k: m.table(t).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return one("documents", "file").union(one("orders", "email")).union(one("conversations", "message")).union(one("events", "event"))


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, max(ts) AS latest FROM events GROUP BY event_type")
def status_counts(m: Model) -> DataFrame:
    return m.table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("ts").alias("latest"))


@query(f"SELECT min(d)::VARCHAR AS oldest_sync, date_diff('day', min(d), DATE '{TODAY}')::INT AS age_days, date_diff('day', min(d), DATE '{TODAY}') > 7 AS stale FROM (SELECT o_orderstatus, max(o_orderdate)::DATE AS d FROM orders WHERE o_orderdate < DATE '{TODAY}' GROUP BY o_orderstatus)")
def freshness(m: Model) -> DataFrame:
    last = m.table("orders").where(F.col("o_orderdate") < TODAY).groupBy("o_orderstatus").agg(F.max("o_orderdate").cast("date").alias("d")).agg(F.min("d").alias("d"))
    age = F.date_diff(F.lit(TODAY).cast("date"), F.col("d"))
    return last.select(F.col("d").cast("string").alias("oldest_sync"), age.alias("age_days"), (age > 7).alias("stale"))


@query(f"SELECT entity_id, key, value FROM {FACTS} f WHERE NOT EXISTS (SELECT 1 FROM {MAILS} m WHERE m.author = f.entity_id)")
def orphan_facts(m: Model) -> DataFrame:
    return sync.orphans(m.facts(), m.mails().select(F.col("author").alias("entity_id")), "entity_id").select("entity_id", "key", "value")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_vectors(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id").join(m.table("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query(f"SELECT source_id, count(*)::BIGINT AS n, min(item_id) AS first_item FROM {FILES} WHERE source_id IN ('src1', 'src2', 'src3') GROUP BY source_id")
def scope_items(m: Model) -> DataFrame:
    return sync.scope(m.files(), ["src1", "src2", "src3"]).groupBy("source_id").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


SYNC_SQL = """(WITH k AS (SELECT doc_id::VARCHAR AS external_id, sha256(text) AS version FROM documents WHERE doc_id % 7 <> 2),
l AS (SELECT doc_id::VARCHAR AS external_id, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE sha256(text) END AS version FROM documents WHERE doc_id % 10 <> 3)
SELECT external_id, CASE WHEN k.version IS NULL THEN 'new' WHEN l.version IS NULL THEN 'missing' WHEN k.version = l.version THEN 'unchanged' ELSE 'changed' END AS status FROM k FULL JOIN l USING (external_id))"""


def _changes(m: Model) -> DataFrame:
    rows = m.table("documents").select("doc_id", F.col("doc_id").cast("string").alias("external_id"), F.sha2("text", 256).alias("version"))
    listed = rows.where("doc_id % 10 <> 3").withColumn("version", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("version")))
    return sync.diff(rows.where("doc_id % 7 <> 2"), listed)


@query(f"SELECT external_id, status FROM {SYNC_SQL}")
def sync_diff(m: Model) -> DataFrame:
    return _changes(m)


@query(f"SELECT count(*) FILTER (status <> 'new')::BIGINT AS known, count(*) FILTER (status = 'missing')::BIGINT AS missing, count(*) FILTER (status = 'missing') > 50 AND count(*) FILTER (status = 'missing') > 0.5 * count(*) FILTER (status <> 'new') AS refused FROM {SYNC_SQL}")
def mass_forget_guard(m: Model) -> DataFrame:
    return sync.mass_forget(_changes(m))


@query(f"SELECT DISTINCT item_id FROM {FILES} WHERE starts_with(uri, '/src1/') OR regexp_matches(text, '(?i)password') OR regexp_matches(title, '(?i)password')")
def blacklist_union(m: Model) -> DataFrame:
    return sync.blacklisted(m.files(), ["/src1"], ["password"])


@query(
    f"""WITH r AS (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM {BODY_SQL}), c AS (SELECT rank, chunk_id, len({_tok("left(text, 200)")}) + 12 AS cost FROM r JOIN {CHUNKS} USING (chunk_id)),
t AS (SELECT *, sum(cost) OVER (ORDER BY rank) + 30 AS total FROM c) SELECT rank::INT AS rank, chunk_id, total::BIGINT AS total FROM t WHERE total <= 2000 OR rank = 0"""
)
def budget_cut(m: Model) -> DataFrame:
    bodies = _index(m, "bodies")
    found = bodies.top(TERMS, search.CANDIDATES)
    hits = search.ranked(found, "chunk_id", [F.desc(F.round("score", 9)), F.col("chunk_id")])
    costs = hits.join(bodies.rows_of(found), "chunk_id").select("rank", "chunk_id", (F.size(T.tokens(F.left("text", F.lit(200)))) + 12).cast("long").alias("cost"))
    return sync.budget_cut(costs, 2000, 30).select("rank", "chunk_id", "total")


@query("SELECT event_id, ts, event_type, user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id LIMIT 100")
def activity_log(m: Model) -> DataFrame:
    e = m.table("events")
    kind = e.agg(F.min("event_type").alias("event_type"))
    return e.join(F.broadcast(kind), "event_type").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts", "event_type", "user_id")


@query("SELECT count(*)::BIGINT AS kept, min(event_id) AS first_event FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def retention_prune(m: Model) -> DataFrame:
    return sync.retention(m.table("events"), "2024-01-15").agg(F.count("*").alias("kept"), F.min("event_id").alias("first_event"))


@query(
    """WITH RECURSIVE k AS (SELECT c_custkey AS n, 'e' || (c_custkey // 3) AS k FROM customer UNION ALL SELECT c_custkey, 'p' || ((c_custkey + 1) // 7) FROM customer),
e AS (SELECT DISTINCT a.n AS a, b.n AS b FROM k a JOIN k b USING (k)), r(n, c) AS (SELECT DISTINCT n, n FROM k UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n WHERE r.c < e.b)
SELECT n AS node, min(c) AS component FROM r GROUP BY n"""
)
def person_components(m: Model) -> DataFrame:
    c = m.table("customer")
    pairs = c.select(F.col("c_custkey").alias("node"), F.explode(F.array(F.concat(F.lit("e"), F.floor(F.col("c_custkey") / 3).cast("string")), F.concat(F.lit("p"), F.floor((F.col("c_custkey") + 1) / 7).cast("string")))).alias("key"))
    return graph.components(pairs, "node", "key", checkpointed)


@query()
def communities(m: Model) -> DataFrame:
    with Cuts(m.spark) as cut:
        return checkpointed(graph.communities(graph.relation_weights(m.wrote()), cut))


@query("SELECT conv_id, count(*)::BIGINT AS turns, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def item_body(m: Model) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return m.messages().groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("body"))


@query(r"SELECT conv_id, turn, role || ': ' || left(trim(regexp_replace(text, '\s+', ' ', 'g')), 60) AS title FROM conversations")
def message_titles(m: Model) -> DataFrame:
    return m.messages().select("conv_id", "turn", F.concat("role", F.lit(": "), F.left(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(60))).alias("title"))


@query(f"SELECT entity_id, key, value, max(confidence) AS confidence, min(tier)::INT AS tier FROM (SELECT entity_id, key, value, confidence, 0 AS tier FROM {FACTS} UNION ALL SELECT entity_id, key, value, 0.5, 1 FROM {FACTS}) GROUP BY entity_id, key, value")
def upsert_facts(m: Model) -> DataFrame:
    f = m.facts().withColumns({"tier": F.lit(0), "at": F.lit(0)})
    return graph.upsert_facts(f.unionByName(m.facts().withColumns({"confidence": F.lit(0.5), "tier": F.lit(1), "at": F.lit(1)})))


@query(f"SELECT name, entity_id, (10 * (entity_id = 'cust:7')::INT + len(list_intersect({_tok('name')}, ['customer', '000000007'])) + 2 * (len({_tok('name')}) = len(list_intersect({_tok('name')}, ['customer', '000000007'])))::INT)::BIGINT AS score FROM {ENTITIES} WHERE score * 2 >= (SELECT max(10 * (entity_id = 'cust:7')::INT + len(list_intersect({_tok('name')}, ['customer', '000000007'])) + 2 * (len({_tok('name')}) = len(list_intersect({_tok('name')}, ['customer', '000000007'])))::INT) FROM {ENTITIES}) AND score > 0")
def find_people(m: Model) -> DataFrame:
    words = F.array(F.lit("customer"), F.lit("000000007"))
    e = m.entities().withColumn("own", T.tokens(F.col("name")))
    shared = F.size(F.array_intersect("own", words))
    score = (10 * (F.col("entity_id") == "cust:7").cast("int") + shared + 2 * (F.size("own") == shared).cast("int")).cast("long")
    scored = e.select("name", "entity_id", score.alias("score")).where("score > 0")
    best = scored.agg(F.max("score").alias("best"))
    return scored.crossJoin(F.broadcast(best)).where(F.col("score") * 2 >= F.col("best")).drop("best")


@query(
    f"""WITH n AS (SELECT item_id, count(*) AS k FROM {RECIPIENTS} GROUP BY item_id), s AS (SELECT r.* FROM {RECIPIENTS} r JOIN n USING (item_id) WHERE k <= 10)
SELECT a.entity_id AS src, b.entity_id AS dst, count(*)::BIGINT AS weight FROM s a JOIN s b ON a.item_id = b.item_id AND a.entity_id < b.entity_id GROUP BY 1, 2"""
)
def met_pairs(m: Model) -> DataFrame:
    return graph.met(m.recipients()).groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query("SELECT '/' || source AS folder, count(*)::BIGINT AS files, min('doc:' || doc_id) AS first_item FROM documents GROUP BY source")
def folder_entities(m: Model) -> DataFrame:
    folder = F.regexp_extract("uri", r"^(.*)/[^/]+$", 1)
    return m.files().groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.min("item_id").alias("first_item"))


@query(f"SELECT item_id, author, list_sort(list(entity_id)) AS recipients FROM {MAILS} JOIN {RECIPIENTS} USING (item_id) GROUP BY item_id, author")
def item_people(m: Model) -> DataFrame:
    return m.mails().select("item_id", "author").join(m.recipients(), "item_id").groupBy("item_id", "author").agg(F.array_sort(F.collect_list("entity_id")).alias("recipients"))


@query(f"SELECT c.conv_id, c.turn, min(f.item_id) AS saved_as FROM conversations c JOIN {FILES} f ON sha256(c.text) = f.content_hash GROUP BY 1, 2")
def saved_copies(m: Model) -> DataFrame:
    first = m.files().groupBy("content_hash").agg(F.min("item_id").alias("saved_as"))
    return m.messages().withColumn("content_hash", F.sha2("text", 256)).join(first, "content_hash").groupBy("conv_id", "turn").agg(F.min("saved_as").alias("saved_as"))


@query()
def html_to_text(m: Model) -> DataFrame:
    pages = m.table("pages").select("page_id", F.concat("page_id", F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return parsers.parsed(pages).select("page_id", "text", "error")


@query()
def extracted_values(m: Model) -> DataFrame:
    return extract.extracted(m.files())


@query()
def prepare_pipeline(m: Model) -> DataFrame:
    """Cleaned text, its risk, language and chunks of each file, in one pass."""
    clean = m.files().select("item_id", T.strip_invisible(F.col("text")).alias("clean"), "text")
    return clean.select("item_id", T.risk_score(F.col("text"), PHRASES).alias("risk"), T.language(F.col("clean"), STOPWORDS).alias("lang"), F.size(T.chunk_words(F.col("clean"))).alias("chunks"))


__all__ = ["ORACLE", "QUERIES", "Window"]
