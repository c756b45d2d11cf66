"""Near-duplicates by DartMinHash.

An element (a run of five words) with weight w owns the region [0, w) x [0, inf) of weight and rank. Darts are hashed
into unit cells of that plane, a Poisson number in each, and a signature keeps, for each coordinate, the dart of lowest
rank inside the region. Only cells up to the rank that fills all coordinates are visited, so a signature costs as much
as the document has elements, plus the darts. Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity; with unit weights, that of the sets.

Signatures are cut into bands; texts that share a band are compared on their exact sets of runs. A band's group is never
paired with itself as a whole, and yet no link in it is lost but for the classes' sake:

1. Each text is compared with one hub: of its groups' most central texts (those with the largest groups) the first.
2. Groups that are then still of several classes are compared in pairs if they are small.
3. In a large one each text x is described by its difference D(x) to the group's hub p: the runs that x lacks and those
   that p lacks. If x is not similar to p, a text y is similar to x only if they share more than
   ``(1 - w) * lacking(y) + w * new(y)`` elements of D(y), with ``w = similarity / (1 + similarity)``: two texts with
   different changes are less similar to each other than each to the hub. So y need be looked up only by the rarest
   elements of D(y), all but that many, and elements that nobody shares are none. The sizes of the differences bound what
   two texts share, too. The texts of one element are first compared with a lead again, in rounds while these pay; pairs
   are then sought for the texts alone that are of another class than most that have the element.

Classes are the connected components of the links, found by alternating stars.

Defined results: a text without words (null, empty, blank) is only a copy of an equal text; null counts as empty. A text
of one to four words is one run. Repeated rows are copies. A class is named by its least id, null when none has an id.
An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.llm.common import Tables, materialize, ship, table, task

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5
#: Groups up to this size are compared in pairs.
WHOLE_GROUP = 16
#: Texts of large groups are compared with leads again while more than so many pairs a posting would meet, and that halves them.
CROWDED = 8
#: Bits of the filter that tells which texts are candidates: 2 MB, however many there are.
FILTER_BITS = 24

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(WORDS)]
#: The first rank level ends here; each further level is as wide as all before it.
_BASE = 0.5


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) * 2.0**-53


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The set of hashed runs of words of the lower-cased text; a shorter text is one run."""
    hashed = np.fromiter(map(zlib.crc32, text.lower().encode("utf-8", "replace").split()), np.uint64)
    if not len(hashed):
        return hashed
    if len(hashed) < words:
        hashed = np.r_[hashed, np.zeros(words - len(hashed), np.uint64)]
    n = len(hashed) - words + 1
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += _mix(hashed[k : k + n]) * _FACTORS[k]
    return np.unique(_mix(total))


def _poisson(area: float) -> np.ndarray:
    steps, p = [], math.exp(-area)
    total = p
    for k in range(1, 12):
        steps.append(total)
        p *= area / k
        total += p
    return np.array(steps)


_COUNTS = {level: _poisson(min(1.0, _BASE * 2.0 ** max(0, level - 1))) for level in range(8)}
_LEVELS = [np.uint64((level + 1) * 0x94D049BB133111EB % (1 << 64)) for level in range(64)]


def signature(elements: np.ndarray, weights: np.ndarray | None = None, size: int = BANDS * ROWS) -> np.ndarray:
    """The DartMinHash signature: for each coordinate the dart of lowest rank in the elements' regions."""
    weights = np.ones(len(elements)) if weights is None else weights
    # Weight levels [0, 1), [1, 2), [2, 4) ...: a row for each element and unit of weight that it reaches.
    units = np.ceil(weights).astype(np.int64)
    rows = np.repeat(elements, units)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(units) - units, units)
    most = np.repeat(weights, units) - at  # weight left in this unit
    rows = _mix(rows ^ (at.astype(np.uint64) * _MIX[1]))
    reach = size * (math.log(size) + 4) / float(weights.sum())
    while True:
        found, level, end = [], 0, 0.0
        while end < reach:
            start, end = end, _BASE * 2.0**level
            area = end - start
            parts = max(1, round(area))
            cells = _mix(rows + _LEVELS[level])
            if parts > 1:
                cells = _mix(np.repeat(cells, parts) + np.tile(np.arange(parts, dtype=np.uint64), len(rows)))
            steps = _COUNTS[min(level, 7)]
            u = _unit(cells)
            hit = np.flatnonzero(u >= steps[0])
            counts = np.searchsorted(steps, u[hit], side="right")
            own = np.repeat(hit, counts)
            turn = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            dart = _mix(cells[own] ^ ((turn.astype(np.uint64) + np.uint64(1)) * _MIX[1]))
            part = (own % parts) if parts > 1 else 0
            rank = start + (part + _unit(_mix(dart ^ _MIX[0]))) * (area / parts)
            inside = (rank < reach) & (_unit(_mix(dart ^ _MIX[1])) < most[own // parts])
            found.append((dart[inside], rank[inside]))
            level += 1
        dart = np.concatenate([d for d, _ in found])
        rank = np.concatenate([r for _, r in found])
        place = (_mix(dart ^ _MIX[2]) % np.uint64(size)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        out, full = np.zeros(size, np.uint64), np.zeros(size, bool)
        out[place[order]] = dart[order]
        full[place] = True
        if full.all():
            return out
        reach *= 2


def bands(text: str) -> tuple[int, list[int]]:
    """The number of runs and the hashed bands; a text without words has none."""
    own = shingles(text)
    if not len(own):
        return 0, []
    parts = signature(own).reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64) * _MIX[1]
    for k in range(ROWS):
        total = _mix(total ^ parts[:, k])
    return len(own), total.view(np.int64).tolist()


def _keyed(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(*more, F.col(key).alias("id"), F.unhex(F.md5(body.cast("binary"))).alias("key"), body.alias("body"))


def _texts(df: DataFrame) -> DataFrame:
    """Each different text: (key, n, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, tuple] = {}
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k not in seen:
                    seen[k] = bands(t.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.list_(pa.int64()))],
                ["key", "n", "bands"],
            )

    made = df.select("key", "body").mapInArrow(task("neardup", run), "key binary, n long, bands array<long>")
    return made.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))


def _runs(df: DataFrame, wanted: bytes) -> DataFrame:
    """(key, runs) of the texts whose key's bit is set in wanted; runs are the low 32 bits of the hashed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        for b in batches:
            seen: dict[bytes, np.ndarray] = {}
            hashed = b.column(2).to_numpy()
            inside = (bits[hashed >> 3] >> (hashed & 7)) & 1
            for k, t, hit in zip(b.column(0).to_pylist(), b.column(1), inside, strict=True):
                if hit and k not in seen:
                    seen[k] = np.unique(shingles(t.as_py()).astype(np.uint32)).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.list_(pa.int32()))], ["key", "runs"])

    made = df.select("key", "body", _bit("key").alias("bit")).mapInArrow(task("neardup", run), "key binary, runs array<int>")
    return made.groupBy("key").agg(F.first("runs").alias("runs"))


def _bit(key: str):
    return F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS)


def _filter(keys: DataFrame) -> bytes:
    """A bit for each key's hash: at most 2**FILTER_BITS bits come to the driver, in rows of 4 KB."""
    found = keys.select((_bit("key") + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for at, bits in found:
        out[(at - 1) * 4096 : at * 4096] = np.frombuffer(bits, np.uint8)
    return out.tobytes()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a lesser one, and none of those has one itself."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | (F.col("up") + F.col("down") > 1))
    return odd.isEmpty()


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(key, root) of every node of edges (a, b) that is not its component's least, by alternating large and small stars."""
    now = tables.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "stars")
    while not _is_stars(now):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = tables.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
        large = tables.write(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        least = tables.write(large.groupBy("a").agg(F.min("b").alias("m")), "star-least")
        joined = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = tables.write(joined.select("e.*").where("a > b").distinct(), "stars")
    return now.select(F.col("a").alias("key"), F.col("b").alias("root"))


def _near(a: str, b: str, similarity: float) -> Column:
    """Whether sets of so many elements can be similar."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _verified(runs: DataFrame, pairs: DataFrame, similarity: float, tables: Tables) -> DataFrame:
    """The pairs (a, b) of different texts whose sets of runs are similar."""
    with_a = pairs.join(runs.select(F.col("key").alias("a"), F.col("runs").alias("ra")), "a")
    with_b = with_a.join(runs.select(F.col("key").alias("b"), F.col("runs").alias("rb")), "b")
    common = F.size(F.array_intersect("ra", "rb"))
    good = with_b.select("a", "b", common.alias("c"), (F.size("ra") + F.size("rb") - common).alias("all"))
    good = good.select("a", "b", (F.col("c") / F.col("all")).alias("similarity")).where(F.col("similarity") >= similarity - 1e-9)
    return tables.write(good, "links")


def _one_each(frame: DataFrame, tables: Tables) -> DataFrame:
    """For each key the pair with the first of its hubs (score, key)."""
    picked = frame.groupBy("key").agg(F.max(F.struct("hub.score", "hub.key")).alias("hub"))
    return tables.write(picked.select(F.greatest("key", "hub.key").alias("a"), F.least("key", "hub.key").alias("b")).distinct(), "candidates")


def _mixed(rows: DataFrame, *group: str) -> DataFrame:
    """The groups whose rows are of several classes."""
    return rows.groupBy(*group).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(*group)


def _differences(rows: DataFrame, runs: DataFrame, similarity: float, tables: Tables) -> DataFrame:
    """A row for each text of a large group and the group's hub p: (p, key, n, similarity, near, cost, elements).

    near tells whether the text is similar to the hub; elements are its difference, runs that p lacks as even numbers and
    runs that the text lacks as odd ones. Two texts are similar if they share as many as their costs add up to.
    """
    level = F.floor(F.log(F.col("n")) / F.lit(math.log(1 / similarity))).cast("int")  # similar sets are one level apart at most
    parted = rows.withColumn("level", F.explode(F.array(level, level + 1)))
    parted = tables.write(parted.join(_mixed(parted, "bucket", "level"), ["bucket", "level"]), "levels")
    hub = F.max("hub").alias("hub")
    hubs = parted.groupBy("bucket", "level").agg(F.max(F.struct("score", "key")).alias("hub"))
    # The first of its members' hubs serves a group, so that groups of the same texts share one hub.
    known = parted.join(hubs, ["bucket", "level"]).groupBy("key", "level").agg(hub)
    hubs = parted.join(known, ["key", "level"]).groupBy("bucket", "level").agg(hub)
    pairs = parted.join(hubs, ["bucket", "level"]).select(F.col("hub.key").alias("p"), "key", "n").where("p <> key").distinct()
    both = pairs.join(runs, "key").join(runs.select(F.col("key").alias("p"), F.col("runs").alias("p_runs")), "p")
    both = both.withColumns({"new": F.array_except("runs", "p_runs"), "lost": F.array_except("p_runs", "runs")})
    both = both.withColumns({"n_new": F.size("new"), "n_lost": F.size("lost"), "np": F.size("p_runs")})
    alike = (F.size("runs") - F.col("n_new")) / (F.col("np") + F.col("n_new"))
    elements = F.concat(F.transform("new", lambda e: e.cast("long") * 2), F.transform("lost", lambda e: e.cast("long") * 2 + 1))
    weight = similarity / (1 + similarity)
    cost = (1 - weight) * F.col("n_lost") + weight * F.col("n_new") - (0.5 - weight) * F.col("np")
    near = alike >= similarity - 1e-9
    return tables.write(both.select("p", "key", "n", alike.alias("similarity"), near.alias("near"), cost.alias("cost"), elements.alias("elements")), "differences")


def _postings(rows: DataFrame, tables: Tables) -> DataFrame:
    """The elements by which the texts of differences can be found, (p, e, side, key, n, root, out, cost, lost, new).

    out tells whether the text is of another class than the hub and all that are near to it. Of two texts of different
    classes one is out, so an element counts only if a text that is out has it, and another one. The rarest element that
    two texts share is followed, in the order of rarity, by the others that they share: no more than the lesser of their
    lost and new runs from there on. A text is found by an element if enough follow for some other text; side is 0
    for finding each other among those that are out, 1 for finding those that are out from the rest.
    """
    inside = rows.where("near").select("p", "root").union(rows.select("p", "p_root")).distinct().withColumn("inside", F.lit(True))
    rows = rows.join(inside, ["p", "root"], "left").select("p", "key", "n", "root", F.col("inside").isNull().alias("out"), "cost", "elements")
    rows = tables.write(rows, "differences")
    least = rows.groupBy("p").agg(F.min(F.when(F.col("out"), F.col("cost"))).alias("out_least"), F.min(F.when(~F.col("out"), F.col("cost"))).alias("in_least"))
    rows = rows.join(least.where("out_least IS NOT NULL"), "p")
    made = rows.select("*", F.explode("elements").alias("e")).drop("elements")
    often = made.groupBy("p", "e").agg(F.count("*").alias("often"), F.max("out").alias("any")).where("often > 1 AND any").select("p", "e", "often")
    rest = Window.partitionBy("p", "key").orderBy("often", "e").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    made = made.join(often, ["p", "e"]).withColumns({"lost": F.sum(F.pmod("e", F.lit(2))).over(rest), "new": F.sum(1 - F.pmod("e", F.lit(2))).over(rest)})
    enough = [F.col("lost") + F.col("new") >= F.greatest(F.lit(1), F.col("cost") + F.col(f"{least}_least") - 1e-6) for least in ("out", "in")]
    sides = F.array(F.when(F.col("out") & enough[0], 0), F.when(F.when(F.col("out"), enough[1]).otherwise(enough[0]), 1))
    made = made.withColumn("side", F.explode(F.array_compact(sides)))
    made = tables.write(made.select("p", "e", "side", "key", "n", "root", "out", "cost", "lost", "new"), "postings")
    outs = F.count_if("out").alias("outs"), F.count_if(~F.col("out")).alias("ins")
    meet = made.groupBy("p", "e", "side").agg(*outs).where("side = 0 AND outs > 1 OR outs > 0 AND ins > 0")
    return tables.write(made.join(meet.select("p", "e", "side"), ["p", "e", "side"]), "postings")


def _by_leads(posts: DataFrame, similarity: float, turn: int, tables: Tables) -> DataFrame:
    """For each text that is out the one it meets most often among the leads of its elements, by another hash in each turn."""
    lead = F.max(F.struct(~F.col("out") & (F.col("side") == 1), F.xxhash64("key", F.lit(turn)), "key", "n", "root")).alias("hub")
    apart = posts.where("out").join(posts.groupBy("p", "e", "side").agg(lead), ["p", "e", "side"])
    met = apart.where((F.col("root") != F.col("hub.root")) & _near("n", "hub.n", similarity)).groupBy("key", "hub.key").agg(F.count("*").alias("score")).toDF("key", "lead", "score")
    return _one_each(met.select("key", F.struct("score", F.col("lead").alias("key")).alias("hub")), tables)


def _links(keyed: DataFrame, texts: DataFrame, similarity: float, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The links between different texts that make their classes, and the (key, root) of the classes."""
    members = texts.where("n > 0").select("key", "n", F.explode("bands").alias("bucket"))
    groups = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = tables.write(members.join(groups, "bucket"), "members")
    runs = tables.write(_runs(keyed, _filter(members.select("key"))), "runs")
    members = tables.write(members.join(members.groupBy("key").agg(F.sum("size").alias("score")), "key"), "members")

    hubs = members.groupBy("bucket").agg(F.max(F.struct("score", "key", "n")).alias("hub"))
    first = members.join(hubs, "bucket").where((F.col("key") != F.col("hub.key")) & _near("n", "hub.n", similarity))
    links = _verified(runs, _one_each(first, tables), similarity, tables)
    roots = components(links.select("a", "b"), tables)

    def join(more: DataFrame) -> None:
        nonlocal links, roots
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(roots.toDF("a", "b").union(more.select("a", "b")), tables)

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))

    rows = rooted(members)
    rows = tables.write(rows.join(_mixed(rows, "bucket"), "bucket"), "members")
    small = rows.where(F.col("size") <= WHOLE_GROUP)
    other = small.select("bucket", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    pairs = small.join(other, "bucket").where((F.col("key") > F.col("b")) & (F.col("root") != F.col("rb")) & _near("n", "nb", similarity))
    pairs = tables.write(pairs.select(F.col("key").alias("a"), "b").distinct(), "candidates")
    large = rows.where(F.col("size") > WHOLE_GROUP).select("bucket", "key", "n", "root", "score")
    rows = _differences(large, runs, similarity, tables)
    to_hub = rows.where("near").select(F.greatest("p", "key").alias("a"), F.least("p", "key").alias("b"), "similarity").distinct()
    hubs = roots.select(F.col("key").alias("p"), F.col("root").alias("p_root"))
    posts = _postings(rooted(rows).join(hubs, "p", "left").withColumn("p_root", F.coalesce("p_root", "p")), tables)
    pairs = pairs.union(_by_leads(posts, similarity, 0, tables)).distinct()
    join(_verified(runs, pairs, similarity, tables).unionByName(to_hub).dropDuplicates(["a", "b"]))

    def apart() -> tuple[DataFrame, int, int]:
        """The postings of elements that several classes have, their number and that of the pairs that meet in them."""
        rows = tables.write(rooted(posts.drop("root")), "postings")
        # Texts of an element's largest class there need not find each other: of two classes one is another.
        sizes = rows.groupBy("p", "e", "side", "root").agg(F.count("*").alias("texts"))
        tops = sizes.groupBy("p", "e", "side").agg(F.max(F.struct("texts", "root")).alias("top"), F.count("*").alias("classes"), F.sum("texts").alias("all")).where("classes > 1")
        count, meet = tops.agg(F.sum("all"), F.sum((F.col("all") - F.col("top.texts")) * F.col("all"))).first()
        rows = rows.join(tops.select("p", "e", "side", F.col("top.root").alias("top")), ["p", "e", "side"])
        return rows.withColumn("top", F.col("root") == F.col("top")), count or 0, meet or 0

    rows, count, meet = apart()
    before, turn = 2 * meet, 0
    while meet > CROWDED * count and 2 * meet <= before:
        before, turn = meet, turn + 1
        join(_verified(runs, _by_leads(rows, similarity, turn, tables), similarity, tables))
        rows, count, meet = apart()
    rows = tables.write(rows, "postings")
    names = ["key", "n", "root", "out", "top", "cost", "lost", "new"]
    x, y = (rows.select("p", "e", "side", *[F.col(c).alias(f"{c}_{end}") for c in names]) for end in "xy")
    once = F.col("top_y") | (F.col("key_x") > F.col("key_y"))
    enough = F.least("lost_x", "lost_y") + F.least("new_x", "new_y") >= F.col("cost_x") + F.col("cost_y") - 1e-6
    found = (F.col("side") == 0) | (F.col("out_x") != F.col("out_y"))
    pairs = x.where("NOT top_x").join(y, ["p", "e", "side"]).where((F.col("root_x") != F.col("root_y")) & once & found & enough & _near("n_x", "n_y", similarity))
    pairs = tables.write(pairs.select(F.greatest("key_x", "key_y").alias("a"), F.least("key_x", "key_y").alias("b")).distinct(), "candidates")
    join(_verified(runs, pairs, similarity, tables))
    return links, roots


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Classes of texts (text_key, class_id, winner, copies, class_size) and the links between different texts.

    winner is true for the text that stands for its class: the one with the least id, then the least key.
    """
    ship(df.sparkSession)
    keyed = _keyed(df, key, text)
    with Tables(df.sparkSession, "near-duplicates") as tables:
        texts = tables.write(_texts(keyed), "texts")
        links, roots = _links(keyed, texts, similarity, tables)
        ids = keyed.select("id", "key").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
        ids = tables.write(ids.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "text-classes")
        best = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("least"), F.col("key").alias("key")))
        classes = ids.groupBy("root").agg(best.alias("best"), F.sum("rows").alias("class_size"))
        out = ids.join(classes, "root").select(
            F.col("key").alias("text_key"), F.col("best.least").alias("class_id"), (F.col("best.key") == F.col("key")).alias("winner"), F.col("rows").alias("copies"), "class_size"
        )
        return materialize(out, "text-classes"), materialize(links, "links")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classes, _ = near_duplicates(docs)
    rows = _keyed(docs, "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"))
    return rows.join(classes, "text_key").select("doc_id", "class_id", "class_size", "copies", F.col("winner").alias("is_class_text"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near-duplicates, with the columns it came with: the least id of the class."""
    classes, _ = near_duplicates(docs, key, text)
    winners = classes.where("winner").select("text_key", F.col("class_id").alias("__id"), (F.col("copies") > 1).alias("__copied"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("__key"), F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))).alias("text_key"))
    stay = rows.join(winners, "text_key").where(F.col("__key").eqNullSafe(F.col("__id")))
    alone = stay.where(~F.col("__copied")).select("row.*")
    # Rows with equal id and text: which one stays makes no difference, but one must.
    again = stay.where("__copied").groupBy("text_key").agg(F.first("row").alias("row")).select("row.*")
    return alone.unionByName(again)
