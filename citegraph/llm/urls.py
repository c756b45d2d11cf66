"""URL filters: rules first, then words of the host and path scored by naive Bayes.

Names of hosts are split into words by the most likely segmentation (Viterbi over a unigram table): common words, and all
words that stand alone in the paths of all urls. The table is never sent whole: the substrings of the different hosts are
joined with it, so a host meets the words inside it and no others. A multinomial naive Bayes then scores the words of host
and path. Its counts come from all urls and all words: a url whose host holds a word of SEEDS teaches the block class by
its other words, any other url the allow class. A url is judged by what others teach, and a word's prior counts part as the
classes do, so a rare word says little. A seed itself has fixed odds, so that seeds among words of allowed urls are allowed, and words of seeded urls
block without a seed. A host's words count once for each of its urls. Keys that many rows share, hosts or words, are met
by a broadcast of at most HOT of them, others by a shuffle.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is scored on no word,
which allows it. A label over 63 letters, which no host name can have, is segmented 63 letters at a time. Repeated rows
keep a row each; only page_id and url are read. Of two equally likely segmentations the one with the longer last word
stays. Log odds are summed in billionths, so that no order of rows changes a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import Tables, materialize, ship, table, task


class Rule(NamedTuple):
    verdict: str
    text: str


#: A rule's text is a host, which fits its subdomains as well, and the beginning of a path.
RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))

#: Words that mark a host as one to block when they are among its words.
SEEDS = frozenset(
    "ads adult bet bets betting bingo bonus camgirls cams casino casinos cheap cialis clickbait crack cracks escort escorts fake farm gamble gambling hack "
    "hacks hentai jackpot keygen loan loans lottery malware nude payday phishing pharma pill pills poker porn roulette scam sex slots spam torrent torrents track tracker "
    "tracking viagra warez win winner xxx".split()
)
#: Common words, most frequent first: with SEEDS the default unigram table, by Zipf's law.
COMMON = (
    "com org net www example edu gov the of and to in a is for that on with by as at from it or be are this an not you your we our all new more home page site web online free "
    "news blog shop store mail info world data tech media game games music video photo book books movie travel food health life day time best top "
    "good great big first city school house art science sport sports team club group network net work team service services support guide help "
    "review reviews forum chat live tv radio money bank job jobs car cars phone app apps code dev cloud soft design studio digital social market "
    "trade deal deals sale price buy local green blue red black white star sun sea land water fire love kids baby family girl boy man men women "
    "people hotel tour event events daily weekly today times post press journal report weather maps wiki learn academy college open source"
).split()

#: Prior share of urls to block, log odds of a seed, and the prior counts of a word in the odds.
PRIOR, SEED_ODDS, PRIOR_COUNT = 0.1, 3.0, 10.0
#: The lengths of a counted word, and the longest label.
SHORTEST_WORD, LONGEST_WORD, LONGEST_LABEL = 4, 24, 63
#: A key with more than this part of all rows is hot; fewer than so many are.
HOT = 1_000
ROW, UNITS = "__row", 1e9


def _weights() -> dict[str, float]:
    return {w: 1.0 / (i + 3) for i, w in enumerate(dict.fromkeys([*COMMON, *sorted(SEEDS)]))}


def unigrams(counted: dict[str, int] | None = None) -> dict[str, float]:
    """Log probabilities of words: the common ones by Zipf's law, and counted ones, all together as weighty as those."""
    weight = _weights()
    if counted:
        share = sum(weight.values()) / sum(counted.values())
        for w, n in counted.items():
            weight[w] = max(weight.get(w, 0.0), n * share)
    total = sum(weight.values())
    return {w: math.log(v / total) for w, v in weight.items()}


def pooled(words: DataFrame) -> tuple[dict[str, float], float]:
    """What unigrams says of counted words (word, n) of any number: the common words' logs, and what to add to another's log n."""
    weight, total = _weights(), words.agg(F.sum("n")).first()[0]
    if not total:
        return unigrams(), 0.0
    share = sum(weight.values()) / total
    counts = {r["word"]: r["n"] for r in words.where(F.col("word").isin(list(weight))).collect()}  # at most the common words
    whole = sum(weight.values()) + sum(max(0.0, w - counts[k] * share) if k in counts else w for k, w in weight.items())
    return {k: math.log(max(w, counts.get(k, 0) * share) / whole) for k, w in weight.items()}, math.log(share / whole)


def path_words(urls: DataFrame) -> DataFrame:
    """(word, n): words that stand alone in paths, by how many urls."""
    words = urls.select(F.explode(F.array_distinct(F.split(F.lower("path"), "[^a-z]+"))).alias("word"))
    return words.where(F.length("word").between(SHORTEST_WORD, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


class Segmenter:
    """Viterbi segmentation of letters into words of a unigram table.

    An unknown word costs more with each letter, and more for each of the five letters that it lacks: what is left of a
    name beside a word inside it is no word.
    """

    def __init__(self, table: dict[str, float]):
        self.table = table

    def cost(self, word: str) -> float:
        return max(self.table.get(word, -math.inf), -8.0 - 2.0 * len(word) - 2.0 * max(0, 5 - len(word)))

    def split(self, name: str) -> list[str]:
        out: list[str] = []
        for at in range(0, len(name), LONGEST_LABEL):
            part = name[at : at + LONGEST_LABEL]
            best, back = [0.0], [0]
            for end in range(1, len(part) + 1):
                score, start = max((best[s] + self.cost(part[s:end]), -s) for s in {*range(max(0, end - LONGEST_WORD), end), 0})
                best.append(score)
                back.append(-start)
            words, end = [], len(part)
            while end:
                words.append(part[back[end] : end])
                end = back[end]
            out += reversed(words)
        return out


_LETTERS = re.compile(r"[a-z]+")


def host_words(host: str, segmenter: Segmenter) -> list[str]:
    return [w for label in _LETTERS.findall(host) for w in segmenter.split(label)]


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path: from the first :// on; the host in lower-case letters A to Z."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, lower), F.regexp_extract(text, pattern, 2)


def matched_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        name, _, rest = r.text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def join_hot(big: DataFrame, small: DataFrame, key: str, weight: str) -> DataFrame:
    """big with the row of small for its key; weight counts the rows of big that a row of small meets.

    The keys of more than one in HOT of all rows, of which there are fewer than HOT, are broadcast; others are shuffled.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT > total
    often = F.broadcast(small.where(hot).drop(weight))
    rest = big.join(often.select(key), key, "left_anti")
    return big.join(often, key).unionByName(rest.join(small.where(~hot).drop(weight), key))


def segmented(urls: DataFrame, words: DataFrame | None, table: dict[str, float] | None = None) -> DataFrame:
    """(host, n, host_words): the different hosts, each with its urls and words, by the counted words or by a given table."""
    ship(urls.sparkSession)
    hosts = urls.groupBy("host").agg(F.count("*").alias("n"))
    known, unit, found = table, 0.0, F.lit(None).cast("array<struct<word:string,n:bigint>>").alias("found")
    if words is not None:
        known, unit = pooled(words)
        starts = lambda c: F.sequence(F.lit(0), F.floor((F.length(c) - 1) / LONGEST_LABEL).cast("int"))
        labels = F.flatten(F.transform(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0)), lambda c: F.transform(starts(c), lambda i: F.substr(c, i * LONGEST_LABEL + 1, F.lit(LONGEST_LABEL)))))
        label = hosts.select("host", F.explode(F.array_distinct(labels)).alias("label")).where(F.length("label") >= SHORTEST_WORD)
        at = label.select("host", "label", F.explode(F.sequence(F.lit(1), F.length("label") - SHORTEST_WORD + 1)).alias("at"))
        lengths = F.sequence(F.lit(SHORTEST_WORD), F.least(F.lit(LONGEST_WORD), F.length("label") - F.col("at") + 1))
        inside = at.select("host", F.explode(F.transform(lengths, lambda k: F.substr("label", F.col("at"), k))).alias("word"))
        others = words.where(~F.col("word").isin(list(known)))
        hosts = hosts.join(inside.join(others, "word").groupBy("host").agg(F.collect_set(F.struct("word", "n")).alias("found")), "host", "left")
        found = F.col("found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)
            split = [host_words(host, Segmenter(known | {f["word"]: math.log(f["n"]) + unit for f in more or ()})) for host, more in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(split, pa.list_(pa.string()))], ["host", "n", "host_words"])

    return hosts.select("host", "n", found).mapInArrow(task("urls", run), "host string, n long, host_words array<string>")


def features(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """urls with host_words, __seeds (how many are seeds) and __words: the host's others, and the path's marked by a slash. Digits are one word."""
    seed = lambda w: w.isin(sorted(SEEDS))
    tail = F.transform(F.regexp_extract_all(F.lower("path"), F.lit("[a-z]+|[0-9]+"), F.lit(0)), lambda w: F.when(w < "a", "/#").otherwise(F.concat(F.lit("/"), w)))
    made = join_hot(urls, hosts, "host", "n")
    return made.withColumns({"__seeds": F.size(F.filter("host_words", seed)), "__words": F.concat(F.filter("host_words", lambda w: ~seed(w)), tail)})


def bags(made: DataFrame) -> DataFrame:
    """(__row, block, word, times): the words of each url, and whether its host holds a seed."""
    words = made.select(ROW, (F.col("__seeds") > 0).alias("block"), F.explode("__words").alias("word"))
    return words.groupBy(ROW, "block", "word").agg(F.count("*").alias("times"))


def counts_of(bag: DataFrame) -> DataFrame:
    """(word, blocked, n): how often words stand in urls that teach the block class, and in all."""
    return bag.groupBy("word").agg(F.sum(F.when(F.col("block"), F.col("times")).otherwise(0)).alias("blocked"), F.sum("times").alias("n"))


def points(met: DataFrame, share: float) -> DataFrame:
    """(__row, __points): summed log likelihood ratios (block to allow) in billionths, by what other urls teach of the words.

    met: bags with the counts of their words. The prior counts of a word in the classes are PRIOR_COUNT parted by share,
    as all words are, so a word that nothing is known of has a ratio of one.
    """
    blocked = F.col("blocked") - F.when(F.col("block"), F.col("times")).otherwise(0)
    allowed = F.col("total") - F.col("times") - blocked
    ratio = F.log((blocked + PRIOR_COUNT * share) / (allowed + PRIOR_COUNT * (1 - share))) - math.log(share / (1 - share))
    return met.groupBy(ROW).agg(F.sum(F.round(ratio * UNITS).cast("long") * F.col("times")).alias("__points"))


def judge(df: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple[Rule, ...] = RULES, table: dict[str, float] | None = None) -> DataFrame:
    """The columns in keep, with host, path, rule, verdict, the score (log odds to block) and the host's words.

    table: log probabilities of words, in place of the common ones and those of the paths.
    """
    host, path = parts(url)
    with Tables(df.sparkSession, "urls") as own:
        rows = df.select(*keep, host.alias("host"), path.alias("path"))
        text, by_rule = matched_rule(rules, F.col("host"), F.col("path"))
        rows = own.write(rows.withColumns({"rule": text, "__verdict": by_rule, ROW: F.monotonically_increasing_id()}), "rows")
        words = own.write(path_words(rows), "words") if table is None else None
        made = own.write(features(rows, own.write(segmented(rows, words, table), "hosts")), "features")
        bag = own.write(bags(made), "bags")
        counts = own.write(counts_of(bag), "counts")
        taught = counts.agg(F.sum("blocked"), F.sum("n")).first()
        scores = rows.select(ROW, F.lit(0).cast("long").alias("__points")).limit(0)
        if taught[0] and taught[0] < taught[1]:  # one class alone teaches nothing
            scores = points(join_hot(bag, counts.withColumn("total", F.col("n")), "word", "n"), taught[0] / taught[1])
        start = math.log(PRIOR / (1 - PRIOR))
        score = F.lit(start) + SEED_ODDS * F.col("__seeds") + F.coalesce("__points", F.lit(0)) / UNITS
        verdict = F.coalesce("__verdict", F.when(F.col("score") >= 0, "block").otherwise("allow"))
        scored = made.join(scores, ROW, "left").withColumn("score", score)
        return materialize(scored.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "score", "host_words"), "urls-judged")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
