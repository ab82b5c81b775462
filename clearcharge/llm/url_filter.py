"""URL filter: rules first, then naive Bayes over the words of host and path.

Letter runs of host and path are names. A name is cut into words by Viterbi over a unigram model of all words of the
documents (an unknown word of L letters has the chance 10 / (N * 10^L)). The words of the whole table's URLs train a
multinomial naive Bayes with add-one counts: a URL is an example of `block` if it holds one of the seed words as a
whole name, or one of five letters or more anywhere, and of `allow` otherwise. So a URL without any seed is blocked if
its other words keep the company of seeds.

All of it is joins over different names, words and shapes (the names of a URL): what many URLs share is cut and scored
once, and keys that hold over a thousandth of the rows are joined by broadcast (at most a thousand keys), the rest over
a shuffle.

Cases: a URL that is null or holds no `://` has an empty host and path; without names a URL gets what the classes'
shares say (allow, unless most are blocked). Names are cut at 63 letters, the longest a host label may be, longer runs
into several. Equally cheap cuts are settled for the longer last word. Repeated URLs count each; rows without an id are
judged like others. No documents: seed words are the only known ones. No example of `block`: all are allowed; none of
`allow`: all are blocked. Only the key and URL columns are read, so extra columns cannot clash; no pages give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearcharge.llm.common import materialise, texts_of
from clearcharge.llm.kneser_ney import portions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAME = r"[a-z\x{80}-\x{10FFFF}]{1,63}"
WORD = re.compile(rb"[a-z\x80-\xff]+")
# Words of common blocklist categories: gambling, drugs, adult, advertising, fraud.
SEEDS = (
    "casino", "poker", "jackpot", "lottery", "betting", "bets", "slots",
    "pills", "pharmacy", "viagra", "cialis",
    "porn", "xxx", "escort", "nude",
    "ads", "adserver", "banner", "popup", "track", "tracker", "affiliate",
    "spam", "warez", "payday", "loans", "phishing", "malware",
)
SEED_SHARE = 1e-5  # a seed is taken for at least this share of the words, so that names are cut at it
HOT_KEYS = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without `://`."""
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    after = F.when(at > 0, F.substring(known, at + 3, F.length(known))).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def by_rules(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        text, verdict = F.when(r.fits(host, path), r.text).otherwise(text), F.when(r.fits(host, path), r.verdict).otherwise(verdict)
    return text, verdict


def spread_join(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Inner join with a side whose keys are single and whose `held` says how many of the rows have the key. Keys with
    more than a thousandth of the rows, at most a thousand, are broadcast; the others are shuffled."""
    total = side.agg(F.sum("held")).first()[0] or 0
    hot = F.col("held") * HOT_KEYS > total
    return rows.join(F.broadcast(side.filter(hot).drop("held")), key).unionByName(rows.join(side.filter(~hot).drop("held"), key))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n of all letter runs of all texts (A-Z lowered); each task adds up portions of text before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in portions(batch):
                counts: Counter[bytes] = Counter()
                for t in texts_of(few.column(0)):
                    counts.update(WORD.findall(t.lower()))
                words = [w.decode("utf-8", "replace") for w in counts]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def cut(name: str, known: list[tuple[int, int, int]], total: float) -> list[str]:
    """The cheapest words of a name; `known` has start, length and count of the known words inside."""
    ending, top = defaultdict(list), math.log10(total)
    for start, length, n in known:
        ending[start + length].append((start, n))
    cost, back = [0.0], [0]
    lowest = 0  # the start with which an unknown word is cheapest; another letter costs the same for all
    for end in range(1, len(name) + 1):
        best, at = cost[lowest] + top - 1 + (end - lowest), lowest
        for start, n in sorted(ending[end]):
            c = cost[start] + top - math.log10(n)
            if c < best or (c == best and start < at):
                best, at = c, start
        cost.append(best)
        back.append(at)
        if cost[end] - end < cost[lowest] - lowest:
            lowest = end
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """name, words of each different name."""
    total = (counts.agg(F.sum("n")).first()[0] or 0) + len(seeds)
    least = max(1, int(total * SEED_SHARE))
    added = names.sparkSession.createDataFrame([(s, least) for s in seeds], "word string, n bigint")
    dictionary = counts.unionByName(added).groupBy("word").agg(F.sum("n").alias("n"))
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start"))
    inside = materialise(starts.select("name", "start", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("start") + 1)).alias("length")).select("name", F.col("start") - 1, "length", F.expr("substring(name, start, length)").alias("word")).toDF("name", "start", "length", "word"), "url-substrings")
    side = materialise(inside.groupBy("word").agg(F.count("*").alias("held")).join(dictionary, "word"), "url-words")
    known = spread_join(inside, side, "word").groupBy("name").agg(F.collect_list(F.struct("start", "length", "n")).alias("known"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            words = [cut(r["name"], [(k["start"], k["length"], k["n"]) for k in r["known"] or []], total) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return names.select("name").join(known, "name", "left").mapInArrow(work, "name string, words array<string>")


@dataclass
class Filter:
    """urls: a row per URL with what the rules say and its shape. shapes: score of each shape (above 0 is block).
    segments: words of each name. weights: what a word adds to the score."""

    urls: DataFrame
    shapes: DataFrame
    segments: DataFrame
    weights: DataFrame


def fitted(pages: DataFrame, docs: DataFrame, rules: tuple[Rule, ...] = RULES, seeds: tuple[str, ...] = SEEDS, key: str = "page_id", url: str = "url", text: str = "text") -> Filter:
    host, path = parts(F.col(url))
    rows = pages.select(F.col(key).cast("bigint").alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    found = [F.regexp_extract_all(c, F.lit(f"({NAME})"), F.lit(1)) for c in (F.col("host"), F.translate("path", UPPER, LOWER))]
    urls = materialise(rows.select("*", rule.alias("rule"), verdict.alias("ruled"), F.array_join(F.concat(*found), " ").alias("shape")), "url-parts")
    shapes = materialise(urls.groupBy("shape").agg(F.count("*").alias("held")), "url-shapes")
    occurring = materialise(shapes.filter("shape <> ''").select("shape", F.explode(F.split("shape", " ")).alias("name")).groupBy("shape", "name").agg(F.count("*").alias("times")), "url-names")
    names = occurring.groupBy("name").agg(F.count("*").alias("held"))
    segments = materialise(segmented(names, materialise(word_counts(docs, text), "url-corpus"), seeds), "url-segments")

    is_seed = F.col("word").isin(*seeds) & ((F.col("word") == F.col("name")) | (F.length("word") >= 5))
    in_names = segments.select("name", F.explode("words").alias("word")).select("name", "word", is_seed.alias("seed"))
    bags = in_names.groupBy("name", "word").agg(F.count("*").alias("n"), F.max("seed").alias("seed")).groupBy("name").agg(F.collect_list(F.struct("word", "n", "seed")).alias("bag"))
    each = spread_join(occurring, materialise(names.join(bags, "name"), "url-name-bags"), "name").select("shape", "times", F.explode("bag").alias("b"))
    held = materialise(each.groupBy("shape", F.col("b.word").alias("word")).agg(F.sum(F.col("times") * F.col("b.n")).alias("times"), F.max("b.seed").alias("seed")), "url-bags")

    labelled = materialise(shapes.join(held.groupBy("shape").agg(F.max("seed").alias("block")), "shape", "left").select("shape", "held", F.coalesce("block", F.lit(False)).alias("block")), "url-labels")
    share = {r["block"]: r["n"] for r in labelled.groupBy("block").agg(F.sum("held").alias("n")).collect()}
    if len(share) < 2:  # one class only: nothing to tell apart
        score = 1.0 if share.get(True) else -1.0
        nothing = held.select("word", F.lit(0.0).alias("weight")).limit(0)
        return Filter(urls, labelled.select("shape", "held", F.lit(score).alias("score")), segments, nothing)
    counted = held.join(labelled, "shape").select("word", "block", (F.col("times") * F.col("held")).alias("n"))
    words = materialise(counted.groupBy("word").agg(F.count("*").alias("held"), F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("blocked"), F.sum(F.when(F.col("block"), 0).otherwise(F.col("n"))).alias("allowed")), "url-word-classes")
    size, blocked, allowed = words.agg(F.count("*"), F.sum("blocked"), F.sum("allowed")).first()
    weight = F.log((F.col("blocked") + 1) / F.lit(float(blocked + size))) - F.log((F.col("allowed") + 1) / F.lit(float(allowed + size)))
    weights = words.select("word", "held", weight.alias("weight"))
    added = spread_join(held.select("shape", "word", "times"), weights, "word").groupBy("shape").agg(F.sum(F.col("times") * F.col("weight")).alias("added"))
    score = F.round(F.coalesce("added", F.lit(0.0)) + math.log(share[True] / share[False]), 9)
    return Filter(urls, materialise(shapes.join(added, "shape", "left").select("shape", "held", score.alias("score")), "url-scores"), segments, weights.drop("held"))


def judged(pages: DataFrame, docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and the method's score (above 0 is block) of every URL."""
    f = fitted(pages, docs, rules, key=key, url=url)
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return spread_join(f.urls, f.shapes, "shape").select(F.col("id").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")
