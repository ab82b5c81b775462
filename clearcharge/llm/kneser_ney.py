"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark, kept as sorted arrays, mapped by workers.

Counting takes two passes over the texts. The first counts words (64-bit hashes) into shards by hash; a word's id is
its place in the sorted hashes. The second counts pairs of ids (the first word of a text follows a mark of its own)
into shards by the first word; first words that would fill a shard are spread by the second word. Each shard is sorted
and written once: keys, counts, and of each first word how many of its pairs were seen once, twice, or more often. The
number of different words before a word is summed in the shards of its hash.

p(v | u) = max(c(uv) - D(c), 0) / c(u) + g(u) p(v), p(v) = max(a(v) - D'(a), 0) / pairs + g' / (words + 1), where a(v)
counts the different words before v, and D are the three discounts from the counts of counts. What was never seen
gets g' / (words + 1). Probabilities sum to one over the words and one unknown word.

Workers map the arrays; only pages that are looked up are read. Nothing is gathered on the driver but figures of the
shards (a few numbers each, and at most 16 frequent words each).

Cases: null and empty texts hold only the end of the text; no training text gives probability one to everything;
repeated rows count each; long texts are taken whole; more than 2^32 - 2 different words raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcharge.llm.common import materialise, new_work_path, scramble, texts_of, word_hashes
from clearcharge.llm.shared_files import map_array, write_array

START = np.uint64(0xFFFFFFFF)  # the mark before a text, as an id
END = b""  # the end of a text; no word is empty
UNKNOWN = np.uint64(0xFFFFFFFE)


def plain_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, ASCII letters lowered."""
    return text.lower().split()


def portions(batch: pa.RecordBatch, most: int = 6_000_000, text: int = -1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in the text column, or one longer text; bounds a worker's memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text % batch.num_columns)), 0).to_numpy(zero_copy_only=False)
    for _, a, b in _runs(np.cumsum(sizes) // most):
        yield batch.slice(a, b - a)


def token_arrays(batch: pa.RecordBatch, cut: Callable, text: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch's text column (each text ends in an end), and the lengths."""
    parts = [word_hashes([*cut(t), END]) for t in texts_of(batch.column(text % batch.num_columns))]
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.array([len(p) for p in parts], np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2, 3 and more, from the numbers of things seen once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *[min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]])


@dataclass
class Model:
    """Where the arrays are, and the numbers that belong to the whole."""

    folder: str
    bits: int
    word_sizes: np.ndarray  # by shard
    pair_sizes: np.ndarray
    context_sizes: np.ndarray
    texts: int
    tokens: int
    hot: np.ndarray  # sorted ids of first words that are spread over shards
    hot_once: np.ndarray = field(default_factory=lambda: np.empty((0, 3)))
    pair_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_spare: float = 1.0

    def __post_init__(self):
        self.bases = np.concatenate([[0], np.cumsum(self.word_sizes)]).astype(np.int64)
        self.maps: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"maps": {}}

    @property
    def words(self) -> int:
        return int(self.bases[-1])

    @property
    def pairs(self) -> int:
        return int(self.pair_sizes.sum())

    def shard_of_hash(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def shard_of_pair(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        mixed = scramble(u)
        if len(self.hot):
            spread = np.isin(u, self.hot)
            mixed = np.where(spread, mixed ^ scramble(v + np.uint64(1)), mixed)
        return self.shard_of_hash(mixed)

    def array(self, name: str, shard: int, dtype) -> np.ndarray:
        at = f"{name}-{shard}"
        if at not in self.maps:
            self.maps[at] = map_array(f"{self.folder}/{at}", dtype)
        return self.maps[at]

    def look_up(self, hashes: np.ndarray, with_before: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted hashes: ids (UNKNOWN if never seen), counts, and numbers of different words before."""
        ids, counts, before = np.full(len(hashes), UNKNOWN), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for s, a, b in _runs(self.shard_of_hash(hashes)):
            if not self.word_sizes[s]:
                continue
            known = self.array("word", s, np.uint64)
            at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashes[a:b])
            ids[a + hit] = (self.bases[s] + at[hit]).astype(np.uint64)
            counts[a + hit] = self.array("count", s, np.int64)[at[hit]]
            if with_before:
                before[a + hit] = self.array("before", s, np.int64)[at[hit]]
        return ids, counts, before

    def pair_counts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Counts of known pairs."""
        out, shard, keys = np.zeros(len(u), np.int64), self.shard_of_pair(u, v), (u << np.uint64(32)) | v
        order = np.lexsort((keys, shard))
        for s, a, b in _runs(shard[order]):
            if not self.pair_sizes[s]:
                continue
            known, mine = self.array("pair", s, np.uint64), keys[order[a:b]]
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            hit = known[at] == mine
            out[order[a:b][hit]] = self.array("times", s, np.int64)[at[hit]]
        return out

    def kinds(self, u: np.ndarray) -> np.ndarray:
        """Of sorted first words: how many pairs were seen once, twice, more often."""
        out = np.zeros((len(u), 3))
        hot = np.isin(u, self.hot)
        out[hot] = self.hot_once[np.searchsorted(self.hot, u[hot])]
        rest = np.flatnonzero(~hot)
        shard = self.shard_of_hash(scramble(u[rest]))
        order = np.lexsort((u[rest], shard))
        for s, a, b in _runs(shard[order]):
            if not self.context_sizes[s]:
                continue
            known, mine = self.array("first", s, np.uint64), rest[order[a:b]]
            at = np.minimum(np.searchsorted(known, u[mine]), len(known) - 1)
            hit = known[at] == u[mine]
            out[mine[hit]] = self.array("kinds", s, np.int64).reshape(-1, 3)[at[hit]]
        return out

    def score(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: tokens known, plain score (add one), model score; both log10."""
        texts = np.repeat(np.arange(len(lengths)), lengths)
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts, before = self.look_up(distinct, with_before=True)
        plain = np.log10((counts + 1.0) / (self.tokens + (self.words + 1)))
        lower = self.word_spare / (self.words + 1) + (before - self.word_discounts[np.minimum(before, 3)]) / max(self.pairs, 1)
        v = ids[back]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.empty(0, np.int64)
        u = np.concatenate([v[:1], v[:-1]])
        u[first] = START
        weight = np.ones(len(v))  # of the lower order; all of it after an unknown word
        upper = np.zeros(len(v))
        seen = np.flatnonzero((u != UNKNOWN) & (self.pairs > 0))
        if len(seen):
            contexts, to = np.unique(u[seen], return_inverse=True)
            kinds = self.kinds(contexts)
            known_words = contexts != START
            total = np.full(len(contexts), max(self.texts, 1), float)
            place = np.argsort(ids)  # ids grow with hashes; unknown ones come last
            total[known_words] = counts[place[np.searchsorted(ids[place], contexts[known_words])]]
            weight[seen] = ((kinds @ self.pair_discounts[1:]) / total)[to]
            both = seen[v[seen] != UNKNOWN]
            keys, to_pair = np.unique((u[both] << np.uint64(32)) | v[both], return_inverse=True)
            times = self.pair_counts(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF))[to_pair]
            at = np.zeros(len(v), np.int64)
            at[seen] = to
            upper[both] = (times - self.pair_discounts[np.minimum(times, 3)]) / total[at[both]]
        full = np.log10(upper + weight * lower[back])
        known = np.bincount(texts, weights=(counts > 0)[back], minlength=len(lengths)).astype(np.int64)
        return known, np.bincount(texts, weights=plain[back], minlength=len(lengths)), np.bincount(texts, weights=full, minlength=len(lengths))


def _runs(sorted_values: np.ndarray):
    """(value, first, past the last) of each run of equal values."""
    if len(sorted_values):
        edges = np.flatnonzero(np.diff(sorted_values)) + 1
        for a, b in zip([0, *edges], [*edges, len(sorted_values)], strict=True):
            yield int(sorted_values[a]), int(a), int(b)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several portions as one."""
    if len(counts) == 1:
        return counts[0]
    keys = np.concatenate([np.empty(0, np.uint64), *[k for k, _ in counts]])
    n = np.concatenate([np.empty(0, np.int32), *[n.astype(np.int32) for _, n in counts]])  # of one batch
    counts.clear()
    return _summed(keys, n)


def _by_shard(batches: Iterator[pa.RecordBatch]):
    """All rows (shard, key, n) of a task, shard by shard, summed by key."""
    parts = [[c.to_numpy() for c in (b.column(0), b.column(1), b.column(2))] for b in batches if b.num_rows]
    if not parts:
        return
    shard, keys, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(shard, kind="stable")
    for s, a, b in _runs(shard[order]):
        yield s, *_summed(keys[order[a:b]].view(np.uint64), n[order[a:b]])


COUNTED = "shard int, key bigint, n bigint"


def _counted(shard: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["shard", "key", "n"])


def train(docs: DataFrame, text: str = "text", cut: Callable = plain_words, name: str = "model") -> Model:
    """Counts every text of `docs`."""
    source = docs.select(F.col(text).alias("text"))
    bits = max(4, (4 * source.rdd.getNumPartitions() - 1).bit_length())
    shards, folder = 1 << bits, new_work_path(docs.sparkSession, name)
    model = Model(folder, bits, np.zeros(shards, np.int64), np.zeros(shards, np.int64), np.zeros(shards, np.int64), 0, 0, np.empty(0, np.uint64))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = _merged([np.unique(token_arrays(part, cut)[0], return_counts=True) for part in portions(batch)])
            yield _counted(model.shard_of_hash(keys), keys, n)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = word_hashes([END])[0]
        for s, keys, n in _by_shard(batches):
            write_array(f"{folder}/word-{s}", keys)
            write_array(f"{folder}/count-{s}", n)
            often = np.flatnonzero((n * 16 >= n.sum()) & (keys != end))
            rows = [{"shard": s, "words": len(keys), "tokens": int(n.sum()), "texts": int(n[keys == end].sum()), "at": often.tolist(), "times": n[often].tolist()}]
            yield from pa.Table.from_pylist(rows, pa.schema([("shard", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64()), ("texts", pa.int64()), ("at", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])).to_batches()

    words = source.mapInArrow(count_words, COUNTED).repartition(shards, "shard").mapInArrow(write_words, "shard int, words bigint, tokens bigint, texts bigint, at array<bigint>, times array<bigint>")
    figures = materialise(words, f"{name}-words").collect()  # a row for each shard
    sizes = model.word_sizes.copy()
    for r in figures:
        sizes[r["shard"]] = r["words"]
    tokens, texts = sum(r["tokens"] for r in figures), sum(r["texts"] for r in figures)
    model = Model(folder, bits, sizes, model.pair_sizes, model.context_sizes, texts, tokens, np.empty(0, np.uint64))
    if model.words >= int(UNKNOWN):
        raise ValueError(f"{model.words} different words; ids have 32 bits")
    hot = [int(model.bases[r["shard"]]) + i for r in figures for i, n in zip(r["at"], r["times"], strict=True) if n * 4 * shards > tokens]
    model.hot = np.array(sorted([*hot, int(START)] if texts * 4 * shards > tokens else hot), np.uint64)

    def pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        hashes, lengths = token_arrays(batch, cut)
        distinct, back = np.unique(hashes, return_inverse=True)
        v = model.look_up(distinct)[0][back]
        u = np.concatenate([v[:1], v[:-1]])
        u[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = START
        return np.unique((u << np.uint64(32)) | v, return_counts=True)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = _merged([pairs_of(part) for part in portions(batch)])
            yield _counted(model.shard_of_pair(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)), keys, n)

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, n in _by_shard(batches):
            u, v = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
            write_array(f"{folder}/pair-{s}", keys)
            write_array(f"{folder}/times-{s}", n)
            first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            kinds = np.stack([np.add.reduceat((np.minimum(n, 3) == k).astype(np.int64), first) for k in (1, 2, 3)], axis=1)
            write_array(f"{folder}/first-{s}", u[first])
            write_array(f"{folder}/kinds-{s}", kinds)
            spread = np.isin(u[first], model.hot)
            after, before = np.unique(v, return_counts=True)
            place = np.searchsorted(model.bases, after.astype(np.int64), side="right") - 1
            head = [[0], [s], [len(keys)], [len(first)], *[[int((n == k).sum())] for k in (1, 2, 3, 4)]]
            hot_rows = [np.full(int(spread.sum()), 1), u[first][spread].astype(np.int64), *kinds[spread].T]
            words = [np.full(len(after), 2), place, after.astype(np.int64), before]
            columns = [np.concatenate([np.asarray(head[k], np.int64), np.asarray(hot_rows[k], np.int64) if k < 5 else np.zeros(len(hot_rows[0]), np.int64), np.asarray(words[k], np.int64) if k < 4 else np.zeros(len(after), np.int64)]) for k in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", *"abcdefg"])

    counted = source.mapInArrow(count_pairs, COUNTED).repartition(shards, "shard")
    told = materialise(counted.mapInArrow(write_pairs, "kind bigint, " + ", ".join(f"{c} bigint" for c in "abcdefg")), f"{name}-pairs")
    times = np.zeros(4)
    for r in told.filter("kind = 0").collect():  # a row for each shard
        model.pair_sizes[r["a"]], model.context_sizes[r["a"]] = r["b"], r["c"]
        times += [r["d"], r["e"], r["f"], r["g"]]
    model.pair_discounts = discounts(times)
    model.hot_once = np.zeros((len(model.hot), 3))
    for r in told.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("b"), F.sum("c").alias("c"), F.sum("d").alias("d")).collect():  # four for each shard at most
        model.hot_once[np.searchsorted(model.hot, np.uint64(r["a"]))] = [r["b"], r["c"], r["d"]]

    def write_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, ids, n in _by_shard(batches):
            values = np.zeros(int(model.word_sizes[s]), np.int64)
            values[ids.astype(np.int64) - model.bases[s]] = n
            write_array(f"{folder}/before-{s}", values)
            few = np.bincount(np.minimum(values, 5), minlength=6)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "few": pa.array([few.tolist()], pa.list_(pa.int64()))})

    before = told.filter("kind = 2").select(F.col("a").cast("int").alias("shard"), F.col("b").alias("key"), F.col("c").alias("n"))
    few = np.zeros(6)
    for r in materialise(before.repartition(shards, "shard").mapInArrow(write_before, "shard int, few array<bigint>"), f"{name}-before").collect():
        few += r["few"]
    model.word_discounts = discounts(few[1:5])
    d = model.word_discounts
    model.word_spare = (d[1] * few[1] + d[2] * few[2] + d[3] * few[3:].sum()) / model.pairs if model.pairs else 1.0
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", cut: Callable = plain_words) -> DataFrame:
    """key, n_tokens, n_known, base_score, score of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            hashes, lengths = token_arrays(batch, cut)
            known, plain, full = model.score(hashes, lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pa.array(known), pa.array(plain), pa.array(full)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    out = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(work, "id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumnRenamed("id", key)
