"""Near-copies by MinHash bands and odd sketches, every link confirmed on full shingle sets.

1. One pass over the texts: distinct shingles (64-bit hashes of lower-cased word runs), a hash of the whole set,
   MinHash bands, and an odd sketch: the MinHash samples folded into a bitmap by parity. Two sketches' XOR has few
   ones only if the sets are much alike.
2. Documents with equal sets are one class; the smallest id stands for it. Copies never meet as pairs.
3. In each band bucket every class is compared with the bucket's smallest id (a star, so as many pairs as rows).
   Sketches drop pairs far below the threshold, full sets confirm the rest, components are formed.
4. What is left are pairs in one bucket that are in different components. Small buckets list them (at most 31 for a
   row) and full sets confirm them; large ones are compared block by block, each block pair a group of its own:
   sketches, then full sets, and of the links only those that join components leave the block.

With 56 bands of 6 rows a pair at similarity 0.8 shares no bucket with probability 4e-8; the sketch drops such a pair
with about 1e-9. Nothing is capped.

Cases: null, empty and wordless texts have no shingles, are linked with nothing and are their own component; a text
of fewer words than a shingle is one shingle; repeated rows with one id count as one document; ties go to the
smaller id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcharge.llm.common import gram_hashes, materialise, new_work_path, scramble, texts_of, word_hashes
from clearcharge.llm.graph import components
from clearcharge.llm.kneser_ney import portions
from clearcharge.llm.shared_files import map_array, write_array
from clearcharge.session import broadcast_if_small

BANDS, ROWS = 56, 6
SKETCH_BITS = 2048
SMALL_BUCKET, BLOCK = 32, 1024
PORTION_BYTES = 2_000_000
# Sketch estimates below this are dropped: over six standard deviations under a true similarity of 0.8.
LEAST_ESTIMATE = 0.62
_random = np.random.default_rng(20240607)
_MUL = (_random.integers(0, 2**32, BANDS * ROWS, np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _random.integers(0, 2**32, BANDS * ROWS, np.uint64).astype(np.uint32)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n lower-cased words (ASCII letters lowered, ASCII white space cuts)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < n:
        return scramble(gram_hashes(hashes, len(words)) ^ np.uint64(len(words)))
    return np.unique(gram_hashes(hashes, n))


def minhash(items: np.ndarray) -> np.ndarray:
    low = (items >> np.uint64(32)).astype(np.uint32)
    out = np.empty(BANDS * ROWS, np.uint32)
    step = max(1, min(BANDS * ROWS, 200_000 // len(low)))
    for k in range(0, BANDS * ROWS, step):
        grid = np.multiply.outer(_MUL[k : k + step], low)
        grid += _ADD[k : k + step, None]
        out[k : k + step] = grid.min(axis=1)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = scramble(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
    for k in range(ROWS):
        key = scramble(key ^ rows[:, k])
    return key


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples as 64-bit words."""
    at = scramble(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


def estimate(ones):
    """Similarity from the XOR's ones (a column or an array)."""
    return 1 + SKETCH_BITS / (4.0 * BANDS * ROWS) * np.log(1 - 2.0 * np.minimum(ones, SKETCH_BITS // 2 - 1) / SKETCH_BITS)


MOST_ONES = max(x for x in range(SKETCH_BITS // 2) if estimate(x) >= LEAST_ESTIMATE)


def set_key(items: np.ndarray) -> tuple[int, int]:
    if not len(items):
        return 0, 0
    mixed = scramble(items + np.uint64(0x51))
    return int(np.bitwise_xor.reduce(items.view(np.int64))), int(mixed.view(np.int64).sum())


def features(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """id, n_shingles, set_a, set_b, bands, sketch."""
    schema = "id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in (part for whole in batches for part in portions(whole, PORTION_BYTES)):
            n, a, b, bands, sketches = [], [], [], [], []
            for value in texts_of(batch.column(1)):
                items = shingles(value, words)
                at = set_key(items)
                if len(items) and at not in known:
                    if len(known) >= 2_000:
                        known.clear()
                    samples = minhash(items)
                    known[at] = band_keys(samples).view(np.int64), odd_sketch(samples).view(np.int64)
                keys, sketch = known[at] if len(items) else (np.empty(0, np.int64), np.empty(0, np.int64))
                n.append(len(items))
                a.append(at[0])
                b.append(at[1])
                bands.append(keys)
                sketches.append(sketch)
            lists = lambda parts: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32), np.concatenate([np.empty(0, np.int64), *parts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists(bands), lists(sketches)],
                                             names=["id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL").mapInArrow(work, schema)


def shingle_sets(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """id, items: the full set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, PORTION_BYTES)):
            sets = [shingles(t, words).view(np.int64) for t in texts_of(batch.column(1))]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *sets]))], names=["id", "items"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(work, "id bigint, items array<bigint>")


class Links:
    """Confirms candidate pairs of one document table."""

    def __init__(self, docs: DataFrame, marks: DataFrame, words: int, percent: int, key: str, text: str):
        self.docs, self.marks, self.words, self.percent, self.key, self.text = docs, marks, words, percent, key, text

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and sketches allow the threshold."""
        m = self.marks.select("id", "n_shingles", "sketch")
        both = pairs.join(m.toDF("a", "n_a", "sketch_a"), "a").join(m.toDF("b", "n_b", "sketch_b"), "b")
        ones = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent
        return both.filter(sizes).filter(ones <= MOST_ONES).select("a", "b")

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """id, items: the full sets of some ids."""
        texts = self.docs.select(F.col(self.key).cast("bigint").alias("id"), F.col(self.text).alias("text"))
        wanted = texts.join(broadcast_if_small(ids), "id", "left_semi")
        return materialise(shingle_sets(wanted, self.words, "id", "text"), f"{name}-sets").dropDuplicates(["id"])

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) whose full sets reach the threshold."""
        pairs = materialise(self.alike(pairs), f"{name}-alike")
        ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{name}-ids")
        sets = self.sets(ids, name)
        both = pairs.join(sets.toDF("a", "items_a"), "a").join(sets.toDF("b", "items_b"), "b")
        shared = F.size(F.array_intersect("items_a", "items_b")).cast("bigint")
        sized = both.select("a", "b", shared.alias("shared"), (F.size("items_a") + F.size("items_b")).cast("bigint").alias("total"))
        return materialise(sized.filter(f"100 * shared >= {self.percent} * (total - shared)").select("a", "b").distinct(), f"{name}-links")


@dataclass
class SetFiles:
    """Sets, bands and sketches of some ids as sorted arrays in the shared folder, mapped by workers."""

    folder: str
    shards: int

    @staticmethod
    def write(rows: DataFrame, shards: int) -> SetFiles:
        """`rows`: id, bands, sketch, items."""
        held = SetFiles(new_work_path(rows.sparkSession, "near-set-files"), shards)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = list(batches)
            table = pa.Table.from_batches(parts) if parts else None
            done = np.unique(table.column("shard").to_numpy()) if table is not None else []
            for s in done:
                part = table.filter(pc.equal(table.column("shard"), int(s))).sort_by("id")
                column = part.column("items").combine_chunks()
                ends = column.offsets.to_numpy().astype(np.int64)
                write_array(f"{held.folder}/id-{s}", part.column("id").to_numpy())
                write_array(f"{held.folder}/ends-{s}", ends - ends[0])
                write_array(f"{held.folder}/items-{s}", column.flatten().to_numpy(zero_copy_only=False))
                for name in ("bands", "sketch"):
                    write_array(f"{held.folder}/{name}-{s}", part.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(np.asarray(done, np.int32))})

        placed = rows.select(F.pmod("id", F.lit(shards)).cast("int").alias("shard"), "id", "bands", "sketch", "items").repartition(shards, "shard")
        materialise(placed.mapInArrow(work, "shard int"), "near-set-shards").count()
        return held

    def read(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Bands, sketches and sets of known ids."""
        bands, sketch = np.empty((len(ids), BANDS), np.int64), np.empty((len(ids), SKETCH_BITS // 64), np.uint64)
        sets: list = [None] * len(ids)
        shard = ids % self.shards
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            at = np.searchsorted(map_array(f"{self.folder}/id-{s}", np.int64), ids[mine])
            bands[mine] = map_array(f"{self.folder}/bands-{s}", np.int64).reshape(-1, BANDS)[at]
            sketch[mine] = map_array(f"{self.folder}/sketch-{s}", np.uint64).reshape(-1, SKETCH_BITS // 64)[at]
            ends, items = map_array(f"{self.folder}/ends-{s}", np.int64), map_array(f"{self.folder}/items-{s}", np.uint64)
            for m, k in zip(mine, at, strict=True):
                sets[m] = items[ends[k] : ends[k + 1]]
        return bands, sketch, sets


def cross_pairs(buckets: DataFrame, marks: DataFrame, links: Links) -> tuple[DataFrame, DataFrame]:
    """What of one bucket lies in different components: candidate pairs (a, b) of small buckets, confirmed links of
    large ones. `buckets`: key, id, component."""
    mixed = buckets.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).filter("lo <> hi")
    mixed = materialise(mixed.select("key", "m"), "near-mixed")
    rows = materialise(buckets.select("key", "id", "component").join(mixed, "key"), "near-mixed-rows")
    small = rows.filter(F.col("m") <= SMALL_BUCKET)
    listed = small.select("key", F.col("id").alias("a"), F.col("component").alias("ca")).join(small.select("key", F.col("id").alias("b"), F.col("component").alias("cb")), "key").filter("a < b AND ca <> cb").select("a", "b").distinct()
    large = rows.filter(F.col("m") > SMALL_BUCKET)
    if large.limit(1).count() == 0:
        return listed, listed.limit(0)
    ids = materialise(large.select("id").distinct(), "near-large-ids")
    held = SetFiles.write(marks.select("id", "bands", "sketch").join(broadcast_if_small(ids), "id", "left_semi").join(links.sets(ids, "near-large"), "id"), max(8, -(-ids.count() // 2_048)))
    placed = large.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sides = placed.select("key", "id", "component", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # A block pair (i, j), i <= j, is one group. Its rows are ids only; sets, bands and sketches are mapped.
    grouped = sides.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "component")
    percent = links.percent

    def compare(table: pa.Table) -> pa.Table:
        """Links that join components, each pair looked at in its first common bucket only."""
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        mine, ids, comp = (table.column(c).to_numpy() for c in ("mine", "id", "component"))
        bands, sketch, sets = held.read(ids)
        band = int((bands[0] == key).argmax())
        root = {int(c): int(c) for c in comp}

        def head(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        found: list[tuple[int, int]] = []
        for at, x in enumerate(left):
            others = right[at + 1 :] if i == j else right
            others = others[comp[others] != comp[x]]
            others = others[np.bitwise_count(sketch[others] ^ sketch[x]).sum(axis=1) <= MOST_ONES]
            others = others[~(bands[others, :band] == bands[x, :band]).any(axis=1)]
            own = sets[x]
            for y in others:
                a, b = head(int(comp[x])), head(int(comp[y]))
                if a == b:
                    continue
                its = sets[y]
                if 100 * min(len(own), len(its)) < percent * max(len(own), len(its)):
                    continue
                shared = int((own[np.minimum(np.searchsorted(own, its), len(own) - 1)] == its).sum())
                if 100 * shared >= percent * (len(own) + len(its) - shared):
                    root[max(a, b)] = min(a, b)
                    found.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return listed, grouped.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, class_id (smallest id with the same set), component_id, kept."""
    every = materialise(features(docs, words, key, text), "near-features")
    filled = every.filter("n_shingles > 0")
    classes = materialise(filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("class_id")), "near-classes")
    members = materialise(filled.select("id", "set_a", "set_b", "n_shingles").join(classes, ["set_a", "set_b", "n_shingles"]).select("id", "n_shingles", "class_id"), "near-members")
    heads = classes.select(F.col("class_id").alias("id"))
    marks = materialise(filled.select("id", "n_shingles", "bands", "sketch").join(heads, "id", "left_semi"), "near-heads")

    rows = marks.select("id", F.explode("bands").alias("key"))
    shared = materialise(rows.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub <> last").select("key", "hub"), "near-shared")
    buckets = materialise(rows.join(shared, "key").select("key", "id", "hub"), "near-buckets")
    links = Links(docs, marks, words, percent, key, text)
    stars = links.confirm(buckets.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "near-stars")
    first = components(stars, "near-first")

    labelled = buckets.select("key", "id").join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    listed, joined = cross_pairs(materialise(labelled, "near-labelled"), marks, links)
    more = materialise(links.confirm(materialise(listed, "near-rest"), "near-more").union(joined), "near-joined")
    final = components(stars.union(more), "near-final") if more.limit(1).count() else first

    placed = members.join(final.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select(F.col("id").alias(key), "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    bare = every.filter("n_shingles = 0").select(F.col("id").alias(key), "n_shingles", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    whole = placed.unionByName(bare)
    return whole.withColumn("kept", F.col(key) == F.col("component_id"))
