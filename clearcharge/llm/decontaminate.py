"""Benchmark passages in documents, found by winnowing.

Of every six neighbouring five-word hashes the smallest is kept, on both sides; so any shared run of ten words keeps
at least one hash in common. Kept hashes of documents and of benchmark items are joined; each hit is extended word by
word to both sides, at most five words, and counts if the shared run reaches ten words. Every ten-word window that a
document shares with an item lies in such a run, and each such run is made of shared windows only, so the words found
are exact. Items of fewer than ten words are one window each: their whole word sequence is looked up.

Documents are sifted where they are read, with a bitmap of the benchmark's hashes whose size is fixed (2^24 bits at
most, whatever the benchmark holds), so only near-certain hits are shuffled.

Cases: null and wordless texts have no words and no hits; wordless items never occur; items with equal words all
count; overlapping hits count each word once; repeated documents each get a row; the item list of a document without
hits is empty, its digest that of the empty string; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearcharge.llm.common import gram_hashes, materialise, scramble, texts_of, word_hashes
from clearcharge.session import broadcast_if_small

GRAM, SPAN = 5, 10
SIFT_BITS = 24
# What separates words: all of ASCII but digits and letters.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: bytes) -> np.ndarray:
    return word_hashes(text.lower().translate(_LETTERS).split())


def kept_grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that winnowing keeps; the rightmost of equal minima in a window."""
    grams = gram_hashes(words, GRAM)
    window = SPAN - GRAM + 1
    if len(grams) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    at = np.unique(window - 1 - views[:, ::-1].argmin(axis=1) + np.arange(len(views)))
    return at, grams[at]


def prints(words: np.ndarray, at: np.ndarray, grams: np.ndarray, size: int) -> list[dict]:
    """Fingerprints with the words around them: up to five to each side for grams, none for whole short items."""
    around = SPAN - GRAM if size == GRAM and grams is not None else 0
    raw = words.view(np.int64)
    return [{"pos": int(p), "size": size, "hash": int(h), "before": raw[max(0, p - around) : p][::-1].tolist(), "own": raw[p : p + size].tolist(), "after": raw[p + size : p + size + around].tolist()}
            for p, h in zip(at, grams.view(np.int64), strict=True)]


PRINT = "pos int, size int, whole boolean, hash bigint, before array<bigint>, own array<bigint>, after array<bigint>"


def _table(rows: list[dict], key: str) -> pa.Table:
    schema = pa.schema([(key, pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("whole", pa.bool_()), ("hash", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("before", "own", "after")]])
    return pa.Table.from_pylist(rows, schema)


def short_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of whole runs of n words, apart from those of grams."""
    return scramble(gram_hashes(words, n) ^ np.uint64(0xA5A5 + n))


def item_prints(items: DataFrame) -> DataFrame:
    """item, and each fingerprint of its words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words = words_of(text)
                if len(words) >= SPAN:
                    found = [x | {"whole": False} for x in prints(words, *kept_grams(words), GRAM)]
                elif len(words):
                    h, raw = int(short_hash(words, len(words)).view(np.int64)[0]), words.view(np.int64).tolist()
                    found = [{"pos": 0, "size": len(words), "whole": True, "hash": h, "before": [], "own": raw, "after": []}]
                else:
                    found = []
                rows += [{"item": item} | x for x in found]
            yield from _table(rows, "item").to_batches()

    return items.mapInArrow(work, "item bigint, " + PRINT)


def sift(hashes: DataFrame) -> np.ndarray:
    """Bitmap of hashes by their low bits: at most 2^SIFT_BITS bits, in pieces made by the executors."""
    low = F.col("hash").bitwiseAND((1 << SIFT_BITS) - 1)
    pieces = hashes.select(low.alias("low")).groupBy(F.expr("low div 32768").alias("piece")).agg(F.expr("bitmap_construct_agg(low % 32768)").alias("bits"))
    out = np.zeros(1 << SIFT_BITS, bool)
    for row in pieces.collect():  # 512 pieces of 4 KB at most
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        out[row["piece"] * 32768 : row["piece"] * 32768 + len(bits)] = bits
    return np.packbits(out, bitorder="little")


def document_prints(docs: DataFrame, bitmap: np.ndarray, shorts: list[int]) -> DataFrame:
    """Of each document: one row that carries its number of words (pos null), and the fingerprints the bitmap lets through."""
    mask = np.uint64((1 << SIFT_BITS) - 1)

    def through(hashes: np.ndarray) -> np.ndarray:
        at = (hashes & mask).astype(np.int64)
        return np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words = words_of(text)
                rows.append({"doc": doc, "size": len(words)})
                at, grams = kept_grams(words)
                hit = through(grams)
                rows += [{"doc": doc, "whole": False} | x for x in prints(words, at[hit], grams[hit], GRAM)]
                for n in shorts:
                    hashes = short_hash(words, n)
                    rows += [{"doc": doc, "pos": int(p), "size": n, "whole": True, "hash": int(hashes[p].view(np.int64)), "before": [], "own": words[p : p + n].view(np.int64).tolist(), "after": []} for p in through(hashes)]
            yield from _table(rows, "doc").to_batches()

    return docs.mapInArrow(work, "doc bigint, " + PRINT)


def _shared_run(a: str, b: str):
    """Length of the common beginning of two arrays."""
    same = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: documents (doc, n_words), hit word ranges (doc, start, stop), items found (doc, item)."""
    from clearcharge.llm.words import same_words

    plain = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(text).alias("text"))
    groups = materialise(same_words(plain), "bench-groups")  # item, head: the smallest item of equal words
    heads = plain.join(groups.filter("item = head").select("item"), "item", "left_semi").dropDuplicates(["item"])
    bench = materialise(item_prints(heads), "bench-prints")
    shorts = sorted(r["size"] for r in bench.filter("whole").select("size").distinct().collect())  # lengths 1 to 9
    mine = materialise(document_prints(docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")), sift(bench), shorts), "document-prints")

    right = broadcast_if_small(bench.select("item", F.col("size"), F.col("whole"), "hash", F.col("before").alias("b2"), F.col("own").alias("o2"), F.col("after").alias("a2")), 50_000)
    met = mine.filter("pos IS NOT NULL").join(right, ["hash", "size", "whole"]).filter("own = o2")
    spans = met.select("doc", "item", (F.col("pos") - _shared_run("before", "b2")).alias("start"), (F.col("pos") + F.col("size") + _shared_run("after", "a2")).alias("stop"), "whole")
    spans = materialise(spans.filter(F.col("whole") | (F.col("stop") - F.col("start") >= SPAN)).select("doc", "item", "start", "stop").distinct(), "bench-spans")
    found = spans.select("doc", F.col("item").alias("head")).distinct().join(groups, "head").select("doc", "item")
    return mine.filter("pos IS NULL").select("doc", F.col("size").cast("bigint").alias("n_words")), spans.select("doc", "start", "stop").distinct(), found


def covered(ranges: DataFrame) -> DataFrame:
    """doc, n_hit: words in the union of each document's ranges."""
    earlier = Window.partitionBy("doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(earlier), F.lit(0)))
    return ranges.select("doc", F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy("doc").agg(F.sum("fresh").cast("bigint").alias("n_hit"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated."""
    sizes, ranges, found = contamination(docs, items, key, item_key, text)
    listed = found.distinct().groupBy("doc").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ",").alias("items"))
    out = sizes.join(covered(ranges), "doc", "left").join(listed, "doc", "left")
    return out.select(F.col("doc").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                      F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
