"""What several operators share: words, hashes, tables written once, files of the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearcharge.session import materialise, new_work_path

MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, bits without a pattern


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = scramble(out) + words[k : len(words) - n + 1 + k] * MIX
    return scramble(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def row_count(df: DataFrame) -> int:
    return df.count()


__all__ = ["DataFrame", "F", "MIX", "SparkSession", "T", "gram_hashes", "materialise", "new_work_path", "np", "pa", "read_table", "scramble", "signed", "texts_of", "union_all", "word_hashes"]
