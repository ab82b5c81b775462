"""Token counts at every prefix of a text, by prefix dynamic programming.

A byte-pair encoding of a prefix ends in exactly one piece `t` such that (last piece of the prefix without `t`, `t`)
stays two pieces when encoded together. So one pass over a text, looking only at the pieces that end at each byte,
gives the count of tokens of every prefix, as the tokenizer would count that prefix alone.

A text is first cut the way the tokenizer cuts it (its cut pattern, special strings first). Where the cut of a prefix
differs from the cut of the whole text (inside a contraction, at the end of a run of white space, inside a special
string), the count is put right at that place, so every prefix is exact.

Cases: null and empty texts have 0 tokens and an empty table; long texts take time in proportion to their length;
repeated rows are counted each; extra columns are dropped; the text column may have any name.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CONTRACTIONS = ("'re", "'ve", "'ll")
# Blocks whose letters, digits and blanks are the same in every Unicode version in use. Texts with other characters
# are cut by the tokenizer itself, which is slower.
SETTLED = regex.compile("[\x00-ԯ‐-‧‰-⁞€™ぁ-ゖァ-ヺ一-龥가-힣]*+")
CACHED_WORDS, CACHED_CHARS = 400_000, 48


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordSteps(dict):
    """Changes of the count within each piece of text met so far; bounded."""

    def __init__(self, counts):
        super().__init__()
        self.counts = counts

    def __missing__(self, word: str) -> bytes:
        c = self.counts(word)
        steps = array("h", [b - a for a, b in zip(c, c[1:])]).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = steps
        return steps


class PrefixCounter:
    """Counts for one byte-level vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda t: bytes(letters[c] for c in t).decode("latin-1")  # noqa: E731 - one character per byte
        self.ranks = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[to_bytes(a), to_bytes(b)] = k
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special_cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.path, self.library = path, None
        self.pieces = ahocorasick.Automaton()
        skip = set(self.specials)
        for token in spec["model"]["vocab"]:
            if token not in skip:
                text = to_bytes(token)
                if self.encode(text) == [text]:  # a piece that its own merges do not reach is never produced
                    self.pieces.add_word(text, (len(text), text))
        self.pieces.make_automaton()
        self.joined: dict[tuple[str, str], bool] = {}
        self.words = WordSteps(self.counts)

    def encode(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.joined.get(pair)
        if known is None:
            if len(self.joined) >= 500_000:
                self.joined.clear()
            known = self.joined[pair] = self.encode(left + right) == [left, right]
        return known

    def counts(self, word: str) -> list[int]:
        """Tokens of every prefix of one cut-out piece of text, by code point."""
        data = word.encode("utf-8").decode("latin-1")
        n = len(data)
        count, last, done = [0] * (n + 1), [""] * (n + 1), 0
        stays = self.stays
        for at, (length, piece) in self.pieces.iter(data):
            end = at + 1
            if end == done:
                continue
            start = end - length
            if start == 0 or stays(last[start], piece):
                count[end], last[end], done = count[start] + 1, piece, end
        if len(data) != len(word):  # keep the bytes that end a character
            ends = [i + 1 for i in range(n) if i + 1 == n or not "\x80" <= data[i + 1] < "\xc0"]
            count = [0, *[count[i] for i in ends]]
        if word in CONTRACTIONS:
            count[2] = 2
        return count

    def cut(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return CUT.findall(text)
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def plain_steps(self, text: str) -> np.ndarray:
        """Change of the count at each character of a text without special strings."""
        out = np.frombuffer(b"".join(map(self.words.__getitem__, self.cut(text))), "<i2").astype(np.int32)
        if BLANKS.search(text):
            total = np.cumsum(out)
            for run in BLANKS.finditer(text):  # a prefix that ends in blanks keeps them together
                a, b = run.span()
                if b < len(text):
                    want = (total[a - 1] if a else 0) + self.counts(text[a:b])[-1]
                    off = int(want - total[b - 1])
                    out[b - 1] += off
                    out[b] -= off
        return out

    def steps(self, text: str) -> np.ndarray:
        """Change of the count at each character; its running sum is the count of each prefix."""
        if self.special_cut is None or not self.special_cut.search(text):
            return self.plain_steps(text)
        out, at = [], 0
        for found in self.special_cut.finditer(text):
            a, b = found.span()
            part = self.plain_steps(text[at : b - 1])  # the special string is plain text until it is whole
            whole = int(self.plain_steps(text[at:a]).sum())
            out += [part, np.array([whole + 1 - int(part.sum())], np.int32)]
            at = b
        return np.concatenate([*out, self.plain_steps(text[at:])])


BLANKS = regex.compile(r"\s{2,}")
_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, built once in each Python worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_prefixes(docs: DataFrame, tokenizer: str, budget: int, key: str = "doc_id", text: str = "text", keep_table: bool = True) -> DataFrame:
    """key, n_bytes, n_tokens, budget_chars (characters of the longest prefix of at most `budget` tokens) and, if
    `keep_table`, steps: little-endian 16-bit changes of the count, one for each character."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("budget_chars", T.LongType())]
                          + ([T.StructField("steps", T.BinaryType())] if keep_table else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            sizes, totals, fits, tables = [], [], [], []
            for value in batch.column(1).to_pylist():
                value = value or ""
                steps = c.steps(value)
                running = np.cumsum(steps)
                within = np.flatnonzero(running <= budget)
                sizes.append(len(value.encode("utf-8")))
                totals.append(int(running[-1]) if len(running) else 0)
                fits.append(int(within[-1]) + 1 if len(within) else 0)
                if keep_table:
                    tables.append(steps.astype("<i2").tobytes())
            out = {key: batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(totals, pa.int64()), "budget_chars": pa.array(fits, pa.int64())}
            yield pa.RecordBatch.from_pydict(out | ({"steps": pa.array(tables, pa.binary())} if keep_table else {}))

    return docs.select(F.col(key).alias(key), F.col(text).alias("text")).mapInArrow(work, schema)


def prefix_counts(steps: bytes) -> np.ndarray:
    """Count of each prefix, from the empty one to the whole text."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, "<i2").astype(np.int64))])


def tokens_within(tables: DataFrame, chars: str, out: str = "tokens_at") -> DataFrame:
    """Adds the count of the first `chars` characters (a column's name) of each row with a table, without encoding again."""

    @F.pandas_udf(T.LongType())
    def look(steps, at):
        import pandas as pd

        return pd.Series([int(t[min(max(int(a), 0), len(t) - 1)]) for t, a in zip(map(prefix_counts, steps), at, strict=True)])

    return tables.withColumn(out, look(F.col("steps"), F.col(chars)))
