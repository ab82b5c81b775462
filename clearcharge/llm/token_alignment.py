"""Two tokenizers' tokens of one text, brought together by the bytes they cover.

Both encodings tile the bytes of a blank and the text. Per batch, `pandas.merge_asof`, keyed by document (positions run
on over a batch's texts, so each belongs to one), gives each token start the other side's covering token; the union of
both directions is every overlapping pair. Pairs that end at
the same byte close a group; the tokens of A and B in one group are linked.

The counts of id pairs over all documents come from one shuffle: a block of texts (about 8 MB) lists its different
pairs with the number of its documents that hold them, documents point into their block's list, and the counts go back
to the blocks. So what is shuffled is a block's vocabulary of pairs, not its tokens.

Cases: null and empty texts, and texts whose tokens on either side do not give back their bytes (such as texts that
hold U+2581, or bytes that are no UTF-8), have no tokens: zeros and ''. A text of any length is aligned whole; a group
of very many tokens is counted by its different ids, not pair by pair. Repeated rows are documents of their own, rows
without an id too. Extra columns are dropped, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcharge.llm.common import materialise, texts_of
from clearcharge.llm.kneser_ney import portions
from clearcharge.llm.token_counts import CUT, SETTLED, byte_letters

BLOCK_BYTES, PORTION_BYTES = 8_000_000, 700_000
PAIRS_AT_ONCE = 4_000_000
# The quick encoder of the same vocabulary walks a run of blanks once for each of its characters.
LONG_BLANKS = regex.compile(r"\s{20000}")


class Side:
    """One tokenizer: the bytes of each id, and the ids of texts that stand after a blank."""

    pieces: list[bytes]

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """None where the tokens do not give the bytes back."""
        raise NotImplementedError

    def whole(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.pieces.__getitem__, ids)) == text.encode()

    def ready(self) -> Side:
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.names = {end: np.array([f"{i}{end}" for i in range(len(self.pieces))], object) for end in ",|;"}
        return self


class ByteSide(Side):
    """A byte-level vocabulary. Ranks of the same vocabulary, if given, encode texts whose characters all Unicode
    versions cut alike; they are several times as quick and give the same ids."""

    def __init__(self, json_file: str, rank_file: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_file)
        self.slow.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.slow.get_vocab()
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.pieces[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.quick = None
        if rank_file:
            import tiktoken

            with open(rank_file, "rb") as f:
                ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=CUT.pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        out = []
        for text in texts:
            quick = self.quick and SETTLED.fullmatch(text) and not LONG_BLANKS.search(text)
            ids = self.quick.encode_ordinary(text) if quick else self.slow.encode(text, add_special_tokens=False).ids
            out.append(np.array(ids, np.int32) if self.whole(ids, text) else None)
        return out


class PieceSide(Side):
    """A piece vocabulary with byte fallback; the model puts the blank before a text itself."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_file)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(n[1:-1], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [np.array(ids, np.int32) if self.whole(ids, t) else None for ids, t in zip(found, texts, strict=True)]


@lru_cache(maxsize=2)
def sides(json_file: str, rank_file: str | None, model_file: str) -> tuple[Side, Side]:
    """Built once in each Python worker."""
    return ByteSide(json_file, rank_file).ready(), PieceSide(model_file).ready()


NONE = np.empty(0, np.int32)


def encoded(a: Side, b: Side, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of each text on both sides; none where the text is empty or a side does not give its bytes back."""
    plain = [" " + t.decode("utf-8", "replace") for t in texts]
    whole = [t != b"" and (p.isascii() or p[1:].encode() == t) for p, t in zip(plain, texts, strict=True)]
    at = [k for k, good in enumerate(whole) if good]
    x, y = [NONE] * len(texts), [NONE] * len(texts)
    for k, i, j in zip(at, a.ids([plain[k] for k in at]), b.ids([plain[k] for k in at]), strict=True):
        if i is not None and j is not None:
            x[k], y[k] = i, j
    return x, y


@dataclass
class Tokens:
    """Tokens of a batch, text after text: ids, where each starts and ends, and how many each text has. Positions run
    on over the texts, so a position stands for its document too."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(side: Side, ids: list[np.ndarray]) -> Tokens:
        flat = np.concatenate([NONE, *ids])
        ends = np.cumsum(side.sizes[flat])
        return Tokens(flat, ends - side.sizes[flat], ends, np.array([len(x) for x in ids], np.int64))


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every pair of tokens that share a byte: the covering token of each start, in both directions; pairs
    with equal starts are found twice and kept once."""
    of_a = pd.DataFrame({"start": a.starts, "row_a": np.arange(len(a.ids))})
    of_b = pd.DataFrame({"start": b.starts, "row_b": np.arange(len(b.ids))})
    there, back = pd.merge_asof(of_a, of_b, on="start"), pd.merge_asof(of_b, of_a, on="start")
    other = a.starts[back["row_a"].to_numpy()] < b.starts
    return np.append(there["row_a"], back["row_a"][other]), np.append(there["row_b"], back["row_b"][other])


@dataclass
class Groups:
    """Group of each token, and for each group its document and where its tokens begin on both sides (one more at the
    end)."""

    of_a: np.ndarray
    of_b: np.ndarray
    doc: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray


def groups_of(a: Tokens, b: Tokens) -> Groups:
    row_a, row_b = overlaps(a, b)
    closing = a.ends[row_a] == b.ends[row_b]
    last_a, last_b = np.sort(row_a[closing]), np.sort(row_b[closing])

    def group(last: np.ndarray, n: int) -> np.ndarray:
        marks = np.zeros(n, np.int64)
        marks[last] = 1
        return np.cumsum(marks) - marks

    doc = np.repeat(np.arange(len(a.counts)), a.counts)[last_a]
    return Groups(group(last_a, len(a.ids)), group(last_b, len(b.ids)), doc, np.append(0, last_a + 1), np.append(0, last_b + 1))


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their times added up."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(times, at) if len(at) else times


def linked(g: Groups, a: np.ndarray, b: np.ndarray, names_a: int, names_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, code (a's id * names_b + b's id) and times of the linked id pairs of each document, in order."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    n_a, n_b = np.diff(g.first_a), np.diff(g.first_b)
    links = n_a * n_b
    span = names_a * names_b
    parts = []
    large = links > PAIRS_AT_ONCE
    for k in np.flatnonzero(large):  # by different ids, some of A's at a time
        ids_a, times_a = np.unique(a[g.first_a[k] : g.first_a[k + 1]], return_counts=True)
        ids_b, times_b = np.unique(b[g.first_b[k] : g.first_b[k + 1]], return_counts=True)
        step = max(PAIRS_AT_ONCE // len(ids_b), 1)
        for at in range(0, len(ids_a), step):
            x, tx = ids_a[at : at + step], times_a[at : at + step]
            parts.append((np.add.outer(x * names_b, ids_b).ravel() + g.doc[k] * span, np.multiply.outer(tx, times_b).ravel()))
    small = np.flatnonzero(~large)
    total = np.cumsum(links[small])
    for part in np.split(small, np.flatnonzero(np.diff(total // PAIRS_AT_ONCE)) + 1) if len(small) else []:
        each = np.repeat(part, links[part])
        local = np.arange(len(each)) - np.repeat(np.cumsum(links[part]) - links[part], links[part])
        x = a[g.first_a[each] + local // n_b[each]]
        y = b[g.first_b[each] + local % n_b[each]]
        keys = (g.doc[each] * names_a + x) * names_b + y
        parts.append(_counted(keys, np.ones(len(keys), np.int64)))
    keys, times = parts[0] if len(parts) == 1 else _counted(np.concatenate([np.empty(0, np.int64), *[k for k, _ in parts]]), np.concatenate([np.empty(0, np.int64), *[t for _, t in parts]]))
    return keys // span, keys % span, times


def group_texts(g: Groups, a: Tokens, b: Tokens, side_a: Side, side_b: Side) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each document."""
    parts = np.empty(len(a.ids) + len(b.ids), object)
    row_a, row_b = np.arange(len(a.ids)), np.arange(len(b.ids))
    closes_a, closes_b = g.first_a[g.of_a + 1] == row_a + 1, g.first_b[g.of_b + 1] == row_b + 1
    parts[row_a + g.first_b[g.of_a]] = np.where(closes_a, side_a.names["|"][a.ids], side_a.names[","][a.ids])
    parts[row_b + g.first_a[g.of_b + 1]] = np.where(closes_b, side_b.names[";"][b.ids], side_b.names[","][b.ids])
    ends = np.cumsum(a.counts + b.counts)
    return ["".join(parts[x:y].tolist())[:-1] for x, y in zip(np.append(0, ends[:-1]), ends, strict=True)]


@dataclass
class Alignment:
    """documents: a row per document with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and `groups`
    if kept). pairs: a, b, n (documents that hold the pair linked), best (the highest n of its a)."""

    documents: DataFrame
    pairs: DataFrame


DOCUMENT = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def aligned(docs: DataFrame, json_file: str, model_file: str, rank_file: str | None = None, key: str = "doc_id", text: str = "text", keep_groups: bool = False) -> Alignment:
    """Aligns a byte-level vocabulary (A) with a piece vocabulary (B) over every text."""
    kept = ", groups string" if keep_groups else ""
    schema = f"block bigint, whole boolean, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places array<int>, times array<bigint>, codes array<bigint>{kept}"

    def table(columns: dict[str, list]) -> pa.RecordBatch:
        types = {"block": pa.int64(), "whole": pa.bool_(), "id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "places": pa.list_(pa.int32()), "times": pa.list_(pa.int64()), "codes": pa.list_(pa.int64())}
        if keep_groups:
            types["groups"] = pa.string()
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in types.items()], names=list(types))

    def of_portion(few: pa.RecordBatch, side_a: Side, side_b: Side) -> tuple[dict[str, list], np.ndarray]:
        """Columns of a portion's documents, and the codes that its places point into for now: its own pairs."""
        ids_a, ids_b = encoded(side_a, side_b, texts_of(few.column(1)))
        a, b = Tokens.of(side_a, ids_a), Tokens.of(side_b, ids_b)
        g = groups_of(a, b)
        texts = group_texts(g, a, b, side_a, side_b)
        doc, code, times = linked(g, a.ids, b.ids, len(side_a.pieces), len(side_b.pieces))
        cuts = np.searchsorted(doc, np.arange(1, few.num_rows))
        links = np.bincount(g.doc, np.diff(g.first_a) * np.diff(g.first_b), few.num_rows).astype(np.int64)
        columns = {
            "id": few.column(0).to_pylist(),
            "n_a": a.counts.tolist(),
            "n_b": b.counts.tolist(),
            "n_groups": np.bincount(g.doc, minlength=few.num_rows).tolist(),
            "n_links": links.tolist(),
            "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts],
            "times": np.split(times, cuts),
            "lengths": np.diff(np.concatenate([[0], cuts, [len(code)]])).tolist(),
        }
        if keep_groups:
            columns["groups"] = texts
        return columns, code

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(json_file, rank_file, model_file)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for many in portions(batch, BLOCK_BYTES):
                parts = [of_portion(few, side_a, side_b) for few in portions(many, PORTION_BYTES)]
                codes, places, holders = np.unique(np.concatenate([c for _, c in parts]), return_inverse=True, return_counts=True)
                rows = {c: [x for columns, _ in parts for x in columns[c]] for c in parts[0][0]}
                n = len(rows["id"])
                places = np.split(places.astype(np.int32), np.cumsum(rows.pop("lengths"))[:-1])
                rows = {c: [*values, None] for c, values in rows.items()}
                rows["times"][-1] = holders
                yield table(rows | {"block": [block] * (n + 1), "whole": [False] * n + [True], "places": [*places, None], "codes": [None] * n + [codes]})
                block += 1

    read = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    rows = materialise(read.mapInArrow(work, schema), "alignment")
    listed = rows.filter("whole").select(F.col("block").alias("of_block"), F.posexplode(F.arrays_zip("codes", "times")).alias("place", "x")).select("of_block", "place", F.col("x.codes").alias("code"), F.col("x.times").alias("n"))
    names_b = len(sides(json_file, rank_file, model_file)[1].pieces)
    totals = materialise(listed.groupBy("code").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"code div {names_b}")), "alignment-pairs")
    highest = totals.groupBy("a").agg(F.max("n").alias("highest"))
    pairs = totals.join(highest, "a").select("code", "a", F.expr(f"code % {names_b}").alias("b"), "n", (F.col("n") == F.col("highest")).alias("best"))
    found = listed.drop("n").join(pairs.select("code", "n", "best"), "code").select("of_block", "place", "n", "best")

    def looked_up(documents: pa.Table, counts: pa.Table) -> pa.Table:
        place = counts.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place] = counts.column("n").to_numpy()
        best[place] = counts.column("best").to_numpy()
        at, times = documents.column("places").combine_chunks(), documents.column("times").combine_chunks()
        ends = np.append(0, np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False)))
        at, times = at.flatten().to_numpy(), times.flatten().to_numpy()

        def summed(values: np.ndarray) -> pa.Array:
            return pa.array(np.diff(np.append(0, np.cumsum(values * times))[ends]), pa.int64())

        columns = {c: documents.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")}
        columns |= {"n_best": summed(best[at]), "count_sum": summed(n[at]), "groups_sha256": documents.column("groups_sha256")}
        if keep_groups:
            columns["groups"] = documents.column("groups")
        return pa.table(columns)

    documents = rows.filter("NOT whole").drop("whole", "codes").groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(looked_up, DOCUMENT + kept)
    return Alignment(documents.withColumnRenamed("id", key), pairs.drop("code"))
