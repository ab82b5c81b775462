"""SentencePiece encoding by sampled segmentations, without replacement, and decoding.

A text's segmentations into pieces form a lattice; a piece weighs (rank + 2)^-theta by its rank in the vocabulary, so
a segmentation has a probability. The k segmentations of the largest perturbed log-probability (log-probability plus
Gumbel noise) are k distinct samples without replacement. They are found by A* from the top: every subtree of
segmentations has as its bound its own perturbed value (the maximum over its leaves), drawn on demand, truncated at
its parent's. The best subtree is opened first, so each opening ends in the next sample. The value of the best subtree
left over is the threshold from which each sample's inclusion score follows: the probability of exceeding it.

No piece of such a vocabulary crosses a word's beginning, so lattices are built for words (white space and what
follows) and kept; a text is a chain of them. Noise comes from the seed and the row's key alone.

Decoding joins pieces and bytes and drops the blank put before the text; it gives back the exact text (a text's own
U+2581 comes back as a blank, as in the library).

Cases: null and empty texts have one segmentation without pieces, inclusion 1; a text with fewer than k segmentations
gives them all; characters outside the vocabulary become bytes; long texts take time in proportion to length; rows
with equal keys and texts give equal samples; extra columns are dropped.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearcharge.llm.common import MIX, scramble
from clearcharge.llm.kneser_ney import _runs as runs
from clearcharge.llm.kneser_ney import portions

BLANK = "▁"
WORDS = regex.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
# Nodes of lattices that are kept: about 100 bytes each with their words and edges. More of them save learning words again.
KEPT_NODES = 2_000_000
PREPARED, PREPARED_BYTES = 256, 600_000
TABLE_BITS = 18


class Pieces:
    """A vocabulary file's pieces, their weights, and the lattices of the words met so far."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path, self.weights, self.bytes, self.surface = path, {}, [0] * 256, [b""] * model.get_piece_size()
        ranks = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ranks[piece] = (i, len(ranks))
                self.surface[i] = piece.replace(BLANK, " ").encode()
        if any(BLANK in p.lstrip(BLANK) for p in ranks):
            raise ValueError("a piece of this vocabulary crosses the beginning of a word")
        self.weights = {p: (i, -theta * math.log(r + 2)) for p, (i, r) in ranks.items()}
        self.byte_weight = -theta * math.log(len(ranks) + 2)
        self._index_pieces()
        single = sorted((ord(p), i, w) for p, (i, w) in self.weights.items() if len(p) == 1)
        self.letters, self.letter_ids, self.letter_weights = (np.array(x) for x in zip(*single, strict=True))
        self.surface_sizes = np.array([len(b) for b in self.surface])
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.piece_ids, self.piece_weights = np.array([i for i, _ in self.weights.values()]), np.array([w for _, w in self.weights.values()])
        self.clear()

    def clear(self) -> None:
        self.starts: dict[str, int] = {}
        self.nodes = self.edges = 0
        # First edge of each node. A node's edges are neighbours, the likelier first; their keys add up to one.
        self.first = np.empty(1 << 16, np.int32)
        self.keys, self.to, self.logp, self.ids = np.empty(1 << 18), np.empty(1 << 18, np.int32), np.empty(1 << 18), np.empty(1 << 18, np.int32)

    def _index_pieces(self) -> None:
        """For each length from 2: the sorted hashes of its pieces with their numbers, and a table by the hash's top
        bits that says where a piece may end (2) and where a longer one may go on (1)."""
        self.by_length = []
        longest = max(map(len, self.weights))
        letters = np.zeros((len(self.weights), longest), np.uint64)
        sizes = np.array([len(p) for p in self.weights])
        for n, p in enumerate(self.weights):
            letters[n, : len(p)] = [ord(c) for c in p]
        hashes = letters[:, 0].copy()
        for length in range(2, longest + 1):
            hashes = hashes * MIX + letters[:, length - 1]
            whole, further = np.flatnonzero(sizes == length), np.flatnonzero(sizes > length)
            whole = whole[np.argsort(hashes[whole])]
            table = np.zeros(1 << TABLE_BITS, np.uint8)
            table[self._slot(hashes[whole])] |= 2
            table[self._slot(hashes[further])] |= 1
            self.by_length.append((hashes[whole], whole, table))

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * MIX) >> np.uint64(64 - TABLE_BITS)

    def _found(self, letters: np.ndarray, room: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, pieces) of all pieces of two characters and more that begin at a place and end in its
        word. Places stay as long as some piece begins like them."""
        found, wide = [], letters.astype(np.uint64)
        alive, hashes = np.arange(len(letters)), wide
        for length, (known, numbers, table) in enumerate(self.by_length, 2):
            kept = room[alive] >= length
            alive, hashes = alive[kept], hashes[kept]
            if not len(alive):
                break
            hashes = hashes * MIX + wide[alive + (length - 1)]
            said = table[self._slot(hashes)]
            maybe = np.flatnonzero(said & 2)
            if len(maybe) and len(known):
                at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
                hit = known[at] == hashes[maybe]
                found.append((length, alive[maybe[hit]], numbers[at[hit]]))
            going = np.flatnonzero(said & 1)
            alive, hashes = alive[going], hashes[going]
        return found

    def learn(self, words: list[str]) -> None:
        """Builds the lattices of new words, all at once: for each distance from a word's end, the log-sums of all
        its nodes."""
        sizes = np.array([len(w) for w in words])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        total = int(begin[-1])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        # Each single character: a piece, or else bytes. Longer pieces of a node stand after it.
        known = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        is_piece = self.letters[known] == letters
        width = 1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF)
        left_of = np.repeat(begin[1:], sizes) - np.arange(total)
        found = self._found(letters, left_of)
        edges = np.ones(total, np.int64)
        for _, places, _ in found:
            edges[places] += 1
        place = np.cumsum(edges) - edges
        node = np.repeat(np.arange(total), edges)
        to, weight, ids = node + 1, np.empty(len(node)), np.empty(len(node), np.int64)
        weight[place] = np.where(is_piece, self.letter_weights[known], self.byte_weight * width)
        ids[place] = np.where(is_piece, self.letter_ids[known], -1 - letters)
        for length, places, numbers in found:
            place[places] += 1
            at = place[places]
            to[at], weight[at], ids[at] = places + length, self.piece_weights[numbers], self.piece_ids[numbers]

        left = np.repeat(begin[1:], sizes) - np.arange(total)  # characters from a node to its word's end
        to = np.where(to - node == left[node], total, to)  # the end, of log-sum 0
        order = np.argsort(left[node].astype(np.uint16 if sizes.max() < 1 << 16 else np.int64), kind="stable")
        node, to, weight, ids = node[order], to[order], weight[order], ids[order]
        after, sums = np.zeros(total + 1), np.empty(len(node))
        for _, a, b in runs(left[node]):
            sums[a:b] = weight[a:b] + after[to[a:b]]
            heads = np.flatnonzero(np.concatenate([[True], np.diff(node[a:b]) != 0]))
            tops = np.maximum.reduceat(sums[a:b], heads)
            spread = np.exp(sums[a:b] - np.repeat(tops, np.diff(np.append(heads, b - a))))
            after[node[a:b][heads]] = tops + np.log(np.add.reduceat(spread, heads))
        logp = np.minimum(sums - after[node], 0.0)
        order = np.argsort(node + (1 - np.exp(logp)) * 0.999)
        node, to, logp, ids = node[order], to[order], logp[order], ids[order]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(node) != 0]))
        several = np.diff(np.append(heads, len(node)))
        logp[heads[several == 1]] = 0.0
        running = np.cumsum(np.exp(logp))
        keys = running - np.repeat(running[heads] - np.exp(logp[heads]), several)
        keys[heads + several - 1] = 2.0
        self._append("first", self.nodes, (heads + self.edges).astype(np.int32))
        for name, values in (("keys", keys), ("to", np.where(to == total, -1, to + self.nodes)), ("logp", logp), ("ids", ids)):
            self._append(name, self.edges, values)
        self.starts.update(zip(words, (begin[:-1] + self.nodes).tolist(), strict=True))
        self.nodes += total
        self.edges += len(node)

    def _append(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            held = np.concatenate([held, np.empty(max(len(held) // 4, len(values)), held.dtype)])
            setattr(self, name, held)
        held[at : at + len(values)] = values

    @staticmethod
    def words(text: str) -> list[str]:
        return WORDS.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def prepare(self, texts: list[str], kept_nodes: int = KEPT_NODES) -> list[np.ndarray]:
        """For each text the nodes at which its words' lattices begin. New words are learned; old ones are forgotten
        when there are too many, so nodes hold until the next call."""
        if self.nodes > kept_nodes:
            self.clear()
        words = [self.words(t) for t in texts]
        known, size, group = self.starts, 0, []
        for w in {w for ws in words for w in ws if w not in known}:
            group.append(w)
            size += len(w)
            if size > 100_000:
                self.learn(group)
                size, group = 0, []
        if group:
            self.learn(group)
        return [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in words]

    def flat(self, found: list[np.ndarray]) -> list[np.ndarray]:
        """Piece ids of each segmentation, with the bytes of characters outside the vocabulary."""
        every = np.concatenate([np.empty(0, np.int32), *found])
        odd = np.flatnonzero(every < 0)
        if not len(odd):
            return found
        chars, which = np.unique(-1 - every[odd], return_inverse=True)
        raw = [[self.bytes[b] for b in chr(int(c)).encode()] for c in chars]
        sizes = np.ones(len(every), np.int64)
        sizes[odd] = np.array([len(r) for r in raw])[which]
        out, ends = np.repeat(every, sizes), np.cumsum(sizes)
        for k, r in enumerate(raw):
            mine = ends[odd[which == k]] - len(r)
            for n, b in enumerate(r):
                out[mine + n] = b
        cuts = np.cumsum([len(f) for f in found])
        return np.split(out, np.append(0, ends)[cuts[:-1]])

    def decoded(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids, without the blank put before the text."""
        every = np.concatenate([np.empty(0, np.int64), *ids])
        sizes = self.surface_sizes[every]
        ends = np.cumsum(sizes)
        raw = self.surface_bytes[np.repeat(self.surface_starts[every] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = np.append(0, ends)[np.cumsum([0, *map(len, ids)])].tolist()
        return [raw[a:b][1:] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids) -> str:
        return self.decoded([np.asarray(ids, np.int64)])[0].decode("utf-8", "replace")


def _walk(pieces: Pieces, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A random path through each of the words that begin at `nodes`: edges in order, and the word of each. What is
    drawn at a step depends on the word's seed alone."""
    first, keys, to = pieces.first, pieces.keys, pieces.to
    words, edges, alive, at, step = [], [], np.arange(len(nodes)), nodes, 0
    while len(alive):
        drawn = (scramble(seeds[alive] + np.uint64(step * int(MIX) % 2**64)) >> np.uint64(11)) * 2.0**-53
        edge = first[at].astype(np.int64)
        open_ = np.flatnonzero(keys[edge] <= drawn)
        while len(open_):
            edge[open_] += 1
            open_ = open_[keys[edge[open_]] <= drawn[open_]]
        words.append(alive)
        edges.append(edge)
        at = to[edge]
        more = np.flatnonzero(at >= 0)
        alive, at, step = alive[more], at[more], step + 1
    if not edges:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.concatenate(words)
    order = np.argsort(word, kind="stable")
    return np.concatenate(edges)[order], word[order]


def _walks(pieces: Pieces, starts: list[np.ndarray], seeds: list[int]) -> list[np.ndarray]:
    """A path through each list of words."""
    sizes = [len(s) for s in starts]
    mixed = np.repeat(np.array(seeds, np.uint64), sizes) + np.concatenate([np.empty(0, np.uint64), *[np.arange(n, dtype=np.uint64) for n in sizes]]) * np.uint64(0xD6E8FEB86659FD93)
    edges, word = _walk(pieces, np.concatenate([np.empty(0, np.int64), *starts]), scramble(mixed))
    return np.split(edges, np.searchsorted(word, np.cumsum(sizes)[:-1])) if sizes else []


def _below(location: np.ndarray, bound: float, rng: np.random.Generator) -> np.ndarray:
    """Gumbel variables at the locations, given that they are at most `bound`."""
    noise = np.log(-np.log(rng.random(len(location)) + 1e-300))
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.logaddexp(location - bound, noise))


def _log_rest(logp: np.ndarray) -> np.ndarray:
    """log(1 - p)."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(logp))


class _Path:
    """A sampled segmentation and what branches off it: for each step the perturbed value of the alternatives there.
    Steps after the first HEAD are one subtree until it is opened; its value is that of the best of them."""

    HEAD = 64

    def __init__(self, edges: np.ndarray, logp: np.ndarray, value: float, opened_from: int, rng: np.random.Generator):
        self.edges, self.own, self.taken = edges, logp[edges], {}
        self.total = float(self.own.sum())
        head = min(len(edges), max(self.HEAD, opened_from + self.HEAD))
        self.before = np.concatenate([[0.0], np.cumsum(self.own[:head])])
        self.values = np.full(head, -np.inf)
        self.values[opened_from:] = _below(self.before[opened_from:-1] + _log_rest(self.own[opened_from:head]), value, rng)
        later = self.total - self.before[-1] if head < len(edges) else 0.0
        self.tail = float(_below(self.before[-1:] + _log_rest(np.array([later])), value, rng)[0]) if later < 0 else -math.inf

    def best(self) -> float:
        return max(float(self.values.max()) if len(self.values) else -math.inf, self.tail)

    def open_tail(self, rng: np.random.Generator) -> None:
        """The best of the later steps has the tail's value, the others lie below."""
        head = len(self.values)
        self.before = np.concatenate([[0.0], np.cumsum(self.own)])
        places = self.before[head:-1] + _log_rest(self.own[head:])
        winner = int((places + rng.gumbel(size=len(places))).argmax())
        fresh = _below(places, self.tail, rng)
        fresh[winner] = self.tail
        self.values, self.tail = np.concatenate([self.values, fresh]), -math.inf


class _Search:
    """Samples of one text."""

    def __init__(self, pieces: Pieces, nodes: np.ndarray, seed: int):
        self.pieces, self.nodes, self.seed = pieces, nodes, seed
        self.rng = np.random.Generator(np.random.Philox(key=seed))
        self.paths: list[_Path] = []
        self.heap: list[tuple[float, int]] = []
        self.out: list[dict] = []

    def add(self, edges: np.ndarray, value: float, opened_from: int) -> None:
        path = _Path(edges, self.pieces.logp, value, opened_from, self.rng)
        self.paths.append(path)
        self.out.append({"log_prob": path.total, "perturbed": value, "ids": self.pieces.ids[edges]})
        self.push(len(self.paths) - 1)

    def push(self, p: int) -> None:
        if self.paths[p].best() > -math.inf:
            heapq.heappush(self.heap, (-self.paths[p].best(), p))

    def branch(self) -> tuple[np.ndarray, float, int, np.ndarray] | None:
        """Opens the best subtree left: the steps up to its first own one, its value, the step after that, and the
        nodes from which the path goes on."""
        if not self.heap:
            return None
        value, p = heapq.heappop(self.heap)
        value, path = -value, self.paths[p]
        keys, to, logp = self.pieces.keys, self.pieces.to, self.pieces.logp
        if path.tail == value:
            path.open_tail(self.rng)
        at = int(path.values.argmax())
        edges = path.edges
        a = int(edges[at])  # the edges of its node: back to the first, on to the key that ends them
        while a > 0 and keys[a - 1] < 2.0:
            a -= 1
        b = int(edges[at]) + 1
        while keys[b - 1] < 2.0:
            b += 1
        taken = path.taken.setdefault(at, {int(edges[at])})
        left = np.array([e for e in range(a, b) if e not in taken])
        pick = int(left[(logp[left] + self.rng.gumbel(size=len(left))).argmax()])
        taken.add(pick)
        left = left[left != pick]
        rest = path.before[at] + math.log(np.exp(logp[left]).sum()) if len(left) else -math.inf
        path.values[at] = _below(np.array([rest]), value, self.rng)[0]
        self.push(p)
        # The same word goes on after the picked piece, then the later words anew.
        later = self.nodes[int((to[edges[:at]] < 0).sum()) + 1 :]
        go_on = [int(to[pick])] if to[pick] >= 0 else []
        return np.append(edges[:at], pick), value, at + 1, np.concatenate([np.array(go_on, np.int64), later])

    def finished(self) -> list[dict]:
        threshold = -self.heap[0][0] if self.heap else -math.inf
        for s in self.out:
            x = s["log_prob"] - threshold
            s["log_inclusion"] = 0.0 if x > 30 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))
        return self.out


def samples(pieces: Pieces, prepared: list[np.ndarray], k: int, seeds: list[int]) -> list[list[dict]]:
    """Of each prepared text up to k distinct segmentations, best perturbed value first: ids, log_prob, perturbed,
    log_inclusion. The texts' paths are walked together."""
    searches = [_Search(pieces, nodes, seed) for nodes, seed in zip(prepared, seeds, strict=True)]
    for s, edges in zip(searches, _walks(pieces, prepared, seeds), strict=True):
        s.add(edges, float(s.rng.gumbel()), 0)
    for turn in range(1, k):
        opened = [(s, b) for s in searches if (b := s.branch())]
        paths = _walks(pieces, [b[3] for _, b in opened], [(s.seed + turn * 0x9E3779B97F4A7C15) % 2**64 for s, _ in opened])
        for (s, (before, value, step, _)), more in zip(opened, paths, strict=True):
            s.add(np.concatenate([before, more]).astype(np.int64), value, step)
    every = [s.finished() for s in searches]
    found = [one for some in every for one in some]
    for one, ids in zip(found, pieces.flat([one["ids"] for one in found]), strict=True):
        one["ids"] = ids
    return every


_known: dict[tuple[str, float], Pieces] = {}


def pieces_of(path: str, theta: float) -> Pieces:
    """Built once in each Python worker."""
    if (path, theta) not in _known:
        _known[path, theta] = Pieces(path, theta)
    return _known[path, theta]


def segmentations(docs: DataFrame, model_file: str, k: int = 2, theta: float = 1.5, seed: int = 17, key: str = "doc_id", text: str = "text", keep_ids: bool = True,
                  kept_nodes: int = KEPT_NODES) -> DataFrame:
    """key, rank (from 1), n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, decoded (whether decoding gives the
    text back) and, if `keep_ids`, ids. `kept_nodes` trades a worker's memory for time; results do not depend on it."""
    schema = "id bigint, rank int, n_pieces bigint, log_prob double, perturbed double, log_inclusion double, ids_crc32 bigint, decoded boolean" + (", ids array<int>" if keep_ids else "")

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 9
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()), strict=False)]
        if keep_ids:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in columns[8]])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *columns[8]])))
        return pa.RecordBatch.from_arrays(arrays, names=["id", "rank", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "decoded", *(["ids"] if keep_ids else [])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_file, theta)
        for batch in batches:
            rows, size = [], 0
            for part in portions(batch, PREPARED_BYTES):
                for at in range(0, part.num_rows, PREPARED):
                    few = part.slice(at, PREPARED)
                    keys, values = few.column(0).to_pylist(), [v or "" for v in few.column(1).to_pylist()]
                    found = samples(pieces, pieces.prepare(values, kept_nodes), k, [xxhash.xxh3_64_intdigest(f"{seed}:{x}") for x in keys])
                    back = iter(pieces.decoded([s["ids"] for some in found for s in some]))
                    for row, value, some in zip(keys, values, found, strict=True):
                        whole = value.replace(BLANK, " ").encode()
                        for rank, s in enumerate(some, 1):
                            ids = s["ids"]
                            rows.append((row, rank, len(ids), s["log_prob"], s["perturbed"], s["log_inclusion"], zlib.crc32(ids.tobytes()), next(back) == whole, ids if keep_ids else None))
                            size += len(ids) if keep_ids else 1
                    if size > 1_000_000:
                        yield table(rows)
                        rows, size = [], 0
            yield table(rows)

    out = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(work, schema)
    return out.withColumnRenamed("id", key)
