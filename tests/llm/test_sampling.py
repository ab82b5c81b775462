import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from clearcharge.llm.piece_sampling import BLANK, pieces_of, samples, segmentations

PATH = public_tokenizers.path("piece_bpe_32k.model")
THETA = 1.5


def every(weights, word):
    """All segmentations of a word with their weights."""
    if not word:
        return [((), 0.0)]
    return [((weights[word[:j]][0], *rest), weights[word[:j]][1] + w) for j in range(1, len(word) + 1) if word[:j] in weights for rest, w in every(weights, word[j:])]


def seeds(n):
    return [xxhash.xxh3_64_intdigest(str(i)) for i in range(n)]


@pytest.fixture(scope="module")
def exact():
    p = pieces_of(PATH, THETA)
    found = [(a + b, x + y) for a, x in every(p.weights, BLANK + "the") for b, y in every(p.weights, BLANK + "cat")]
    total = sum(math.exp(w) for _, w in found)
    return {ids: math.exp(w) / total for ids, w in found}


def test_samples_without_replacement(exact):
    p, n = pieces_of(PATH, THETA), 4_000
    first, pairs = collections.Counter(), collections.Counter()
    for found in samples(p, p.prepare(["the cat"] * n), 2, seeds(n)):
        a, b = (tuple(s["ids"].tolist()) for s in found)
        first[a] += 1
        pairs[a, b] += 1
        assert a != b
    for ids, chance in exact.items():
        assert abs(first[ids] / n - chance) < 4 * math.sqrt(chance * (1 - chance) / n) + 2 / n
    for (a, b), seen in pairs.items():
        chance = exact[a] * exact[b] / (1 - exact[a])
        assert abs(seen / n - chance) < 5 * math.sqrt(chance / n) + 3 / n


def test_inclusion_scores_weigh_samples(exact):
    """Samples weighted by probability over inclusion estimate any sum; here that of all probabilities."""
    p, total = pieces_of(PATH, THETA), 0.0
    for found in samples(p, p.prepare(["the cat"] * 1_500), 3, seeds(1_500)):
        for s in found:
            assert math.exp(s["log_prob"]) == pytest.approx(exact[tuple(s["ids"].tolist())])
            total += math.exp(s["log_prob"] - s["log_inclusion"])
    assert total / 1_500 == pytest.approx(1.0, abs=0.05)


def test_all_segmentations_come_out(exact):
    p = pieces_of(PATH, THETA)
    found = samples(p, p.prepare(["the cat"]), 1_000, [5])[0]
    assert {tuple(s["ids"].tolist()) for s in found} == set(exact) and len(found) == len(exact)
    assert [s["perturbed"] for s in found] == sorted((s["perturbed"] for s in found), reverse=True)
    assert all(s["log_inclusion"] == 0 for s in found)


def test_late_branches_are_found():
    """Nothing to choose for the first hundreds of steps: alternatives lie behind the opened head."""
    p = pieces_of(PATH, THETA)
    text = "\U0001F980" * 300 + "cat"
    found = samples(p, p.prepare([text]), 5, [5])[0]
    assert len({tuple(s["ids"].tolist()) for s in found}) == len(found) > 1
    assert all(p.decode(s["ids"].tolist()) == text for s in found)


def test_round_trips_and_seeds(spark, documents, prose):
    texts = ["", None, "  two  blanks\n\ttab ", "日本 é \U0001F980\x00z", prose(400, 1), prose(20_000, 2), "▁a", "x" * 5_000, prose(400, 1)]
    docs = documents(texts)
    got = segmentations(docs, PATH, k=3).collect()
    assert all(r.decoded for r in got)
    p = pieces_of(PATH, THETA)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, np.int32).tobytes())
        assert p.decode(r.ids) == (texts[r.doc_id] or "").replace(BLANK, " ")
    for i, rows in by.items():
        assert len({tuple(r.ids) for r in rows}) == len(rows) == (1 if not texts[i] else 2 if i == 3 else 3)
    again = segmentations(docs.repartition(3), PATH, k=3, keep_ids=False).collect()
    assert sorted((r.doc_id, r.rank, r.ids_crc32) for r in again) == sorted((r.doc_id, r.rank, r.ids_crc32) for r in got)
    assert segmentations(documents([]), PATH).count() == 0


def test_the_query_returns_the_segmentations_themselves(spark, documents, tmp_path):
    from clearcharge.llm.queries import QUERIES

    texts = ["the cat sat", "", None, "a" * 30 + " ünïcode 😀"]
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op3_sentencepiece_sampling"](spark, str(tmp_path)).collect()
    p = pieces_of(PATH, THETA)
    assert len(got) == 6
    for r in got:
        assert p.decode(r["ids"]) == (texts[r["doc_id"]] or "") and len(r["ids"]) == r["n_pieces"]
        assert zlib.crc32(np.array(r["ids"], np.int32).tobytes()) == r["ids_crc32"]
