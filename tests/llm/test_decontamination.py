import hashlib
import re

import numpy as np

from clearcharge.llm.decontaminate import contaminated, kept_grams, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(doc, items):
    own, hit, found = words(doc), set(), []
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        at = [i for i in range(len(own) - k + 1) if tuple(own[i : i + k]) in windows] if k else []
        hit |= {x for i in at for x in range(i, i + k)}
        found += [str(item)] * bool(at)
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_same_as_comparing_every_window(spark, documents, prose):
    a, b = prose(60, 1), prose(35, 2)
    texts = [a, prose(300, 3) + " " + a[40:200] + " " + prose(50, 4), b.upper().replace(" ", ", "), prose(9, 5), prose(10, 6), None, "", "!!!", prose(80, 7), "été mûr", prose(20_000, 9) + b, a + b + a, a]
    items = [(10, a), (2, a), (3, b), (4, prose(10, 6)), (5, prose(3, 7)), (6, "été mûr"), (7, None), (8, "..."), (9, prose(9, 5) + " more"), (11, prose(4, 8)), (12, "harbor")]
    bench = spark.createDataFrame([(*x, "y") for x in items], "item_id bigint, text string, hash string")
    got = {r.doc_id: r for r in contaminated(documents(texts), bench).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == plain(t, items), i


def test_empty_tables(spark, documents, prose):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit) for r in contaminated(documents([prose(12, 1)]), none).collect()] == [(12, 0)]
    assert contaminated(documents([]), none).count() == 0


def test_winnowing_keeps_a_gram_of_every_shared_run(prose):
    for seed in range(20):
        shared = prose(10, 500 + seed)
        x, y = (words_of(f"{prose(30, s)} {shared} {prose(30, s + 1)}".encode()) for s in (seed, seed + 100))
        assert len(np.intersect1d(kept_grams(x)[1], kept_grams(y)[1]))
