import collections
import math

import pytest

from clearcharge.llm import kneser_ney
from clearcharge.llm.kneser_ney import discounts, scored, train


class Plain:
    """The same model from its formulas."""

    def __init__(self, texts):
        tokens = [self.cut(t) for t in texts]
        self.c = collections.Counter(w for v in tokens for w in v)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = collections.Counter((a, b) for v in tokens for a, b in zip([None] + v[:-1], v))
        self.a = collections.Counter(b for _, b in self.pairs)
        few = lambda xs: discounts([sum(x == k for x in xs) for k in (1, 2, 3, 4)])
        self.d, self.e = few(self.pairs.values()), few(self.a.values())
        self.spare = sum(self.e[min(x, 3)] for x in self.a.values()) / len(self.pairs) if self.pairs else 1
        self.of = collections.defaultdict(list)
        for (u, _), n in self.pairs.items():
            self.of[u].append(n)

    @staticmethod
    def cut(text):
        return [*(text or "").encode().lower().split(), b""]

    def low(self, v):
        return self.spare / (self.v + 1) + ((self.a[v] - self.e[min(self.a[v], 3)]) / len(self.pairs) if v in self.a else 0)

    def p(self, u, v):
        seen = self.of.get(u)
        if not seen:
            return self.low(v)
        n = self.pairs.get((u, v), 0)
        return (n - self.d[min(n, 3)]) / sum(seen) + sum(self.d[min(x, 3)] for x in seen) / sum(seen) * self.low(v)

    def score(self, text):
        v = self.cut(text)
        plain = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in v)
        return len(v), sum(w in self.c for w in v), plain, sum(math.log10(self.p(a, b)) for a, b in zip([None] + v[:-1], v))


@pytest.mark.parametrize("trained", ["some", "none", "empty"])
def test_scores_are_those_of_the_formulas(spark, documents, prose, trained):
    known = {"some": [prose(n, n) for n in (1, 2, 30, 400, 400, 3_000)] + ["the " * 500, None, "", "Été MÛR the"], "none": [], "empty": ["", None]}[trained]
    asked = [*known, prose(500, 91), "unseen words only", "the unseen the", None, "", prose(20_000, 5)]
    model, plain = train(documents(known).repartition(6)), Plain(known)
    assert (model.tokens, model.words, model.pairs) == (plain.n, plain.v, len(plain.pairs))
    for r in scored(documents(asked), model).collect():
        n, k, base, score = plain.score(asked[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, k)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_frequent_first_words_are_spread(spark, documents, prose):
    texts = ["the " + " the ".join(prose(300, s).split()) for s in range(8)]
    model, plain = train(documents(texts).repartition(16)), Plain(texts)
    assert len(model.hot)
    for r in scored(documents(texts), model).collect():
        assert r.score == pytest.approx(plain.score(texts[r.doc_id])[3], rel=1e-9)


def test_probabilities_sum_to_one(prose):
    plain = Plain([prose(200, s) for s in range(3)])
    for u in [None, b"tide", b"never"]:
        assert sum(plain.p(u, v) for v in [*plain.c, b"never"]) == pytest.approx(1.0)


def test_arrays_are_replaced_whole(tmp_path):
    import numpy as np

    from clearcharge.llm.shared_files import map_array, write_array

    for values in ([3, 1, 2], [3, 1, 2], []):
        write_array(f"file://{tmp_path}/a/x", np.array(values, np.int64))
        assert map_array(f"file://{tmp_path}/a/x", np.int64).tolist() == values
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["x"]
    assert kneser_ney.END == b""
