import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from clearcharge.llm import token_alignment
from clearcharge.llm.token_alignment import aligned

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
TEXTS = [
    "the lantern and the harbor", "the lantern and the harbor", None, "", " ", "   two  blanks \n\n\t end  ", "<s>x</s> <unk> <|endoftext|> <0x41>",
    "holds ▁ itself", "日本語 한국어 é ﬁ 😀 ͸", "=" * 300, "a\x00b c\r\n", "we'll they've", "x", "\U0001f9d1‍\U0001f680" * 20,
]


class Plain:
    """The same from the definitions, token by token."""

    def __init__(self, texts):
        self.a, self.b = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
        self.a.encode_special_tokens = True
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in plain]
        self.letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}
        self.rows = [self.row(t) for t in texts]
        held = Counter(p for _, _, links in self.rows for p in set(links))
        top = defaultdict(int)
        for (x, _), n in held.items():
            top[x] = max(top[x], n)
        self.out = [self.result(r, held, top) for r in self.rows]

    def row(self, text):
        if not text:
            return [], [], []
        whole = (" " + text).encode()
        x = self.a.encode(" " + text, add_special_tokens=False).ids
        y = self.b.encode(text)
        bx = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in x]
        by = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(bx) != whole or b"".join(by) != whole:
            return [], [], []
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ex, ey = ends(bx), ends(by)
        common = sorted(set(ex) & set(ey))
        groups = [([i for i, e in zip(x, ex) if low < e <= high], [i for i, e in zip(y, ey) if low < e <= high]) for low, high in zip([0, *common], common)]
        return x, groups, [(i, j) for p, q in groups for i in p for j in q]

    @staticmethod
    def result(row, held, top):
        x, groups, links = row
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        return (len(x), sum(len(q) for _, q in groups), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "")


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _mixed(prose, seed):
    r = random.Random(seed)
    return "".join(r.choice(["  ", prose(3, r.random()), "ß", "été", "1234", "\n", "...", "日", "aaaa", "ing"]) for _ in range(60))


@pytest.mark.parametrize("ranks", [True, False])
def test_equals_the_definitions(spark, documents, prose, ranks):
    texts = [*TEXTS, *[prose(n, n) for n in (40, 41, 300)], *[_mixed(prose, s) for s in range(12)]]
    got = aligned(documents(texts).repartition(5), *FILES[: 2 + ranks], keep_groups=True)
    want = Plain(texts)
    rows = {r.doc_id: r for r in got.documents.collect()}
    assert len(rows) == len(texts)
    for i, expected in enumerate(want.out):
        assert tuple(rows[i][c] for c in COLUMNS) == expected, texts[i]
    held = Counter(p for _, _, links in want.rows for p in set(links))
    assert {(r.a, r.b): r.n for r in got.pairs.collect()} == held


def test_blocks_and_slices_do_not_matter(spark, documents, prose, monkeypatch):
    texts = [prose(30, s % 4) for s in range(40)] + ["日本" * 50, "ab" * 400]
    whole = aligned(documents(texts).coalesce(1), *FILES).documents.collect()
    monkeypatch.setattr(token_alignment, "PORTION_BYTES", 300)
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 1_000)
    assert sorted(aligned(documents(texts).coalesce(1), *FILES).documents.collect()) == sorted(whole)
    monkeypatch.setattr(token_alignment, "PAIRS_AT_ONCE", 2)
    side = token_alignment.sides(FILES[0], FILES[2], FILES[1])
    raw = [t.encode() for t in texts]
    a, b = (token_alignment.Tokens.of(s, ids) for s, ids in zip(side, token_alignment.encoded(*side, raw)))
    doc, code, times = token_alignment.linked(token_alignment.groups_of(a, b), a.ids, b.ids, 50257, 32000)
    plain = Plain(texts)
    for i, (_, _, links) in enumerate(plain.rows):
        mine = {(c // 32000, c % 32000): t for c, t in zip(code[doc == i].tolist(), times[doc == i].tolist())}
        assert mine == Counter(links)
    assert [tuple(r[c] for c in COLUMNS) for r in sorted(whole, key=lambda r: r.doc_id)] == plain.out


def test_rows_without_id_and_repeated_rows(spark, prose):
    rows = [(None, "the harbor"), (None, "the harbor"), (3, "the harbor"), (3, None)]
    got = aligned(spark.createDataFrame(rows, "doc_id bigint, text string"), *FILES).documents.collect()
    assert sorted((r.doc_id is None, r.n_a, r.count_sum) for r in got) == sorted([(True, 2, 9)] * 2 + [(False, 2, 9), (False, 0, 0)])


def test_no_documents(spark, documents):
    got = aligned(documents([]), *FILES)
    assert got.documents.count() == 0 and got.pairs.count() == 0
