import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clearcharge.llm.token_counts import counter, prefix_counts, token_prefixes, tokens_within

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", " ", "   ", "we'll see, they're 'rest 'r", "a   b\n\n\tc  ", "x<|endoftext|>y  <|endoftext|>", "!!<|endoftext|>", "日本語 é̀ 12345٣", "=" * 200, "ՠꟑ ⁿ x", "\x1c\x85\x85z", "Hello    \r\n World"]


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix_counts_as_the_library_does(text):
    library = Tokenizer.from_file(PATH)
    want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert [0, *np.cumsum(counter(PATH).steps(text)).tolist()] == want


def test_table_answers_budgets_and_truncation(spark, documents, prose):
    library = Tokenizer.from_file(PATH)
    texts = [prose(900, 1), None, "", prose(3, 2), prose(20_000, 3), prose(3, 2)]
    got = {r.doc_id: r for r in token_prefixes(documents(texts), PATH, 512).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert got[i].n_bytes == len(t.encode()) and got[i].n_tokens == len(library.encode(t, add_special_tokens=False).ids)
        cut = got[i].budget_chars
        assert len(library.encode(t[:cut], add_special_tokens=False).ids) <= 512
        assert cut == len(t) or prefix_counts(got[i].steps)[cut + 1] > 512
    table = token_prefixes(documents(texts[:1]), PATH, 512).selectExpr("*", "cast(100 as bigint) as at")
    assert tokens_within(table, "at").first().tokens_at == len(library.encode(texts[0][:100], add_special_tokens=False).ids)


def test_no_documents(spark, documents):
    assert token_prefixes(documents([]), PATH, 512).count() == 0
