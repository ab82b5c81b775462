"""How many lattices a worker keeps changes its memory, not what is sampled."""

from clearcharge.llm import piece_sampling
from clearcharge.llm.queries import tokenizer_file


def test_fewer_kept_nodes_are_forgotten_sooner():
    pieces = piece_sampling.Pieces(tokenizer_file("piece_bpe_32k.model"), 1.5)
    texts = [[f"word{n} and others {n}", "and again word word"] for n in range(6)]

    def sampled(kept):
        pieces.clear()
        most, found = 0, []
        for some in texts:
            prepared = pieces.prepare(some, kept)
            most = max(most, pieces.nodes)
            found += [[s["ids"].tolist() for s in one] for one in piece_sampling.samples(pieces, prepared, 2, [1, 2])]
        return most, found

    (few, at_few), (many, at_many) = sampled(10), sampled(10_000)
    assert few < many and at_few == at_many
