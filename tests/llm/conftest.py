import random

import pytest

WORDS = "tide harbor lantern orchard copper saddle violet ember thicket mortar pebble quarry ribbon sparrow timber willow anchor basil cedar dune elm fern grove heath inlet jetty knoll ledge marsh notch oasis plain ridge shoal tarn vale weir yard zephyr".split()


@pytest.fixture
def prose():
    """prose(n, seed): n words."""
    return lambda n, seed: " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture
def documents(spark):
    """A documents table with an extra column whose name clashes with operators' own."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", f"src{i % 3}", None if t is None else len(t), "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string")

    return make
