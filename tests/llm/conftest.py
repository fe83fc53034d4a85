from __future__ import annotations

import random

import pytest

#: Rows every operator must take: nulls, empty and blank texts, repeats, a null id.
EDGE_ROWS = [
    (9001, None),
    (9002, ""),
    (9003, " \n\t "),
    (9004, "one"),
    (9005, "one"),
    (9006, "1234 5678 !!"),
    (9007, "Ünïcode ÀÉÎ ñandú 漢字 😀 ǅ"),
    (None, "a text without an id that has a few words in it"),
    (9008, "the same row twice, told two times over"),
    (9008, "the same row twice, told two times over"),
]
#: Names that operators use inside; none may clash with a column of the input.
EXTRA = ["n", "h", "key", "words", "start", "length", "kept", "line", "n_lines", "n_removed", "n_entities", "__pipeline_key"]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (id, text) rows, with all usual columns and such as could clash."""

    def make(rows, languages=None):
        names = ["doc_id", "text", "lang", "source", "n_chars", *EXTRA]
        kinds = ["long", "string", "string", "string", "long", *["string"] * len(EXTRA)]
        full = [
            (i, t, (languages or {}).get(i), "src", None if t is None else len(t), *EXTRA)
            for i, t in rows
        ]
        return spark.createDataFrame(full, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))

    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic words: ``prose(seed, n)``."""
    syllables = "ba co di fu ge ha in ko lu ma ne or pi qua ru sto ti un ve wo".split()

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))

    return make
