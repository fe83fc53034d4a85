from __future__ import annotations

import hashlib
import random
import re
import struct

import pytest

from starledger.llm import bpe, queries
from tests.llm.conftest import EDGE_ROWS

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(*bpe.vocabulary_files())


@pytest.fixture(scope="module")
def tokenizer():
    """Another library with the same vocabulary, special strings taken as text."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def long_texts():
    rng = random.Random(5)
    letters = "".join(rng.choices("abcdefgh", k=120_000))
    mixed = "".join(
        rng.choices(["word", "don't", " ", "  ", "\n\n", "\t", "12", "!?", "漢字", "。", "　", "\xa0", "é"], k=60_000)
    )
    blanks = " " * 70_000
    return {
        "letters": letters,
        "mixed": mixed,
        "blanks at the end": "x" + blanks,
        "blanks inside": "x" + blanks + "word" + "\n" * 70_000 + "word",
        "blanks first": blanks + "!",
        "ideographs": "漢字文" * 30_000,
        "stops": "=" * 100_000,
        "special": "<|endoftext|> " * 8_000,
        "digits and letters": "1a" * 50_000,
    }


def test_segments_are_the_text_and_bounded():
    for name, text in long_texts().items():
        parts = list(bpe.segments(text))
        assert "".join(p for p, _ in parts) == text, name
        if name in ("mixed", "special", "digits and letters"):
            assert max(len(p) for p, _ in parts) <= bpe.SEGMENT + 64, name


def test_segments_cut_only_between_matches():
    import regex

    pattern = regex.compile(P.PATTERN)
    for name in ("mixed", "special", "digits and letters"):
        text = long_texts()[name]
        ends = {m.end() for m in pattern.finditer(text)}
        at = 0
        for part, _ in bpe.segments(text):
            at += len(part)
            assert at in ends, name


def test_long_texts_have_the_ids_of_the_other_library(coder, tokenizer):
    for name, text in long_texts().items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.packed(text) == struct.pack(f"<{len(ids)}I", *ids), name


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte pair merging as it is defined: the leftmost pair of least rank first."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_ids_equal_plain_merging(coder):
    import base64

    import regex

    path, pattern = bpe.vocabulary_files()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    for text in ("I'll say it's 12 o'clock!!  ok\n\n", "漢字 ñandú　 x", "a\x00b \x1c c", "antidisestablishment" * 3):
        ids = [i for m in regex.findall(pattern, text) for i in merged(m.encode(), ranks)]
        assert coder.packed(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_query_over_edge_rows(spark, frame, prose, tokenizer, tmp_path):
    rows = [*EDGE_ROWS, (1, prose(1, 3000)), (2, "<|endoftext|> as text"), (3, "y" + " " * 2_000_000), (4, "a\nb")]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.byte_bpe(spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        text = text or ""
        if len(text) < 1_000_000:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
        else:  # no token holds two blanks
            ids = tokenizer.encode("y", add_special_tokens=False).ids + [220] * 2_000_000
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_documents_come_back_from_their_ids(frame, prose):
    rows = [(1, prose(1, 50)), (2, None), (3, "é 漢")]
    encoded = bpe.encode_documents(frame(rows))
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode_documents(encoded).collect()} == {
        i: t or "" for i, t in rows
    }


def test_ids_that_are_none(spark):
    rows = [(1, struct.pack("<I", 60_000)), (2, b"\x00"), (3, None), (4, b""), (5, struct.pack("<I", 220))]
    got = bpe.decode_documents(spark.createDataFrame(rows, "doc_id long, ids binary")).collect()
    assert {r["doc_id"]: r["decoded"] for r in got} == {1: None, 2: None, 3: None, 4: b"", 5: b" "}


def test_another_vocabulary_and_an_empty_table(frame):
    other = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = bpe.round_trip(frame([(1, "straße 漢字")]), vocabulary=other).collect()
    assert bytes(got[0]["decoded"]).decode() == "straße 漢字"
    assert bpe.round_trip(frame([])).collect() == []


def test_boundary_needs_no_lookbehind_over_the_start():
    assert re.match(bpe.BOUNDARY, "a b").end() == 1
