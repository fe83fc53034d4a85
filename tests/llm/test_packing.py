from __future__ import annotations

import zlib
from array import array

import pytest

from starledger.llm import packing
from tests.llm.conftest import EDGE_ROWS

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def rows(prose):
    odd = ["<|endoftext|> x", "a <|endoftext|><|endoftext|>b <|endof", "<|endoftext|>", "a  b   c\n\n d", "don't 's", " ", "\n", "é　漢字 😀‍👩"]
    texts = [prose(k, 1 + k * k * 7) for k in range(30)] + odd + [prose(50, 9000)] * 2
    return [*enumerate(texts), *EDGE_ROWS]


def test_pieces_are_the_tokens_and_sequences_are_gapless(frame, rows, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 4)
    got = packing.pack_documents(frame(rows)).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(array("I", piece).tobytes())
    assert by_doc.keys() == ids.keys()
    times = {i: sum(1 for j, _ in rows if j == i) for i in ids}
    for i, pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == times[i] * len(ids[i])
        assert sorted({p["start"] for p in pieces}) == list(range(0, len(ids[i]), packing.SEQ_LEN))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.SEQ_LEN


def test_histogram_packing_places_every_piece_once():
    import random

    rng = random.Random(1)
    histogram = {rng.randint(1, 2048): rng.randint(1, 5000) for _ in range(700)}
    slots = packing.pack_histogram(histogram)
    fill, placed = {}, dict.fromkeys(histogram, 0)
    for length, first, last, sequence, offset in sorted(slots, key=lambda s: (s[0], s[1])):
        assert first == placed[length]
        placed[length] = last + 1
        for k in range(last - first + 1):
            fill.setdefault(sequence + k, []).append((offset, length))
    assert placed == histogram
    for pieces in fill.values():
        assert [o for o, _ in sorted(pieces)] == [
            sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))
        ]
        assert sum(n for _, n in pieces) <= 2048
    tokens = sum(k * v for k, v in histogram.items())
    assert tokens > 0.97 * 2048 * len(fill)
    assert sorted(fill) == list(range(len(fill)))


def test_longest_go_first_to_the_pack_with_most_room():
    slots = packing.pack_histogram({6: 1, 5: 1, 3: 1, 2: 1}, 10)
    place = {length: (sequence, offset) for length, _, _, sequence, offset in slots}
    assert place[6][0] != place[5][0]
    assert place[3] == (place[5][0], 5) and place[2] == (place[6][0], 6)


def test_empty_table(frame):
    assert packing.pack_documents(frame([])).collect() == []


def test_a_long_run_of_blanks(frame):
    """No token holds two blanks, and the tokenizer itself panics on so many."""
    blanks = 2_000_000
    got = packing.pack_documents(frame([(1, " " * blanks), (2, "x" + " " * blanks)])).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} == {(1, blanks + 1), (2, blanks + 2)}
    whole = array("I", [220] * packing.SEQ_LEN).tobytes()
    assert {r["ids_crc32"] for r in got if r["doc_id"] == 1 and r["length"] == packing.SEQ_LEN} == {zlib.crc32(whole)}
