from __future__ import annotations

import random
import re

import numpy as np
import pytest

from starledger.llm import ngram_join
from tests.llm.conftest import EDGE_ROWS


def shingles(text, words):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = min(words, len(found))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set()


def components(rows, words, percent):
    """All pairs, compared one by one."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, left) in enumerate(sets):
        for b, right in sets[:k]:
            if a is None or b is None or not left or not right:
                continue
            if 100 * len(left & right) >= percent * len(left | right):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(
        ((i, len(s), None if i is None else find(i)) for i, s in sets), key=lambda r: (r[0] is None, r)
    )


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows(prose):
    """Groups of near copies of many sizes, exact copies, a common passage, and edge rows."""
    rng, made = random.Random(3), []
    passage = prose(999, 30)
    for k in range(14):
        base = prose(k, rng.choice([3, 8, 12, 25, 60, 150, 300]))
        for _ in range(rng.randint(1, 5)):
            made.append(edited(base, rng, rng.randint(0, max(1, len(base.split()) // 40))))
        made.append(base.upper())
        made.append(passage + " " + prose(100 + k, 20))
    hot = prose(77, 120)
    made += [edited(hot, rng, 2) for _ in range(40)] + [hot] * 25
    rng.shuffle(made)
    return [*enumerate(made), *EDGE_ROWS]


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_few_sets_fill_no_more_blocks_than_may_differ(percent):
    """Such sets share one key of their band, so they must be rare at a band's least size, too."""
    rng, bands = np.random.default_rng(5), ngram_join.Bands(percent)
    for band, least in enumerate(e for e in bands.edges if e < 2000):
        blocks, allowed = bands.blocks[band], bands.allowed[band]
        few = sum(len(np.unique(rng.integers(0, blocks, least))) <= allowed for _ in range(4000))
        assert few <= 4, (least, few)


@pytest.mark.parametrize("percent", [80, 85])
def test_unrelated_sets_meet_in_no_key(percent):
    rng, bands, met = np.random.default_rng(6), ngram_join.Bands(percent), {}
    for _ in range(2000):
        found = np.unique(rng.integers(0, 2**64, int(rng.integers(105, 140)), dtype=np.uint64))
        for band in bands.of(len(found)):
            for key in ngram_join.sketch_keys(found, band, bands)[0].tolist():
                met[key] = met.get(key, 0) + 1
    assert max(met.values()) <= 10


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_components_equal_all_pairs(frame, rows, monkeypatch, words, percent):
    monkeypatch.setattr(ngram_join, "CROWD", 3)  # so that the rules for crowded keys are used
    monkeypatch.setattr(ngram_join, "CHUNK", 7)
    got = ngram_join.jaccard_components(frame(rows), words=words, percent=percent).collect()
    ordered = sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r))
    assert ordered == components(rows, words, percent)


def test_empty_table(frame):
    assert ngram_join.jaccard_components(frame([])).collect() == []


def test_shingle_hashes_follow_the_words():
    def of(text, words=4):
        return ngram_join.shingle_set(np.frombuffer(text.encode(), np.uint8), words)

    assert len(of("a b c d e")) == 2 and len(of("a b")) == 1 and len(of(" \n")) == 0
    assert (of("A b\tC\x0bd") == of("a b c d")).all()
    assert not set(of("ab c d e")) & set(of("a bc d e"))
    assert len(of("É b c d")) == 1 and (of("É b c d") != of("é b c d")).all()


def test_hashes_do_not_depend_on_block_borders(monkeypatch, prose):
    text = np.frombuffer((prose(5, 400) + " " + "x" * 300).encode(), np.uint8)
    whole = ngram_join.word_hashes(text)
    monkeypatch.setattr("starledger.llm.text_hashes.BLOCK_BYTES", 64)
    assert (ngram_join.word_hashes(text) == whole).all()


def test_a_similar_pair_shares_a_key():
    """Pigeonhole: no pair at or above the threshold without a common key, whatever its sizes."""
    rng = np.random.default_rng(1)
    bands = ngram_join.Bands(85)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        left = rng.integers(0, 2**64, n, dtype=np.uint64)
        gone = int(rng.integers(0, n // 6 + 1))
        new = rng.integers(0, 2**64, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)
        right = np.unique(np.concatenate([left[gone:], new]))
        left = np.unique(left)
        inter = len(np.intersect1d(left, right))
        if 100 * inter < 85 * (len(left) + len(right) - inter) or np.array_equal(left, right):
            continue
        keys = [
            {int(k) for band in bands.of(len(s)) for k in ngram_join.sketch_keys(s, band, bands)[0]}
            for s in (left, right)
        ]
        assert keys[0] & keys[1]
        for s in (left, right):
            for band in bands.of(len(s)):
                differing = bands.allowed[band]
                assert ngram_join.sketch_keys(s, band, bands)[1] <= bands.blocks[band] - differing - 1


def test_bit_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        left = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 500)), dtype=np.uint64))
        new = rng.integers(0, 2**64, int(rng.integers(0, 300)), dtype=np.uint64)
        right = np.unique(np.concatenate([left[int(rng.integers(0, len(left))) :], new]))
        bits = [ngram_join.bit_sketch(s) for s in (left, right)]
        for size in {min(map(len, bits)), 32}:
            a, b = (ngram_join.folded(x, size) for x in bits)
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(left, right))
