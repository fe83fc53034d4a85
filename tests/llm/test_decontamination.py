from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from starledger.llm import decontamination as d
from tests.llm.conftest import EDGE_ROWS


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def naive(rows, items):
    """Every alignment of every text with every item."""
    found = set()
    for doc, text in rows:
        w = words(text)
        for item, passage in items:
            v = words(passage)
            if len(v) < d.SPAN:
                continue
            needed = 11 if len(v) >= 13 else len(v) - 1 if len(v) >= 10 else len(v)
            for shift in range(1 - len(v), len(w)):
                same = [
                    v[j] == w[j + shift] for j in range(max(0, -shift), min(len(v), len(w) - shift))
                ]
                size = min(13, len(same))
                if size and max(sum(same[k : k + size]) for k in range(len(same) - size + 1)) >= needed:
                    found.add((doc, item))
    return found


@pytest.fixture(scope="module")
def items(prose):
    sizes = [40, 13, 12, 10, 9, 8, 7, 1, 25, 30]
    made = [(k, prose(500 + k, n)) for k, n in enumerate(sizes)]
    return [*made, (20, None), (21, ""), (0, made[0][1]), (None, prose(530, 20))]


@pytest.fixture(scope="module")
def rows(prose, items):
    rng, made = random.Random(2), []
    for _, passage in items:
        for edits in (0, 1, 2, 3, 6):
            w = (passage or "").split()
            for k in rng.sample(range(len(w)), min(edits, len(w))):
                w[k] = "changed"
            made.append(prose(rng.randrange(10**6), 30) + ". " + " ".join(w).upper() + "! " + prose(rng.randrange(10**6), 30))
    first = items[0][1].split()
    made += [
        " ".join(first[:12]),
        " ".join(first[-14:]) + " " + prose(1, 20),
        "; ".join(first[5:20]),
        prose(3, 4000) + " " + items[8][1] + " " + prose(4, 4000),
        " ".join(first[:10]) + " inserted " + " ".join(first[10:]),
    ]
    return [*enumerate(made), *EDGE_ROWS]


def test_masks_miss_no_window_with_two_substitutions():
    for changed in combinations(range(d.WINDOW), d.WINDOW - d.LEAST_EQUAL):
        assert any(
            all(at + i not in changed for i, c in enumerate(m) if c == "1")
            for m in d.MASKS
            for at in range(d.WINDOW - d.SPAN + 1)
        )
    for size in range(d.SPAN + 2, d.WINDOW):
        for changed in range(size):
            assert any(
                all(at + i != changed for i, c in enumerate(m) if c == "1")
                for m in d.MASKS
                for at in range(size - d.SPAN + 1)
            )


@pytest.mark.parametrize("limit", [500_000, 0])
def test_overlaps_equal_all_alignments(spark, frame, rows, items, monkeypatch, limit):
    monkeypatch.setattr(d, "BROADCAST_ROWS", limit)
    tests = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS words", "1 AS n")
    got = d.find_overlaps(frame(rows), tests).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == naive(rows, items)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert {r["doc_id"] for r in d.contaminated(frame(rows), tests).collect()} == {i for i, _ in naive(rows, items)}


def test_empty_tables(spark, frame, rows, items):
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert d.find_overlaps(frame([]), tests).collect() == []
    assert d.find_overlaps(frame(rows), tests.limit(0)).collect() == []
