from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from starledger.llm import queries, vector_codes


def plain(rows, parts=8, entries=16, rounds=6):
    """All parts against all entries, in Python's integers."""
    kept = [
        (i, [math.floor(4096 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    size = len(kept[0][1]) if kept else 0
    cuts = [size * k // parts for k in range(parts + 1)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[x[a:b] for _, x, _ in first] for a, b in zip(cuts, cuts[1:], strict=False)]

    def best(part, x):
        p = x[cuts[part] : cuts[part + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), e) for e, c in enumerate(books[part]))

    for _ in range(rounds):
        new = []
        for part in range(parts):
            members = {}
            for _, x, _ in kept:
                members.setdefault(best(part, x)[1], []).append(x[cuts[part] : cuts[part + 1]])
            new.append(
                [
                    [sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else c
                    for e, c in enumerate(books[part])
                ]
            )
        books = new
    out, by_label = [], {}
    for i, x, label in kept:
        found = [best(part, x) for part in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    listed = ",".join(str(v) for book in books for c in book for v in c)
    digest = hashlib.sha256(listed.encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    near = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(5)]
    rows = [
        (i, [x + rng.gauss(0, 0.01) for x in rng.choice(near)], rng.choice([None, 1, 2, 7])) for i in range(150)
    ]
    rows += [(200 + i, near[0], 1) for i in range(80)]  # copies: ties everywhere
    rows += [(300 + i, [0.0] * 8 + [float(i % 2)] * 8, None) for i in range(20)]
    rows += [
        (400, None, 1),
        (401, [None] + [0.0] * 15, 1),
        (402, [float("nan")] * 16, 2),
        (403, [0.0] * 15 + [float("inf")], 2),
        (-5, [0.5] * 16, 3),
        (-5, [0.25] * 16, 3),
        (None, [0.125] * 16, None),
    ]
    rng.shuffle(rows)
    return rows


def written(spark, rows, folder):
    frame = spark.createDataFrame(
        [(i, v, label, "extra", 1) for i, v, label in rows],
        "vec_id long, embedding array<double>, label int, x string, to_pivots int",
    )
    frame.write.parquet(str(folder / "embeddings.parquet"))
    return str(folder)


def test_codes_equal_those_of_plain_search(spark, vectors, tmp_path):
    got = queries.laesa_codes(spark, written(spark, vectors, tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(vectors)


def test_fewer_vectors_than_entries_and_uneven_parts(spark, tmp_path):
    rows = [(k, [k * 0.1, -k * 0.2, 0.3], k % 2) for k in range(5)]
    got = queries.laesa_codes(spark, written(spark, rows, tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_values_beyond_the_squares_of_64_bits(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, [rng.uniform(-1, 1) * 1e12 for _ in range(8)], 1) for k in range(40)]
    rows += [(50, [1e30] * 8, 1)]
    got = queries.laesa_codes(spark, written(spark, rows, tmp_path)).collect()
    want = plain(rows[:-1])
    assert sorted((r[0], r[1]) for r in got) == sorted((r[0], r[1]) for r in want)
    assert {r["codebooks_sha256"] for r in got} == {want[0][4]}
    fits = {r[0]: r[2] if r[2] < 1 << 63 else None for r in want}
    assert {r["vec_id"]: r["error"] for r in got} == fits


def test_empty_tables(spark, tmp_path):
    assert queries.laesa_codes(spark, written(spark, [], tmp_path)).collect() == []
    (tmp_path / "none").mkdir()
    assert queries.laesa_codes(spark, written(spark, [(1, None, 1)], tmp_path / "none")).collect() == []


def test_bounds_prune_and_decide_ties():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (16, 8))
    points = centres[rng.integers(0, 16, 5000)] + rng.integers(-40, 40, (5000, 8))
    entries, pivots = np.concatenate([centres[:15], centres[:1]]), centres[:3]
    index, best, evaluated = vector_codes.nearest(
        points, vector_codes.pivot_distances(points, pivots), entries, pivots
    )
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()
    assert evaluated < 5 * len(points)


def test_pivots_are_far_apart():
    book = [[0, 0], [1, 0], [100, 0], [50, 90], [2, 2]]
    assert vector_codes.spread_pivots(book, 3) == [[0, 0], [50, 90], [100, 0]]
    assert vector_codes.spread_pivots(book[:1], 3) == [[0, 0]]
