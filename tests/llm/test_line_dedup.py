from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from starledger.llm import line_dedup
from tests.llm.conftest import EDGE_ROWS


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def edited(line, rng, edits):
    chars = list(line)
    for _ in range(edits):
        k = rng.randrange(len(chars))
        kind = rng.randrange(3)
        chars[k : k + (kind != 0)] = [] if kind == 1 else [rng.choice("abcé ")]
    return "".join(chars)


def naive(rows, threshold=2, least=30):
    """Every line against every line before it."""
    first = {}
    for doc, text in sorted({r for r in rows if None not in r}):
        for n, raw in enumerate(text.split("\n")):
            line = raw.strip(" ")
            if len(line) >= least:
                first[line] = min(first.get(line, (doc, n)), (doc, n))
    near = {
        a
        for a in first
        if any(
            first[b] < first[a] and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold
            for b in first
        )
    }
    made = []
    for doc, text in rows:
        if doc is None or text is None:
            made.append((doc, text, 0))
            continue
        lines = text.split("\n")
        kept = [
            raw
            for n, raw in enumerate(lines)
            if len(raw.strip(" ")) < least
            or (raw.strip(" ") not in near and first[raw.strip(" ")] == (doc, n))
        ]
        made.append((doc, "\n".join(kept), len(lines) - len(kept)))
    return sorted(made, key=str)


@pytest.fixture(scope="module")
def rows(prose):
    rng, texts = random.Random(4), []
    pool = [prose(k, rng.randint(5, 20)) for k in range(40)]
    hot = prose(900, 9)
    for _ in range(45):
        lines = [edited(rng.choice(pool), rng, rng.choice([0, 0, 1, 2, 3])) for _ in range(4)]
        lines += [edited(hot, rng, rng.randint(0, 3)), "short", "", "  " + rng.choice(pool) + " "]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    whole = prose(901, 7)
    return [*enumerate(texts), (60, whole), (61, whole), (62, whole + "\n" + whole), *EDGE_ROWS]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_lines_equal_all_pairs(frame, rows, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
    docs = frame(rows)
    result = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(result.columns)
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in result.collect()), key=str)
    assert got == naive(rows)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng, pairs = random.Random(threshold), []
    for _ in range(400):
        a = "".join(rng.choice("abcé😀") for _ in range(rng.randint(8, 20)))
        pairs.append((a, edited(a, rng, rng.randint(0, 5)) or "x"))
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = frame.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), threshold).alias("near")).collect()
    assert all(r["near"] == (distance(r["a"], r["b"]) <= threshold) for r in got)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_near_lines_share_an_entry(spark, threshold):
    rng, pairs = random.Random(threshold), []
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(12, 40)))
        pairs.append((a, edited(a, rng, rng.randint(0, threshold))))
    frame = spark.createDataFrame(pairs, "a string, b string")
    both = F.arrays_overlap(
        *(line_dedup.entries(F.col(c), F.length(c), threshold) for c in ("a", "b"))
    )
    for r in frame.select("a", "b", both.alias("both")).collect():
        assert r["both"] or distance(r["a"], r["b"]) > threshold


def test_empty_table(frame):
    assert line_dedup.dedup_lines(frame([])).collect() == []


def test_one_open_line_behind_a_settled_pivot(frame):
    """The last line shares one entry with its near copy, whose other lines are all settled, the pivot too."""
    lines = [
        "The quick brawn fox jumps over lazy dog near the river bank.",
        "The quick brown fox jumps over lazy dog near the river bank.",
        "The quick brawn fox paints a red barn in the month of winter",
        "The quick brown fox paints a red barn in the month of winter",
        "The quick brown fox paints a rod barn in the month of wintar",
    ]
    rows = list(enumerate(lines))
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(frame(rows)).collect())
    assert got == naive(rows)
    assert [n for _, _, n in got] == [0, 1, 0, 1, 1]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_sketches_of_near_lines_are_near(spark, threshold):
    rng, pairs = random.Random(threshold), []
    for _ in range(500):
        a = "".join(rng.choice("abcdé😀 ") for _ in range(rng.randint(4, 60)))
        pairs.append((a, edited(a, rng, rng.randint(0, threshold))))
    sketch = line_dedup.pair_sketch
    bits = line_dedup.sketch_distance(sketch(F.col("a")), sketch(F.col("b"))).alias("bits")
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", bits).collect():
        assert r["bits"] <= 4 * threshold, r


def test_sketches_tell_apart_what_was_put_into_one_base(spark):
    """Lines with four characters of their own in different places: next to none may pass as near."""
    rng = random.Random(9)
    base = "".join(rng.choice("etaoin shrdlu") for _ in range(400))
    lines = [base[:at] + "".join(rng.choices("bcfgjkmpqvwxyz", k=4)) + base[at:] for at in range(0, 400, 2)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    told = frame.select("i", line_dedup.pair_sketch(F.col("line")).alias("bits"))
    other = told.select(F.col("i").alias("j"), F.col("bits").alias("others"))
    both = told.join(other, F.col("i") < F.col("j"))
    passed = both.where(line_dedup.sketch_distance(F.col("bits"), F.col("others")) <= 8).count()
    assert passed < len(lines) * (len(lines) - 1) / 2 * 0.05


@pytest.mark.parametrize("kind", ["tails", "words"])
def test_lines_with_one_common_segment_are_not_compared_in_pairs(frame, monkeypatch, kind):
    """400 lines behind one head, or with one word of a line replaced each; two near copies among them."""
    rng = random.Random(6)
    head = "".join(rng.choice("abcdefgh ") for _ in range(80))
    lines = []
    for _ in range(400):
        other = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789éèàùöäü") for _ in range(6))
        at = rng.randrange(10, 70)
        tail = "".join(rng.choice("abcdefgh ") for _ in range(100))
        lines.append(head + tail if kind == "tails" else head[:at] + other + head[at + 6 :])
    lines[300] = lines[100][:-3] + "x" + lines[100][-2:]
    seen, near = [], line_dedup._near

    def counted(pairs, texts, threshold):
        seen.append(pairs.count())
        return near(pairs, texts, threshold)

    monkeypatch.setattr(line_dedup, "_near", counted)
    rows = list(enumerate(line.strip() for line in lines))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(frame(rows)).collect()}
    assert got == {i: (t, 0) if i != 300 else ("", 1) for i, t in rows}
    assert sum(seen) < 5 * len(lines), seen


def test_counts_under_other_names_leave_columns(frame):
    docs = frame([(1, "x" * 40), (2, "x" * 40)])
    got = line_dedup.dedup_lines(docs, counts=("lines", "gone")).collect()
    assert {(r["doc_id"], r["gone"], r["n_removed"]) for r in got} == {(1, 0, "n_removed"), (2, 1, "n_removed")}
