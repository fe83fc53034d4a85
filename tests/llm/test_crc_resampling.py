from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from starledger.llm import crc_resampling, queries
from tests.llm.conftest import EDGE_ROWS


def features(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain(rows, items):
    def counts(texts):
        found = [0] * 10_000
        for text in texts:
            for f in features(text):
                found[zlib.crc32(f.encode()) % 10_000] += 1
        return found

    s, t = counts(x for _, x in rows), counts(items)
    all_s, all_t = sum(s) + 10_000, sum(t) + 10_000
    gain = [math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)]
    scored = []
    for i, text in rows:
        found = [gain[zlib.crc32(f.encode()) % 10_000] for f in features(text)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append([i, len(found), weight, score, None])
    long = [r for r in scored if r[1] >= 39]
    drawn = sorted(long, key=lambda r: (-r[3], r[0] is None, r[0]))[: 25 * len(long) // 100]
    for rank, row in enumerate(drawn, 1):
        row[4] = rank
    return sorted(map(tuple, scored), key=repr)


@pytest.fixture(scope="module")
def rows(prose):
    rng = random.Random(8)
    made = [(i, prose(i, rng.choice([1, 5, 19, 20, 60, 300]))) for i in range(150)]
    made += [(500 + i, prose(7, 40)) for i in range(40)] + [(600, prose(7, 40))] * 9 + [(None, prose(9, 30))] * 3
    made += [
        (700, "Ünï ÀÉ " * 30),
        (701, "x" * 5_000 + " " + "y" * 511 + " " + "z" * 513 + " " + "x" * 5_000 + " " + "ab" * 400),
        (702, "A1-b2_c3.D4 " * 20),
        (703, "漢字 " * 700 + "w" * 600 + " " + "w" * 600),
    ]
    return [*made, *EDGE_ROWS]


@pytest.mark.parametrize("block", [64, crc_resampling.BLOCK_BYTES])
def test_query_equals_plain_counts(spark, frame, rows, prose, tmp_path, monkeypatch, block):
    """Small blocks cut most texts, some of them behind words that are longer than a block."""
    monkeypatch.setattr(crc_resampling, "BLOCK_BYTES", block)
    items = [None, "", prose(3, 200), "漢字 a1 b2"]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.target_resampling(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, items)


@pytest.mark.parametrize("block", [16, 100, 1 << 20])
def test_features_of_blocks(monkeypatch, rows, block):
    monkeypatch.setattr(crc_resampling, "BLOCK_BYTES", block)
    texts = [np.frombuffer((t or "").encode(), np.uint8) for _, t in rows]
    got = {}
    for where, found in crc_resampling.feature_buckets(texts):
        for row, bucket in zip(where.tolist(), found.tolist(), strict=True):
            got.setdefault(row, []).append(bucket)
    for k, (_, text) in enumerate(rows):
        assert sorted(got.get(k, [])) == sorted(zlib.crc32(f.encode()) % 10_000 for f in features(text)), k


def test_crcs_of_all_widths():
    rng = random.Random(2)
    widths = [1, 2, 7, 8, 9, 255, 256, 257, 511, 512, 513, 768, 769, 3000]
    words = [bytes(rng.choices(range(97, 123), k=n)) for n in widths for _ in range(3)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends = crc_resampling.word_spans(data)
    spans = [(starts, ends - starts)]
    assert crc_resampling.feature_crcs(data, spans).tolist() == [zlib.crc32(w) for w in words]
    pairs = [(starts[:-1], (ends - starts)[:-1]), (starts[1:], (ends - starts)[1:])]
    want = [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]
    assert crc_resampling.feature_crcs(data, pairs).tolist() == want


def test_rows_with_one_id_and_score_get_ranks_of_their_own(spark):
    rows = spark.range(1000).selectExpr("1L AS doc_id", "5L AS score", "id AS tie")
    got = [r["rank"] for r in crc_resampling._with_ranks(rows, 400).collect()]
    assert sorted(r for r in got if r) == list(range(1, 401)) and got.count(None) == 600


def test_empty_tables(spark, frame, prose, tmp_path):
    frame([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert queries.target_resampling(spark, str(tmp_path)).collect() == []
    (tmp_path / "b").mkdir()
    rows = [(i, prose(i, 30)) for i in range(8)]
    frame(rows).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    got = queries.target_resampling(spark, str(tmp_path / "b")).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, [])
