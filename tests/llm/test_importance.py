from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger.llm import importance
from starledger.llm.text_hashes import BASE, mix64, word_hashes
from tests.llm.conftest import EDGE_ROWS

BUCKETS = 256


def naive_buckets(text):
    """Buckets of words and pairs, one by one."""
    found = [
        int(h)
        for w in (text or "").encode().split()
        for h in word_hashes(np.frombuffer(w, np.uint8))
    ]
    half = BUCKETS // 2
    pairs = [
        int(mix64(np.array([a], np.uint64) * BASE + np.array([b], np.uint64))[0])
        for a, b in zip(found, found[1:], strict=False)
    ]
    return [h % half for h in found] + [half + p % half for p in pairs]


@pytest.fixture(scope="module")
def rows(prose):
    good = [prose(k, 40) for k in range(30)]
    bad = [prose(k, 30) + " scum vile scum vile" for k in range(30, 45)]
    return [*enumerate(good + bad), *EDGE_ROWS]


@pytest.fixture(scope="module")
def labels(spark):
    made = [(i, int(i < 30), int(i >= 30)) for i in range(0, 45, 2)] + [(0, 1, 0), (None, 1, 0), (2, None, None)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int").withColumn("text", F.lit("z"))


@pytest.fixture(scope="module")
def result(frame, rows, labels):
    return importance.resample(frame(rows), labels, buckets=BUCKETS).collect()


def test_weights_are_log_ratios_of_counts(result, rows):
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, t in rows:
        np.add.at(raw, naive_buckets(t), 1)
        if i is not None and i < 30 and i % 2 == 0:
            np.add.at(target, naive_buckets(t), 1)
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    want = sorted(round(float(ratio[naive_buckets(t)].sum()), 6) if naive_buckets(t) else 0.0 for _, t in rows)
    assert np.allclose(want, sorted(r["log_weight"] for r in result), atol=1e-5)


def test_top_k_by_key(result, rows):
    share = 15 / 23  # of the labelled rows, each counted once
    k = math.ceil(share * len(rows))
    least = sorted((r["gumbel_key"] for r in result), reverse=True)[k - 1]
    assert all(r["kept"] == (r["gumbel_key"] >= least) for r in result)
    assert len(result) == len(rows)


def test_unlike_texts_go(result):
    kept = {r["doc_id"] for r in result if r["kept"]}
    assert not kept & set(range(30, 45)) and len(kept & set(range(30))) >= 24


def test_noise_is_gumbel_and_repeats(spark, frame, labels):
    rows = [(i, "same words here") for i in range(4000)]
    runs = [
        {r["doc_id"]: r["gumbel_key"] - r["log_weight"] for r in importance.resample(frame(rows), labels, share=0.5).collect()}
        for _ in range(2)
    ]
    assert runs[0] == runs[1]
    noise = np.array(list(runs[0].values()))
    assert abs(noise.mean() - 0.5772) < 0.08 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.08


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([0.0, 1.5, rng.gauss(0, 1), -1e9, 1e-12]) for _ in range(1000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert importance.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


def test_without_labels_or_rows(frame, labels, rows):
    assert importance.resample(frame([]), labels).collect() == []
    alone = importance.resample(frame(rows), labels.limit(0)).collect()
    assert all(r["kept"] and r["log_weight"] == 0 for r in alone)


def test_broadcast_and_shuffle_agree(frame, labels, rows, result, monkeypatch):
    monkeypatch.setattr(importance, "BROADCAST_ROWS", 0)
    again = importance.resample(frame(rows), labels, buckets=BUCKETS).collect()
    assert sorted(map(str, again)) == sorted(map(str, result))
