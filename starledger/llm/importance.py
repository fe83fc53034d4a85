"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Unigrams and bigrams of words are hashed into half of the ``buckets`` each. Two generative models, bags of
n-grams with add-one smoothing, are counted over all raw texts and over all texts of the target;
a text's weight is its log likelihood ratio between them. Adding Gumbel noise to the weights
and taking the k largest samples k texts without replacement in proportion to the ratio.

The noise is a hash of the id, so a run can be repeated, and a lost task redone, with
one result.

Null text and text without words have weight 0. Rows that repeat an id and text weigh
alike and, like all ties with the k-th row, are kept or left together. A null id
draws one noise for all such rows. Without any target text all weights are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.text_hashes import BASE, mix64, text_bytes, word_hashes
from starledger.sources.staging import stage

BUCKETS = 1 << 16
BROADCAST_ROWS = 500_000
CUT_BINS = 1024


def ngram_buckets(data: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of every word and every pair of neighbours."""
    words = word_hashes(data)
    pairs = mix64(words[:-1] * BASE + words[1:])
    half = np.uint64(buckets // 2)
    return np.concatenate([words % half, half + pairs % half]).astype(np.int64)


COUNTS = "bucket long, raw long, target long"


def ngram_counts(docs: DataFrame, text_col: str, target_col: str, buckets: int) -> DataFrame:
    """Counts per bucket over all rows, and over those whose ``target_col`` is true."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counted = np.bincount(ngram_buckets(text_bytes(text), buckets), minlength=buckets)
                raw += counted
                if wanted:
                    target += counted
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"]
        )

    partial = docs.select(text_col, target_col).mapInArrow(count, COUNTS)
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int) -> np.ndarray:
    """Log of target over raw probability per bucket (one row a bucket reaches the driver)."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(buckets)
    ratio = (target + 1) / (target.sum() + buckets) * ((raw.sum() + buckets) / (raw + 1))
    return np.log(ratio)


def weigh(docs: DataFrame, id_col: str, text_col: str, ratios: np.ndarray) -> DataFrame:
    """doc_id and log_weight, the sum of the ratios of all n-grams of the text."""
    buckets = len(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [float(ratios[ngram_buckets(text_bytes(t), buckets)].sum()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(weights, pa.float64())], ["doc_id", "log_weight"]
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(score, "doc_id long, log_weight double")


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly: the bin that holds it is cut anew until it is one value.

    Each round reads the staged values and brings ``CUT_BINS`` counts to the driver.
    """
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / CUT_BINS
        inside = values.where(F.col(column).between(low, high))
        above = values.where(F.col(column) > high).count()
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(CUT_BINS - 1))
        bins = (
            inside.groupBy(place.alias("bin"))
            .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for r in bins:
            above += r["n"]
            if above >= k:
                low, high = r["low"], r["high"]
                break
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    share: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    target: str = "quality = 1 AND toxic = 0",
    buckets: int = BUCKETS,
    seed: int = 17,
) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept.

    ``share`` of the rows is kept; by default as large a share as the target has among labelled rows.
    """
    judged = stage(
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("_id"))
        .agg(F.max(F.coalesce(F.expr(target), F.lit(False))).alias("wanted"))
    )
    n_judged, n_wanted = judged.agg(F.count("*"), F.count_if("wanted")).first()
    wanted = judged.where("wanted").select("_id")
    known = F.broadcast(wanted) if n_wanted <= BROADCAST_ROWS else wanted
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = narrow.join(known, narrow["doc_id"] == known["_id"], "left").withColumn(
        "wanted", F.col("_id").isNotNull()
    )
    ratios = log_ratios(ngram_counts(marked, "text", "wanted", buckets), buckets)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)).cast("double")
    uniform = (draw + 0.5) / float(1 << 52)
    keyed = stage(
        weigh(docs, id_col, text_col, ratios).withColumn(
            "gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))
        )
    )
    n = keyed.count()
    if share is None:
        share = n_wanted / n_judged if n_judged else 1.0
    k = math.ceil(share * n)
    least = kth_largest(keyed, "gumbel_key", k) if n and k else math.inf
    return keyed.withColumn("kept", F.col("gumbel_key") >= F.lit(least))
