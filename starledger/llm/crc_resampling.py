"""Target-distribution importance resampling with CRC features.

Features are single words and pairs of neighbours; a feature's bucket is the CRC-32 of its bytes,
modulo the number of buckets. A bucket's gain is a thousand times the log ratio of its smoothed shares in the target and in
all texts; a document weighs the mean gain of its features, and those with the greatest sums of weight and
Gumbel noise are drawn (the noise is a hash of the id, so a task that runs again gives the same).

Length-bucketed CRC matrices: the distinct features of a block of texts are grouped by their length in bytes into
two-dimensional uint8 arrays, and one table step per byte position updates the CRCs of a whole group. Features are
told apart by their bytes. The CRCs are then scattered back to all occurrences. Features
above ``WIDE`` bytes stand as several rows of ``ROW`` bytes in such an array, whose CRCs are joined afterwards, so
the number of steps does not grow with them. Blocks hold about ``BLOCK_BYTES`` of text; longer texts go on in the next block.

Counts are folded per task to at most one row per bucket. Ranks come from one range shuffle of
narrow rows, so no task gets them all.

Null text, and text without words, has no features and weight 0. Rows without an id take
the noise of an empty one. Repeated rows are documents of their own: they weigh and score the same, and ties at the
end of the draw are broken by id, then in any order. Without any target text, or any document, gains follow the same formula.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starledger.llm.text_hashes import text_bytes
from starledger.sources.staging import stage

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
DRAWN_PERCENT = 25
BLOCK_BYTES = 1 << 21
WIDE = 512
ROW = 256

# --- CRC-32, column by column ------------------------------------------------------

_POLYNOMIAL = np.uint32(0xEDB88320)  # of the public CRC-32, reflected
_ONES, _BYTE, _EIGHT = np.uint32(0xFFFFFFFF), np.uint32(0xFF), np.uint32(8)


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), _POLYNOMIAL, np.uint32(0))
    return table


_TABLE = _table()


def updated(columns: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of ``columns``, an array with a row per byte position."""
    for column in columns:
        state = _TABLE[(state ^ column) & _BYTE] ^ (state >> _EIGHT)
    return state


def _row_tables() -> np.ndarray:
    """States after ``ROW`` zero bytes, by byte of the state; CRC steps are linear."""
    starts = np.arange(256, dtype=np.uint32)[None] << (_EIGHT * np.arange(4, dtype=np.uint32))[:, None]
    return updated(np.zeros((ROW, 1), np.uint8), starts.ravel()).reshape(4, 256)


_AFTER_ROW = _row_tables()


def wide_crcs(features: np.ndarray) -> np.ndarray:
    """CRC-32 of features of ``WIDE`` bytes or more that need equally many rows; one a row here, zeros in front.

    The first four bytes of a feature come inverted, which stands for the initial state; zeros in
    front of it leave a state of zero as it is.
    """
    n = len(features)
    rows = features.reshape(-1, ROW)
    alone = updated(rows.T, np.zeros(len(rows), np.uint32)).reshape(n, -1)
    state = np.zeros(n, np.uint32)
    for k in range(alone.shape[1]):
        moved = [_AFTER_ROW[b][(state >> np.uint32(8 * b)) & _BYTE] for b in range(4)]
        state = moved[0] ^ moved[1] ^ moved[2] ^ moved[3] ^ alone[:, k]
    return state ^ _ONES


# --- words and features of a block -----------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_WORD[128:] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[data]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def _at(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes from each start, a row each."""
    return np.lib.stride_tricks.sliding_window_view(data, length)[starts]


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value, and where it stands."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(keys[part[0]]), part


def distinct_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number per word, equal for equal bytes, and one place of each distinct word."""
    numbers, firsts, known = np.empty(len(starts), np.int64), [], 0
    for length, members in _groups(lengths):
        if length > WIDE:
            seen: dict[bytes, int] = {}
            spelled = (data[s : s + length].tobytes() for s in starts[members].tolist())
            codes = np.array([seen.setdefault(w, len(seen)) for w in spelled], np.int64)
        else:
            padded = np.zeros((len(members), -(-length // 8) * 8), np.uint8)
            padded[:, :length] = _at(data, starts[members], length)
            codes = np.zeros(len(members), np.int64)
            for column in padded.view(np.uint64).T:
                more, values = pd.factorize(np.ascontiguousarray(column))
                codes = pd.factorize(codes * len(values) + more)[0]
        numbers[members] = known + codes
        one = np.empty(int(codes.max()) + 1, np.int64)
        one[codes] = members
        firsts.append(one)
        known += len(one)
    return numbers, np.concatenate(firsts) if firsts else np.empty(0, np.int64)


def feature_crcs(data: np.ndarray, pieces: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """CRC-32 of features that consist of words joined by a blank.

    ``pieces`` holds starts and lengths of the first words, then of the second ones if there are any.
    """
    total = sum(lengths for _, lengths in pieces) + (len(pieces) - 1)
    crcs = np.empty(len(total), np.uint32)
    wide = np.where(total > WIDE, -(-total // ROW) * ROW, 0)
    for size, members in _groups(np.where(wide > 0, -wide, total)):
        width = abs(size)
        matrix = np.zeros((len(members), width), np.uint8)
        for shape, same in _shapes(pieces, members):
            at = width - (sum(shape) + len(shape) - 1)
            front = at
            for (starts, _), length in zip(pieces, shape, strict=True):
                if at > front:
                    matrix[same, at] = ord(" ")
                    at += 1
                matrix[same, at : at + length] = _at(data, starts[members[same]], length)
                at += length
            if size < 0:
                matrix[same, front : front + 4] ^= np.uint8(0xFF)
        if size < 0:
            crcs[members] = wide_crcs(matrix)
        else:
            state = np.full(len(members), _ONES)
            crcs[members] = updated(np.ascontiguousarray(matrix.T), state) ^ _ONES
    return crcs


def _shapes(pieces: list[tuple[np.ndarray, np.ndarray]], members: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
    """The lengths of the words of features, and which of ``members`` have them."""
    for first, places in _groups(pieces[0][1][members]):
        if len(pieces) == 1:
            yield [first], places
            continue
        for second, inner in _groups(pieces[1][1][members[places]]):
            yield [first, second], places[inner]


def _word_end(text: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that is not inside a word."""
    while at < len(text):
        outside = np.flatnonzero(~_WORD[text[at : at + ROW]])
        if len(outside):
            return at + int(outside[0])
        at += ROW
    return len(text)


def blocks(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of the texts, as data, starts and lengths of words, the text of each, and whether a
    word stands for the one before only: it ended the text's part in the block before."""
    parts: list[np.ndarray] = []
    rows: list[int] = []
    carried: list[bool] = []
    size, gap = 0, np.zeros(1, np.uint8)

    def made():
        data = _LOWER[np.concatenate([p for part in parts for p in (part, gap)])]
        starts, ends = word_spans(data)
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        part = np.searchsorted(begins, starts, side="right") - 1
        again = np.zeros(len(starts), bool)
        for k in np.flatnonzero(carried):
            again[np.searchsorted(starts, begins[k])] = True
        return data, starts, ends - starts, np.array(rows, np.int64)[part], again

    for row, text in enumerate(texts):
        at, last = 0, None
        while at < len(text):
            end = _word_end(text, at + BLOCK_BYTES)
            part = text[at:end] if last is None else np.concatenate([last, gap, text[at:end]])
            parts.append(part)
            rows.append(row)
            carried.append(last is not None)
            size += len(part)
            at = end
            if at < len(text):
                starts, ends = word_spans(part)
                last = part[starts[-1] : ends[-1]].copy() if len(starts) else None
            if size >= BLOCK_BYTES:
                yield made()
                parts, rows, carried, size = [], [], [], 0
    if parts:
        yield made()


def feature_buckets(texts: list[np.ndarray], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per block: the text and the bucket of every occurrence of a feature."""
    for data, starts, lengths, rows, again in blocks(texts):
        if not len(starts):
            continue
        numbers, one = distinct_words(data, starts, lengths)
        single = feature_crcs(data, [(starts[one], lengths[one])]) % np.uint32(buckets)
        neighbours = np.flatnonzero(rows[1:] == rows[:-1])
        codes, pairs = pd.factorize(numbers[neighbours] * len(one) + numbers[neighbours + 1])
        left, right = one[pairs // len(one)], one[pairs % len(one)]
        double = feature_crcs(
            data, [(starts[left], lengths[left]), (starts[right], lengths[right])]
        ) % np.uint32(buckets)
        fresh = ~again
        yield (
            np.concatenate([rows[fresh], rows[neighbours]]),
            np.concatenate([single[numbers][fresh], double[codes]]).astype(np.int64),
        )


# --- passes over the texts ---------------------------------------------------------


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; a row per bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in feature_buckets([text_bytes(t) for t in batch.column(0)], buckets):
                counts += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["bucket", "n"])

    partial = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    whole = np.zeros(buckets, np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        whole[r["bucket"]] = r["n"]
    return whole


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of smoothed shares, per bucket, in doubles."""
    buckets = len(raw)
    all_raw, all_target = int(raw.sum()) + buckets, int(target.sum()) + buckets
    return np.array(
        [
            math.floor(1000 * math.log(float((t + 1) * all_raw) / float((s + 1) * all_target)))
            for s, t in zip(raw.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weigh(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features and weight, the floored mean gain of the features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, summed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, found in feature_buckets([text_bytes(t) for t in batch.column(1)], len(gain)):
                n += np.bincount(rows, minlength=batch.num_rows)
                # whole numbers far below 2 ** 53
                summed += np.bincount(rows, gain[found], batch.num_rows).astype(np.int64)
            weight = summed // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(weight)], ["doc_id", "n_features", "weight"]
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(score, "doc_id long, n_features long, weight long")


def _with_ranks(rows: DataFrame, drawn: int) -> DataFrame:
    """``rows`` with the rank of the ``drawn`` best, null for others.

    One range shuffle: a row's number within its sorted slice comes with the write, and what lies before the slice
    from one row per slice. The last sorting column is unique, so equal scores of equal ids are cut as well.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    number = F.monotonically_increasing_id()  # task in the upper bits, row in the lower 33
    numbered = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", number)
    ).withColumns({"slice": F.shiftright("number", 33), "place": F.expr("number & 8589934591L")})
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (  # as many rows as shuffle partitions at most
        numbered.groupBy("slice")
        .agg(F.count("*").alias("size"))
        .select("slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    )
    rank = F.col("before") + F.col("place") + 1
    return numbered.join(F.broadcast(before), "slice").withColumn("rank", F.when(rank <= drawn, rank))


def draw(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = DRAWN_PERCENT,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``.

    Ranks from 1 go to the drawn rows: ``percent`` of those with ``least_words`` words or more.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    scored = stage(
        weigh(docs, id_col, text_col, gain)
        .withColumn("score", F.col("weight") + noise)
        .withColumn("tie", F.monotonically_increasing_id())
    )
    # n words make 2 n - 1 features
    enough = F.col("n_features") >= 2 * max(least_words, 1) - 1
    chosen = scored.where(enough) if least_words > 0 else scored
    ranked = _with_ranks(chosen, percent * chosen.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    if least_words <= 0:
        return ranked.select(*columns)
    others = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(others.select(*columns))
