"""Vector code compression: product codes of integer vectors, with exact searches pruned by pivots.

Vectors are scaled to integers and cut into parts; each part position has a codebook of
``entries`` integer entries, fitted in a fixed number of rounds over all vectors and used to code them.

LAESA pivots: each part position gets a few fixed pivots, spread entries of its first codebook.
The distances of every part to its pivots are computed once, when the vectors are staged. In
a round the few distances between pivots and entries are computed anew, and the greatest difference
|d(part, pivot) - d(entry, pivot)| is a lower bound of d(part, entry). Entries are tried in
the order of their bounds, and a part is done as soon as the next bound exceeds its
best distance. Bounds are floating point and lowered by a margin; the distances that decide are integers, and equal
ones go to the entry of least index.

A round is one pass over the staged vectors. Tasks send sums and counts per entry, at most one row per entry
and component, and these are folded before they reach the driver, which holds the codebooks
alone. Nothing is sampled.

Defined results: a vector that is null, or has a component that is null, not finite or
beyond 64 bits as an integer, is dropped; so is a vector whose length is not the most frequent
one (the greater of equally frequent ones). Rows that repeat count each. Rows without a vec_id are coded, but come after all
others for the first codebooks. With fewer vectors than entries the codebooks are that small.
A length that the parts do not divide gives the first parts one component less than the last. Errors beyond 64 bits are null.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.sources.staging import stage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
PIVOTS = 3
BATCH_ROWS = 4096
BROADCAST_ROWS = 500_000
MARGIN = 1e-9  # of the distances in a bound, far above their rounding error

#: Codebooks: by part, then entry, then component.
Codebooks = list[list[list[int]]]


def edges(size: int, parts: int) -> list[int]:
    """Where parts begin and end."""
    return [size * k // parts for k in range(parts + 1)]


# --- exact nearest entries ------------------------------------------------------


def _integers(values, width: int, largest: int = 0) -> np.ndarray:
    """Rows of integers: of 64 bits if squared distances between them and values up to
    ``largest`` fit, else Python's own."""
    rows = np.array(values, object).reshape(len(values), width)
    span = max([largest, *map(abs, rows.ravel().tolist())])
    return rows.astype(np.int64) if (2 * span) ** 2 * max(width, 1) < 1 << 62 else rows


def _largest(points: np.ndarray) -> int:
    return max(abs(int(points.max())), abs(int(points.min()))) if points.size else 0


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    difference = points - entries
    return (difference * difference).sum(axis=1)


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points to pivots: differences are exact, their roots floating point."""
    away = (points[:, None, :] - pivots[None]).astype(np.float64)
    return np.sqrt((away * away).sum(axis=2))


def nearest(
    points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of each point, and how many were evaluated."""
    n, k = len(points), len(entries)
    of_entries = pivot_distances(entries, pivots)
    bound, widest = np.zeros((n, k)), np.zeros((n, k))
    for p in range(to_pivots.shape[1]):
        left, right = to_pivots[:, p, None], of_entries[None, :, p]
        np.maximum(bound, np.abs(left - right), out=bound)
        np.maximum(widest, left + right, out=widest)
    bound -= MARGIN * (widest + 1)
    order = np.argsort(bound, axis=1, kind="stable")
    rows = np.arange(n)
    index = order[:, 0].copy() if k else np.zeros(n, np.int64)
    best = distances(points, entries[index])
    evaluated = n
    for step in range(1, k):
        # bounds only grow along the order: a row that is done stays done
        candidate = order[rows, step]
        reach = np.sqrt(best[rows].astype(np.float64)) * (1 + MARGIN)
        going = bound[rows, candidate] <= reach
        rows, candidate = rows[going], candidate[going]
        if not len(rows):
            break
        found = distances(points[rows], entries[candidate])
        evaluated += len(rows)
        now = best[rows]
        better = (found < now) | ((found == now) & (candidate < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], candidate[better]
    return index, best, evaluated


# --- passes over the staged vectors ----------------------------------------------


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and integer components of the vectors that take part, of one length."""
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    fits = F.forall(
        F.col(vector_col),
        lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(2.0**63 / SCALE)),  # NaN is greater than all
    )
    kept = vectors.where(F.col(vector_col).isNotNull() & fits).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), scaled.alias("x")
    )
    return stage(kept)


def _usual_length(kept: DataFrame) -> int:
    lengths = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size"))
    found = lengths.first()
    return found["size"] if found else 0


def first_codebooks(kept: DataFrame, size: int, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    cuts = edges(size, parts)
    return [[list(r["x"][a:b]) for r in rows] for a, b in zip(cuts, cuts[1:], strict=False)]


def spread_pivots(codebook: list[list[int]], number: int) -> list[list[int]]:
    """Entries that are far from each other: each the farthest from those before it."""
    points = np.array(codebook, np.float64).reshape(len(codebook), -1)
    chosen = [0]
    nearest_chosen = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(number, len(points)):
        chosen.append(int(nearest_chosen.argmax()))
        nearest_chosen = np.minimum(nearest_chosen, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return [codebook[i] for i in chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_pivot_distances(kept: DataFrame, pivots: Codebooks, size: int) -> DataFrame:
    """``kept`` with the distances of each part to its pivots, by part."""
    cuts = edges(size, len(pivots))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            x = _matrix(batch.column("x"))
            largest, away = _largest(x), []
            for a, b, own in zip(cuts, cuts[1:], pivots, strict=False):
                own = _integers(own, b - a, largest)
                away.append(pivot_distances(x[:, a:b].astype(own.dtype), own))
            flat = np.concatenate(away, axis=1)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "to_pivots"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(measure, f"vec_id long, label {label}, x array<long>, to_pivots array<double>")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def _assigned(batch: pa.RecordBatch, codebooks: Codebooks, pivots: Codebooks):
    """Per part: its components, and index and squared distance of the nearest entries."""
    x, away = _matrix(batch.column("x")), _matrix(batch.column("to_pivots"))
    cuts, largest, at = edges(x.shape[1], len(codebooks)), _largest(x), 0
    for part, (codebook, fixed) in enumerate(zip(codebooks, pivots, strict=True)):
        start, end = cuts[part : part + 2]
        both = _integers(codebook + fixed, end - start, largest)
        entries, anchors = both[: len(codebook)], both[len(codebook) :]
        points = x[:, start:end].astype(both.dtype)
        index, best, _ = nearest(points, away[:, at : at + len(fixed)], entries, anchors)
        at += len(fixed)
        yield part, points, index, best


SUMS = "part int, entry int, place int, total decimal(38,0), n long"


def refined(measured: DataFrame, codebooks: Codebooks, pivots: Codebooks) -> Codebooks:
    """Each entry replaced by the floored mean of its parts; entries without parts stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], tuple[list[int], int]] = {}
        for batch in _sliced(batches):
            for part, points, index, _ in _assigned(batch, codebooks, pivots):
                for entry in np.unique(index).tolist():
                    own = points[index == entry]
                    before, n = totals.get((part, entry), ([0] * own.shape[1], 0))
                    added = own.astype(object).sum(axis=0) if own.dtype == object else _exact_sum(own)
                    totals[part, entry] = ([a + int(b) for a, b in zip(before, added, strict=True)], n + len(own))
        rows = [(p, e, i, Decimal(v), n) for (p, e), (s, n) in totals.items() for i, v in enumerate(s)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            ["part", "entry", "place", "total", "n"],
        )

    folded = (
        measured.select("x", "to_pivots")
        .mapInArrow(sums, SUMS)
        .groupBy("part", "entry", "place")
        .agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))
    )
    new = [[list(entry) for entry in book] for book in codebooks]
    for r in folded.collect():  # one row per entry and component
        new[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    return new


def _exact_sum(values: np.ndarray) -> np.ndarray:
    """Column sums; 64 bits hold those of a slice, since their squares fit as well."""
    return values.sum(axis=0, dtype=np.int64)


CODES = "vec_id long, label {label}, code string, error long"


def coded(measured: DataFrame, codebooks: Codebooks, pivots: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and error of every vector."""
    label = measured.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            indexes = np.zeros((batch.num_rows, len(codebooks)), np.int64)
            errors: list[int] = [0] * batch.num_rows
            for part, _, index, best in _assigned(batch, codebooks, pivots):
                indexes[:, part] = index
                errors = [a + b for a, b in zip(errors, best.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array(["".join(f"{i:02x}" for i in row) for row in indexes.tolist()], pa.string()),
                    pa.array([e if e < 1 << 63 else None for e in errors], pa.int64()),
                ],
                ["vec_id", "label", "code", "error"],
            )

    return measured.mapInArrow(code, CODES.format(label=label))


def codebooks_digest(codebooks: Codebooks) -> str:
    """Lowercase hex SHA-256 of all components by part, entry and place, joined by commas."""
    listed = ",".join(str(v) for book in codebooks for entry in book for v in entry)
    return hashlib.sha256(listed.encode()).hexdigest()


def compress(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
) -> tuple[DataFrame, Codebooks]:
    """Codes of all kept vectors (vec_id, label, code, error, label_error), and the codebooks.

    ``entries`` may be up to 256, as a code has two hex digits a part.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError(f"1 to 256 entries and at least one part, not {entries} and {parts}")
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    size = _usual_length(kept)
    kept = kept.where(F.size("x") == size)
    codebooks = first_codebooks(kept, size, parts, entries)
    if not codebooks[0]:
        empty = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.withColumn("label_error", F.col("error")), codebooks
    fixed = [spread_pivots(book, pivots) for book in codebooks]
    measured = stage(with_pivot_distances(kept, fixed, size))
    for _ in range(rounds):
        codebooks = refined(measured, codebooks, fixed)
    return _with_label_errors(stage(coded(measured, codebooks, fixed))), codebooks


def _with_label_errors(codes: DataFrame) -> DataFrame:
    """Errors summed by label. A hot label is folded in its tasks; few labels are broadcast."""
    by_label = stage(
        codes.groupBy(F.col("label").alias("_label")).agg(F.expr("try_sum(error)").alias("label_error"))
    )
    if by_label.count() <= BROADCAST_ROWS:
        by_label = F.broadcast(by_label)
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error")
