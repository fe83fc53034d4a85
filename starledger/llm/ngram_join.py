"""N-gram Jaccard join by parity sketches, and its connected components.

Texts become sets of hashed word shingles; equal sets form one class. A class of n
shingles gets a sketch of k blocks: each shingle falls into one block by its hash, and
the block's word is the XOR of the hashes that fell there. A shingle that
only one of two sets has changes one block at most, so the number of blocks that
differ is a lower bound of the symmetric difference. Sets of a Jaccard similarity of t
or more, the smaller with a shingles, differ in at most d = (1 - t) / t * a shingles.
Within a band of sizes, d is fixed by the largest a, and k is so large that sets of the band fill
clearly more than d blocks. Of the first d + 1 filled blocks of the set that ends earlier one is
equal in the other and among its first ones too: these blocks are the join keys (pigeonhole), with
some to spare, and pairs that share a key are verified on their whole sets.

Pairs whose bit sketches (parities of hashed positions) differ in more bits than the threshold
allows are dropped before that: the Hamming distance is a lower bound of the symmetric difference, too.

How nothing is lost where keys are crowded: similar classes with m and m' keys agree
in at least max(m, m') - d of them. Keys shared by more than ``CROWD`` classes are left out by those classes that
have at most m - d - 1 such keys, which leaves an agreeing key; other
classes keep all of theirs (true groups of near copies do). A class with m <= d gets one more key
of its band, the only case in which just empty blocks may agree; fewer than one random set in a thousand
is of that kind, in any band, at thresholds of 80 % and above. The pivot of a key, the class that shares most with others, is compared
with all its members (a star). Stars whose members are then still in different components are
compared chunk by chunk inside tasks, and only pairs of different components that
their sketches allow are verified. So every pair of a key is verified, ruled out or already
connected, and all components are exact without the pairs of a group as rows.

Null text and text without words: an empty set, linked with nothing. Rows
without an id are not linked. Repeated rows are copies of one document. Set elements
are 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.text_hashes import BASE, mix64, text_bytes, word_hashes
from starledger.sources.staging import stage

CROWD = 64
CHUNK = 2048
SLICE_BYTES = 128  # of bit sketches that are unpacked at a time
BAND_RATIO = 1.5
SURE = 4.5  # standard deviations that the filled blocks of a band's least sets lie above d
BROADCAST_ROWS = 500_000
ROWS_AT_ONCE = 500
TOLD_CLASSES = 200_000


def shingle_set(data: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of the whole if it has fewer."""
    hashes = word_hashes(data)
    n = min(words, len(hashes))
    if not n:
        return hashes
    rolled = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        rolled = rolled * BASE + hashes[i : len(hashes) - n + 1 + i]
    return np.unique(mix64(rolled + np.uint64(n)))


def _class_of(shingles: np.ndarray) -> int:
    digest = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return digest - (1 << 64) if digest >> 63 else digest


# --- sketches ------------------------------------------------------------------


def _filled(n: int, blocks: int) -> float:
    """Blocks that n random shingles fill, less ``SURE`` standard deviations."""
    load = n / blocks
    empty = np.exp(-load)
    return blocks * (1 - empty) - SURE * np.sqrt(blocks * empty * max(0.0, 1 - (1 + load) * empty))


class Bands:
    """Size bands for a threshold in percent: least size, allowed difference, blocks."""

    def __init__(self, percent: int):
        self.percent = percent
        least = -(-percent // (100 - percent))  # below it only equal sets link
        self.edges = [least]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND_RATIO)))
        self.allowed = [(100 - percent) * (u - 1) // percent for u in self.edges[1:]]
        self.most_keys = [d + 3 + d // 16 for d in self.allowed]
        self.blocks = []
        for least, above, d in zip(self.edges, self.edges[1:], self.allowed):
            blocks = d + 1
            while _filled(least, blocks) < d + 1 and blocks < 4 * above:
                blocks += max(1, blocks // 50)
            self.blocks.append(blocks)

    def of(self, n: int) -> list[int]:
        """Own band, and the one before if a smaller partner may be there."""
        band = int(np.searchsorted(self.edges, n, side="right")) - 1
        if band < 0:
            return []
        smaller = -(-self.percent * n // 100)
        return [band, band - 1] if band and smaller < self.edges[band] else [band]


def sketch_keys(shingles: np.ndarray, band: int, bands: Bands) -> tuple[np.ndarray, int]:
    """Join keys of a band (the band in the low 8 bits) and how many may be left out."""
    k, d = bands.blocks[band], bands.allowed[band]
    block = shingles % np.uint64(k)
    narrow = block.astype(np.uint16 if k < 1 << 16 else np.int64)
    order = np.argsort(narrow, kind="stable")
    sizes = np.bincount(narrow, minlength=k)
    full = np.flatnonzero(sizes)[: bands.most_keys[band]]
    firsts = (np.cumsum(sizes) - sizes)[full]
    in_order = shingles[order[: firsts[-1] + sizes[full[-1]]]]
    words = np.bitwise_xor.reduceat(in_order, firsts)
    salt = mix64((full + 1).astype(np.uint64) * BASE + np.uint64(band))
    keys = mix64(words ^ salt)
    if len(full) <= d:
        keys = np.append(keys, mix64(np.array([band + 1], np.uint64)))
    low = np.uint64(0xFF)
    return (keys & ~low) | np.uint64(band), len(full) - d - 1


def bit_sketch(shingles: np.ndarray) -> bytes:
    """A bit sketch: bit i is the parity of the shingles that hash to i.

    Of a power of two bits, two a shingle or more, so few shingles meet. Halves can be XORed to
    get the sketch with half as many bits. Two sketches differ in at most as many bits
    as shingles that only one of the sets has.
    """
    bits = 1 << max(8, (2 * len(shingles) - 1).bit_length())
    place = (mix64(shingles) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1).tobytes()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer rows at a time, as their sets take more room than their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


SETS = (
    "doc_id long, n long, h long, band long, spare long, spare_before long, keys array<long>,"
    " bits binary"
)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Set size, class (hash of the set), spare keys, keys and bit sketch of every document.

    A task gives the keys of a class once, with the first of its documents.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, told = Bands(percent), set()
        for batch in _sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingle_set(text_bytes(text), words)
                row = [doc_id, len(found), _class_of(found), None, None, None, None, None]
                if not len(found):
                    row[2] = None
                elif doc_id is not None and row[2] not in told:
                    if len(told) > TOLD_CLASSES:  # telling a class twice does no harm
                        told.clear()
                    told.add(row[2])
                    made = [sketch_keys(found, band, bands) for band in bands.of(len(found))]
                    if made:
                        row[3] = bands.of(len(found))[0]
                        row[4], row[5] = made[0][1], made[-1][1]
                        row[6] = np.concatenate([keys for keys, _ in made]).view(np.int64)
                        row[7] = bit_sketch(found)
                rows.append(row)
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                [f.split()[0] for f in SETS.split(", ")],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(make, SETS)


def whole_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Class and shingles of each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = [shingle_set(text_bytes(t), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_class_of(s) for s in found], pa.int64()),
                    pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
                ],
                ["h", "shingles"],
            )

    return docs.select(F.col(text_col).alias("text")).mapInArrow(make, "h long, shingles array<long>")


# --- components ----------------------------------------------------------------


def connect(edges: DataFrame) -> DataFrame:
    """(h, label) for every node of (a, b) edges: the smallest node of its component.

    Smallest labels travel along edges and labels are replaced by their own label,
    until none changes; every step is written out.
    """
    both = stage(edges.union(edges.select("b", "a")).toDF("a", "b"))
    now = stage(
        both.groupBy(F.col("a").alias("h")).agg(F.min("b").alias("label"))
        .withColumn("label", F.least("h", "label"))
    )
    while True:
        heard = both.join(now, both["b"] == now["h"]).groupBy("a").agg(F.min("label").alias("heard"))
        lower = stage(
            now.join(heard, now["h"] == heard["a"]).select(
                "h", F.least("label", "heard").alias("next"), "label"
            )
        )
        up = lower.select(F.col("h").alias("next"), F.col("next").alias("upper"))
        jumped = stage(lower.join(up, "next").select("h", F.col("upper").alias("next"), "label"))
        changed = not jumped.where("next <> label").isEmpty()
        now = jumped.select("h", F.col("next").alias("label"))
        if not changed:
            return now


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after more edges: only the components that the edges join are connected anew."""
    own = labels.withColumnRenamed("h", "node")
    between = (
        edges.join(own.toDF("a", "left"), "a", "left")
        .join(own.toDF("b", "right"), "b", "left")
        .select(F.coalesce("left", "a").alias("a"), F.coalesce("right", "b").alias("b"))
    )
    joined = connect(between.where("a <> b").distinct())
    joined = joined.select(F.col("h").alias("label"), F.col("label").alias("lower"))
    new = joined.select(F.col("label").alias("h"), F.col("lower").alias("label"))
    return stage(
        labels.join(joined, "label", "left")
        .select("h", F.coalesce("lower", "label").alias("label"))
        .union(new.join(labels, "h", "left_anti"))
    )


def _shared_keys(sets: DataFrame) -> DataFrame:
    """(key, h, crowd) for keys of more than one class, crowded ones left out where allowed."""
    told = sets.where("keys IS NOT NULL")
    shared = stage(
        told.select(F.explode("keys").alias("key"), "h")
        .withColumns(
            {
                name: F.expr(f"{f}(h) OVER (PARTITION BY key)")
                for name, f in (("least", "min"), ("most", "max"), ("crowd", "count"))
            }
        )
        .where("least <> most")
        .select("key", "h", "crowd")
        .distinct()
    )
    crowded = shared.where(F.col("crowd") > CROWD).withColumn("in_band", F.expr("key & 255"))
    spare = told.select("h", "band", "spare", "spare_before").dropDuplicates(["h"])
    keepers = stage(
        crowded.groupBy("h", "in_band")
        .agg(F.count("*").alias("crowded"))
        .join(spare, "h")
        .where("crowded > IF(in_band = band, spare, spare_before)")
        .select("h", "in_band")
    )
    kept = crowded.join(keepers, ["h", "in_band"], "left_semi").select("key", "h", "crowd")
    return stage(shared.where(F.col("crowd") <= CROWD).union(kept))


def _stars(keys: DataFrame) -> DataFrame:
    """(pivot, h): the members of the keys of each pivot, the class that shares most with others."""
    weight = stage(keys.groupBy("h").agg(F.sum("crowd").alias("weight")))
    pivots = stage(
        keys.join(weight, "h")
        .groupBy("key")
        .agg(F.max(F.struct("weight", "h")).alias("pivot"))
        .select("key", F.col("pivot.h").alias("pivot"))
    )
    return keys.join(pivots, "key").where("h <> pivot").select("pivot", "h").distinct()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes from one of a multiple of it."""
    whole = np.frombuffer(bits, np.uint8).reshape(-1, size)
    return np.bitwise_xor.reduce(whole, axis=0)


def near_enough(sizes_a, sizes_b, differing, percent: int):
    """Whether so many differing bits leave room for the threshold."""
    return (100 + percent) * differing <= (100 - percent) * (sizes_a + sizes_b)


PAIRS = "a long, b long"


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that the bit sketches do not rule out."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, left, right = (c.to_pylist() for c in batch.columns)
            kept = []
            for i in range(len(a)):
                size = min(len(left[i]), len(right[i]))
                differing = folded(left[i], size) ^ folded(right[i], size)
                differing = int(np.bitwise_count(differing).sum())
                kept.append(near_enough(n[i], m[i], differing, percent))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    first = classes.select(F.col("h").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    second = classes.select(F.col("h").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    both = pairs.join(first, "a").join(second, "b")
    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(keep, PAIRS)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose whole sets are similar enough."""
    first = sets.select(F.col("h").alias("a"), F.col("shingles").alias("left"))
    second = sets.select(F.col("h").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(first, "a").join(second, "b")
    inter = F.size(F.array_intersect("left", "right")).cast("long")
    union = F.size("left") + F.size("right") - F.col("inter")
    return both.withColumn("inter", inter).where(100 * F.col("inter") >= percent * union).select("a", "b")


def _open_stars(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """(pivot, h, label) of the stars whose members are in several components."""
    labelled = (
        stars.join(labels, "h", "left")
        .select("pivot", "h", F.coalesce("label", "h").alias("label"))
    )
    several = stage(
        labelled.groupBy("pivot")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("size"))
        .where("least <> most")
        .select("pivot", "size")
    )
    return labelled.join(several, "pivot")


def _pairs_of_stars(members: DataFrame, classes: DataFrame, percent: int, only_best: bool) -> DataFrame:
    """Pairs of members in different components that the bit sketches do not rule out.

    Stars are cut into chunks, and chunks are compared with each other in tasks, by products
    of bit matrices; just possible pairs leave a task. ``only_best`` gives a member its nearest partner in
    a chunk alone, for a first step that connects most components.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != last and group:
                    yield _chunk_pairs(group, percent, only_best)
                    group = []
                last = row[:3]
                group.append(row[3:])
        if group:
            yield _chunk_pairs(group, percent, only_best)

    chunks = F.floor(F.col("size") / CHUNK) + 1
    cut = (
        members.withColumn("own", F.pmod(F.xxhash64("h"), chunks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        .select(
            "pivot",
            F.least("own", "other").alias("first"),
            F.greatest("own", "other").alias("second"),
            "own",
            "h",
            "label",
        )
        .join(classes, "h")
        .select("pivot", "first", "second", "own", "h", "label", "n", "bits")
    )
    place = ["pivot", "first", "second"]
    dealt = cut.repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(compare, PAIRS)


def _chunk_pairs(group: list[tuple], percent: int, only_best: bool) -> pa.RecordBatch:
    """Possible pairs between the two chunks of a group, or inside its one chunk."""
    own, h, label, n, bits = zip(*group, strict=True)
    own, h, label, n = (np.array(x, np.int64) for x in (own, h, label, n))
    size = min(map(len, bits))
    packed = np.stack([folded(b, size) for b in bits])
    low, high = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
    ones = np.bitwise_count(packed).sum(1, dtype=np.int64).astype(np.float32)
    shared = np.zeros((len(low), len(high)), np.float32)  # whole numbers below 2 ** 24
    for at in range(0, size, SLICE_BYTES):
        part = np.unpackbits(packed[:, at : at + SLICE_BYTES], axis=1).astype(np.float32)
        shared += part[low] @ part[high].T
    differing = ones[low][:, None] + ones[high][None] - 2 * shared
    del shared
    possible = near_enough(n[low][:, None], n[high][None], differing, percent)
    possible &= label[low][:, None] != label[high][None]
    if only_best:
        differing[~possible] = np.inf
        best = np.zeros_like(possible)
        best[np.arange(len(low)), differing.argmin(1)] = True
        best[differing.argmin(0), np.arange(len(high))] = True
        possible &= best
    i, j = np.nonzero(possible)
    a, b = h[low][i], h[high][j]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def jaccard_components(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) per row of ``docs``."""
    sets = stage(sketches(docs, id_col, text_col, words, percent))
    narrow = sets.select("doc_id", "n", "h")
    firsts = stage(
        narrow.where("h IS NOT NULL AND doc_id IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("first"))
    )
    keys = _shared_keys(sets)
    stars = stage(_stars(keys))
    involved = stars.select("h").union(stars.select("pivot")).distinct()
    classes = stage(
        sets.where("bits IS NOT NULL").join(involved, "h", "left_semi")
        .groupBy("h").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    )
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among possible pairs; the texts of their classes are read again."""
        wanted = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
        wanted = stage(wanted.join(firsts, "h").select(F.col("first").alias("_first")))
        chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        read = texts.join(chosen, F.col("_id") == F.col("_first"), "left_semi")
        return stage(_linked(pairs, stage(whole_sets(read, "_id", "_text", words)), percent))

    to_pivots = stars.select(F.least("pivot", "h").alias("a"), F.greatest("pivot", "h").alias("b"))
    tested = stage(_possible(to_pivots.distinct(), classes, percent))
    labels = connect(verified(tested))
    for only_best in (True, False):
        # Members of a star are compared with each other where they are in different components:
        # first each with the nearest alone, then all that are still apart.
        members = _open_stars(stars, labels)
        pairs = stage(
            _pairs_of_stars(members, classes, percent, only_best)
            .distinct()
            .join(tested, ["a", "b"], "left_anti")
        )
        if pairs.isEmpty():
            continue
        found = verified(pairs)
        tested = tested.union(pairs)
        if not found.isEmpty():
            labels = relabelled(labels, found)
    return _with_components(narrow, firsts, labels)


def _with_components(narrow: DataFrame, firsts: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document with the smallest id of its class's component.

    The table to join is written out, so a class that most documents are of can be split.
    """
    labelled = stage(
        firsts.join(labels, "h", "left").select("h", "first", F.coalesce("label", "h").alias("label"))
    )
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component"))
    components = stage(labelled.join(smallest, "label").select("h", "component"))
    return narrow.join(components, "h", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
