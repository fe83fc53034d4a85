"""Benchmark decontamination by spaced seeds.

A mask picks some of ``span`` neighbouring words and ignores the others, so one hash still
meets its counterpart when ignored words were substituted. Hashes of every position of every
text are joined with those of the test items. A hit aligns both texts (word i of the item
with word i + shift of the text), and the window of ``window`` aligned words that agrees best
is sought; ``least_equal`` equal words make an overlap.
With the default masks every window with at most two substitutions has a seed that
is free of them (held by a test), so such overlaps are all found.

Words are runs of letters and digits in lower case, compared by 64-bit hashes. Null or empty text
has no hit. Items below ``span`` words cannot be told from chance and are not searched for; items
shorter than the window are compared as a whole, with one substitution allowed from ``span`` + 2
words on and none below. Repeated rows of a text or item give one result row. Rows with a null id are
reported under a null id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.expressions import let, total
from starledger.sources.staging import stage

# --- fixed values: masks; 1 picks a word, 0 ignores it --------------------------

MASKS = ("11001111", "11101011")
SPAN = len(MASKS[0])
WINDOW = 13
LEAST_EQUAL = 11
BROADCAST_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def seed(hashes: Column, at: Column, mask: str) -> Column:
    """The hash of the words that ``mask`` picks from position ``at`` (from 0) on."""
    picked = [F.get(hashes, at + i) for i, c in enumerate(mask) if c == "1"]
    return F.xxhash64(F.lit(mask), *picked)


def seeds(hashes: Column, masks: tuple[str, ...]) -> Column:
    """Seeds of all positions, mask after mask; none for fewer than ``SPAN`` words."""

    def of_all(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - SPAN)
        def of(mask: str) -> Column:
            return F.transform(starts, lambda i: seed(h, i, mask))

        return F.when(F.size(h) >= SPAN, F.concat(*map(of, masks)))

    return let(hashes, of_all)


def best_window(text: Column, item: Column, shift: Column, window: int) -> Column:
    """Equal words in the best window of the alignment of two lists of words."""

    def sums(equal: Column) -> Column:
        size = F.least(F.lit(window), F.size(equal))
        windows = F.sequence(F.lit(1), F.size(equal) - size + 1)
        return F.array_max(
            F.transform(windows, lambda w: total(F.slice(equal, w, size), F.lit(0)))
        )

    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(text) - shift) - 1
    equal = F.transform(
        F.sequence(first, last),
        lambda j: F.when(F.get(item, j) == F.get(text, j + shift), 1).otherwise(0),
    )
    return let(equal, sums)


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS,
    window: int = WINDOW,
    least_equal: int = LEAST_EQUAL,
) -> DataFrame:
    """(doc_id, item_id) pairs that overlap: equal_words (of the best window), first_word (of a hit).

    Only ids, places and seeds of texts are joined; the words of texts that have a hit are read again
    to verify each alignment once.
    """
    hashed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), word_hashes(F.col(text_col)).alias("words")
    )
    tests = stage(
        items.select(
            F.col(item_id_col).cast("long").alias("item_id"),
            word_hashes(F.col(item_text_col)).alias("item"),
        ).distinct()
    )
    wanted = stage(
        tests.select("item_id", F.size("item").alias("n"), F.posexplode(seeds(F.col("item"), masks)))
        .select("item_id", F.col("col").alias("seed"), F.expr(f"pos % (n - {SPAN - 1})").alias("item_at"))
        .distinct()
    )
    few = wanted.count() <= BROADCAST_ROWS
    probes = hashed.select(
        "doc_id", F.size("words").alias("n"), F.posexplode(seeds(F.col("words"), masks))
    ).select("doc_id", F.col("col").alias("seed"), F.expr(f"pos % (n - {SPAN - 1})").alias("at"))
    hits = stage(
        probes.join(F.broadcast(wanted) if few else wanted, "seed")
        .groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.min(F.col("at").cast("long")).alias("first_word"))
    )
    found = stage(hits.select(F.col("doc_id").alias("_hit")).distinct())
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    texts = stage(
        hashed.join(found, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_semi").distinct()
    )
    aligned = (
        hits.alias("h")
        .join(texts.alias("t"), F.col("h.doc_id").eqNullSafe(F.col("t.doc_id")))
        .join(tests.alias("i"), F.col("h.item_id").eqNullSafe(F.col("i.item_id")))
        .select("h.doc_id", "h.item_id", "first_word", "words", "item", "shift")
        .where((F.size("words") > F.col("shift")) & (F.size("item") > -F.col("shift")))
    )
    size = F.size("item")
    needed = (
        F.when(size >= window, least_equal).when(size >= SPAN + 2, size - 1).otherwise(size)
    )
    return (
        aligned.withColumn(
            "equal", best_window(F.col("words"), F.col("item"), F.col("shift"), window)
        )
        .where(F.col("equal") >= needed)
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("equal").cast("long").alias("equal_words"),
            F.min("first_word").alias("first_word"),
        )
    )


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Distinct ids of the rows of ``docs`` that overlap an item."""
    return find_overlaps(docs, items, **options).select("doc_id").distinct()
