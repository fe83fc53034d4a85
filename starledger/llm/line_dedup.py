"""Line dedup by a segment-partition edit join.

Lines (trimmed, of ``least_chars`` characters or more) that equal an earlier line, or come
within ``threshold`` edits of one, are removed; "earlier" is the order of (document id, line
number) of the first occurrence. Shorter lines always stay.

The join cuts every line into threshold + 1 even segments: two lines within the threshold share one of them
at nearly the same place. A line is indexed by its own segments (with its length and the
segment's number), and probes the segments of lines as long as itself or up to threshold shorter, at
just the places where such a segment may stand. Lines that share an entry are verified by a banded
bit-parallel edit distance.

Work on shared entries: entries are made once, from one occurrence of each distinct line. The earliest line of
an entry is compared with all others, which settles groups of near copies; lines that are still
unsettled meet ``STEP`` times as many earlier lines in each further round, until each was compared with
every earlier line of its entries. In these rounds a pair leaves the join only if its sketches allow it: the
parities of a line's hashed character pairs, of which an edit changes four at most, so that lines which
share a segment and little else, or differ from one base in places of their own, are ruled out by comparing a few
numbers. So many bits are kept that the pairs of characters in which such lines differ seldom hash to the same bit.
Hot lines are merged before they are joined. Lines and segments are compared by 64-bit hashes.

Null text stays null. Rows with a null id are neither changed nor compared. Rows that repeat an id and text
are one document: equal lines in them have one place and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.expressions import let
from starledger.sources.staging import stage

THRESHOLD = 2
LEAST_CHARS = 30
BROADCAST_ROWS = 500_000
STEP = 8
SKETCH_WORDS = 8  # of 64 bits each


def segments(length: Column, threshold: int, number: int) -> tuple[Column, Column]:
    """Place (from 1) and size of a segment, by number from 0, cut at even fractions of the length."""
    parts = threshold + 1
    start, end = (F.floor(length * k / parts).cast("int") for k in (number, number + 1))
    return start + 1, end - start


def entries(line: Column, length: Column, threshold: int) -> Column:
    """Hashes of a line's own segments and of its probes; ``length`` is a column with its length.

    For partners shorter by ``shorter``, segment i can only have moved so far that the edits
    before it and the edits behind it stay within the threshold.
    """
    found = []
    for shorter in range(threshold + 1):
        partner = length - shorter
        for i in range(threshold + 1):
            place, size = segments(partner, threshold, i)
            behind = threshold - i
            first = max(-i, shorter - behind)
            last = min(i, shorter + behind)
            for moved in range(first, last + 1):
                part = F.substring(line, place + moved, size)
                inside = (place + moved >= 1) & (place + moved + size - 1 <= length)
                found.append(F.when(inside, F.xxhash64(partner, F.lit(i), part)))
    return F.array_distinct(F.array_compact(F.array(*found)))


def common_prefix(left: Column, right: Column) -> Column:
    """How many characters two texts begin with in common (counted up to 2 ** 21 - 1).

    Blocks of falling powers of two are compared whole.
    """
    powers = F.array(*(F.lit(1 << k) for k in range(20, -1, -1)))

    def of(most: Column) -> Column:
        def longer(shared: Column, size: Column) -> Column:
            same = F.substring(left, shared + 1, size) == F.substring(right, shared + 1, size)
            return F.when((shared + size <= most) & same, shared + size).otherwise(shared)

        return F.aggregate(powers, F.lit(0), longer)

    return let(F.least(F.length(left), F.length(right)), of)


def without_common_ends(left: Column, right: Column) -> Column:
    """Both texts, as an array, without the beginning and the end that they share.

    Neither changes the distance, and what is left of near texts is short.
    """

    def cut(text: Column, size: Column) -> Column:
        return F.substring(text, size + 1, F.length(text))

    def fronts_cut(a: Column, b: Column) -> Column:
        return let(common_prefix(a, b), lambda k: F.array(F.reverse(cut(a, k)), F.reverse(cut(b, k))))

    return let(fronts_cut(left, right), lambda pair: fronts_cut(pair[0], pair[1]))


def within(left: Column, right: Column, threshold: int) -> Column:
    """Whether two texts are at most ``threshold`` edits apart.

    What both begin and end with is left out first. Only a band of 2 * threshold + 1 diagonals of the table matters. Its vertical differences
    are two bit words that move along the texts; a step compares one character with
    the band's characters and updates all cells of the band by word operations.
    """
    width = 2 * threshold + 1
    every, top = (1 << width) - 1, 1 << (width - 1)
    bits = F.array(*(F.lit(1 << b) for b in range(width)))
    ends = F.array(*(F.lit(top >> e) for e in range(threshold + 1)))

    def inverted(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(every))

    def run(long: Column, short: Column) -> Column:
        n, m = F.size(long), F.size(short)

        def step(state: Column, j: Column) -> Column:
            band = F.aggregate(
                F.sequence(F.lit(0), F.lit(width - 1)),
                F.lit(0),
                lambda word, b: word
                + F.when(
                    (j - threshold + b >= 0)
                    & (F.get(long, j - threshold + b) == F.get(short, j)),
                    F.get(bits, b),
                ).otherwise(0),
            )

            def updated(x: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                carried = ((x.bitwiseAND(vp) + vp).bitwiseAND(F.lit(every))).bitwiseXOR(vp)

                def rest(d0: Column) -> Column:
                    hp = vn.bitwiseOR(inverted(d0.bitwiseOR(vp)))
                    hn = d0.bitwiseAND(vp)
                    shifted = F.shiftright(d0, 1)
                    edge = F.greatest(F.lit(0), j - (n - threshold - 1))
                    horizontal = F.get(ends, edge)
                    across = F.when(hp.bitwiseAND(horizontal) != 0, 1).when(
                        hn.bitwiseAND(horizontal) != 0, -1
                    )
                    down = F.when(d0.bitwiseAND(F.lit(top)) == 0, 1)
                    moved = F.when(j < n - threshold, down).otherwise(across)
                    return F.struct(
                        hn.bitwiseOR(inverted(shifted.bitwiseOR(hp))).alias("vp"),
                        shifted.bitwiseAND(hp).alias("vn"),
                        (state["distance"] + F.coalesce(moved, F.lit(0))).alias("distance"),
                    )

                return let(carried.bitwiseOR(x).bitwiseOR(vn), rest)

            return let(band, updated)

        start = F.struct(
            F.lit(every & ~((1 << threshold) - 1)).alias("vp"),
            F.lit(0).alias("vn"),
            F.lit(threshold).alias("distance"),
        )
        walked = F.aggregate(F.sequence(F.lit(0), m - 1), start, step)["distance"]
        return (
            F.when(n - m > threshold, F.lit(False)).when(m == 0, F.lit(True)).otherwise(walked <= threshold)
        )

    def ordered(pair: Column) -> Column:
        longer = F.length(pair[0]) >= F.length(pair[1])
        first = F.when(longer, pair[0]).otherwise(pair[1])
        second = F.when(longer, pair[1]).otherwise(pair[0])
        walked = let(_characters(first), lambda a: let(_characters(second), lambda b: run(a, b)))
        return walked if threshold > 2 else F.when(may_be_near(first, second), walked).otherwise(False)

    def may_be_near(long: Column, short: Column) -> Column:
        """Both begin and end differently, so an edit is spent at either end: with two allowed, all
        between the first and the last character of one stands in the other as it is."""
        size = F.length(long)
        return (size <= 2) | F.contains(short, F.substring(long, F.lit(2), size - 2))

    return let(without_common_ends(left, right), ordered)


def _characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def pair_sketch(line: Column) -> Column:
    """``SKETCH_WORDS`` words of bits: each bit the parity of the pairs of neighbouring characters that hash to it.

    An edit takes away two such pairs and adds two at most, so lines within ``threshold`` edits differ in
    at most four times as many bits.
    """

    def flipped(word: Column, bit: Column) -> Column:
        return word.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64))))

    def words_of(bits: Column) -> Column:
        def word(number: int) -> Column:
            own = F.filter(bits, lambda bit: F.shiftright(bit, 6) == number)
            return F.aggregate(own, F.lit(0).cast("long"), flipped)

        return F.array(*map(word, range(SKETCH_WORDS)))

    def of(characters: Column) -> Column:
        after = F.slice(characters, 2, F.greatest(F.size(characters), F.lit(1)))
        bit = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(64 * SKETCH_WORDS)).cast("int")
        return let(F.zip_with(characters, after, bit), words_of)

    return let(_characters(line), of)


def sketch_distance(left: Column, right: Column) -> Column:
    """Number of bits in which two sketches differ."""
    differ = (F.bit_count(F.get(left, w).bitwiseXOR(F.get(right, w))) for w in map(F.lit, range(SKETCH_WORDS)))
    return sum(differ, F.lit(0))


def _lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """doc_id, line_no, line, line_id of every line that takes part."""
    line = F.trim("raw")
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
        .select("doc_id", "line_no", line.alias("line"))
        .where(F.length("line") >= least_chars)
        .select(
            "doc_id", "line_no", "line", F.xxhash64("line").alias("line_id"), F.length("line").alias("size")
        )
    )


def _limited(rows: DataFrame) -> DataFrame:
    """Hinted for broadcast if few enough, else left to a shuffle join."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _candidates(lines: DataFrame, firsts: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Members (entry, line_id, first) of entries shared by several lines, and those lines' texts.

    ``firsts`` has the first place and the number of occurrences of each line_id.
    """
    again = _limited(stage(firsts.where("n > 1").select("line_id", "first")))
    place = F.struct("doc_id", "line_no")
    distinct = lines.join(again, "line_id", "left").where(F.col("first").isNull() | (place == F.col("first")))
    listed = stage(
        distinct.select("line_id", F.explode(entries(F.col("line"), F.col("size"), threshold)).alias("entry"))
    )
    shared = stage(
        listed.groupBy("entry")
        .agg(F.min("line_id").alias("least"), F.max("line_id").alias("most"))
        .where("least <> most")
        .select("entry")
    )
    found = stage(listed.join(_limited(shared), "entry", "left_semi").distinct())
    involved = stage(found.select("line_id").distinct().join(firsts, "line_id").select("line_id", "first"))
    members = stage(found.join(involved, "line_id"))
    texts = stage(
        lines.join(_limited(involved), "line_id")
        .where((F.col("doc_id") == F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no")))
        .select("line_id", "line")
        .distinct()
    )
    return members, texts


def _near(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Ids of the later lines of (late, early) pairs that are near."""
    late = texts.select(F.col("line_id").alias("late"), F.col("line").alias("left"))
    early = texts.select(F.col("line_id").alias("early"), F.col("line").alias("right"))
    both = pairs.join(late, "late").join(early, "early")
    close = F.abs(F.length("left") - F.length("right")) <= threshold
    return (
        both.where(close & within(F.col("left"), F.col("right"), threshold))
        .select(F.col("late").alias("line_id"))
        .distinct()
    )


def near_lines(lines: DataFrame, firsts: DataFrame, threshold: int) -> DataFrame:
    """line_id of the lines that are near a line that occurs earlier."""
    members, texts = _candidates(lines, firsts, threshold)
    pivots = stage(
        members.groupBy("entry")
        .agg(F.min(F.struct("first", "line_id")).alias("pivot"))
        .select("entry", F.col("pivot.line_id").alias("early"))
    )
    tested = stage(
        members.join(pivots, "entry")
        .where("line_id <> early")
        .select(F.col("line_id").alias("late"), "early")
        .distinct()
    )
    near = stage(_near(tested, texts, threshold))
    sketches = None
    behind = 1  # every line was compared with that many earlier lines of each of its entries
    while True:
        order = "PARTITION BY entry ORDER BY first, line_id"
        marked = members.join(near.withColumn("settled", F.lit(True)), "line_id", "left")
        unsettled = stage(
            marked.groupBy("entry")
            .agg(
                F.count_if(F.col("settled").isNull()).alias("open"),
                F.min(F.struct("first", "line_id", F.col("settled").isNull().alias("open"))).alias("pivot"),
                F.count("*").alias("size"),
            )  # the pivot is open or settled itself; what counts are open lines besides it
            .where((F.col("open") > F.col("pivot.open").cast("long")) & (F.col("size") > behind + 1))
            .select("entry")
        )
        ranked = stage(
            marked.join(unsettled, "entry")
            .withColumn("rank", F.expr(f"row_number() OVER ({order})") - 1)
            .select("entry", "line_id", "rank", F.col("settled").isNull().alias("open"))
        )
        if ranked.where(F.col("open") & (F.col("rank") > behind)).isEmpty():
            return near
        if sketches is None:  # later rounds have no other lines
            open_lines = ranked.select("line_id").distinct()
            sketches = stage(
                texts.join(open_lines, "line_id", "left_semi").select("line_id", pair_sketch(F.col("line")).alias("bits"))
            )
        ranked = ranked.join(sketches, "line_id")
        early = ranked.where(F.col("rank").between(behind, STEP * behind)).select(
            "entry",
            F.col("line_id").alias("early"),
            F.col("rank").alias("early_rank"),
            F.col("bits").alias("early_bits"),
        )
        may_be_near = sketch_distance(F.col("bits"), F.col("early_bits")) <= 4 * threshold
        late = ranked.where("open").withColumnRenamed("entry", "late_entry")
        pairs = stage(
            late.join(
                early,
                (F.col("late_entry") == F.col("entry")) & (F.col("rank") > F.col("early_rank")) & may_be_near,
            )
            .select(F.col("line_id").alias("late"), "early")
            .distinct()
            .join(tested, ["late", "early"], "left_anti")
        )
        tested = stage(tested.union(pairs))
        near = stage(near.union(_near(pairs, texts, threshold)).distinct())
        behind = STEP * behind + 1


def repeated_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """doc_id and removed: the numbers of its lines (from 0, ascending) that repeat earlier ones."""
    lines = _lines(docs, id_col, text_col, least_chars)
    occurrences = stage(lines.select("doc_id", "line_no", "line_id"))
    firsts = stage(
        occurrences.groupBy("line_id").agg(
            F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")
        )
    )
    repeated = firsts.where("n > 1").select("line_id", "first")
    near = near_lines(lines, firsts, threshold)
    decided = stage(
        repeated.join(near.withColumn("near", F.lit(True)), "line_id", "full").select(
            "line_id", F.when(F.col("near").isNull(), F.col("first")).alias("stays")
        )
    )
    place = F.struct("doc_id", "line_no")
    return (
        occurrences.join(decided, "line_id")
        .where(F.col("stays").isNull() | (place != F.col("stays")))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    )


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    least_chars: int = LEAST_CHARS,
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and two further columns, n_lines and n_removed.

    ``counts`` gives these two other names; columns of ``docs`` that have the names are replaced.
    """
    removed = stage(
        repeated_lines(
            docs, id_col=id_col, text_col=text_col, threshold=threshold, least_chars=least_chars
        )
    ).select(F.col("doc_id").alias("__line_doc"), F.col("removed").alias("__line_gone"))
    gone = F.col("__line_gone")
    joined = docs.drop(*counts).join(
        _limited(removed), F.col(id_col).cast("long") == F.col("__line_doc"), "left"
    )
    lines = F.split(text_col, "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone, i)), "\n")
    return joined.select(
        *(
            F.when(gone.isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`")
            for c in docs.columns
            if c not in counts
        ),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(counts[1]),
    )
