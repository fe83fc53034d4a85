"""Quality rules: repetition and size rules, and divergence from language references.

Base metrics fail short and repetitive texts. The method's verdict compares two histograms of a
text, of character classes and of common words, with those of each language by the
Jensen-Shannon distance; a text stays if one language is near enough in both. Languages whose texts hold
almost none of the listed words are judged by character classes alone. The references
are the histograms of all texts of a language that pass the base rules; texts that are far from the first
references are left out of the second ones, which decide. Histograms of short texts are noise, so
a text below a least number of words or letters is not judged by them.

Null text is a text without words: all counts 0, base_failed. Rows are judged one by one, so
repeated rows get one verdict, and null ids are kept as they are. Without any row that has a language
there is no reference and the base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.expressions import SPACE, let, total, words
from starledger.sources.staging import stage

LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW = 8
JUDGED_WORDS = 50
JUDGED_CHARS = 250
MOST_CLASS_DISTANCE = 0.18
MOST_WORD_DISTANCE = 0.4
LEAST_LISTED = 0.05  # share of listed words in a language's texts, below which they do not judge it

# --- fixed values: character classes and common words of languages -------------

VOWELS = "aeiouy"
# Runs that are cut from a text one after the other; each pattern meets what those before it left.
PEELED = {
    "ascii_lower": "[a-z]+",
    "space": SPACE,
    "upper": r"\p{Lu}+",
    "other_lower": r"\p{Ll}+",
    "other_letter": r"\p{L}+",
    "digit": r"\p{N}+",
    "stop": "[.,;:!?'\"()-]+",
}
CHARACTER_CLASSES = [
    "vowel", "consonant", "other_lower", "upper", "other_letter", "digit", "stop", "space",
]
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in is that for it was with as be on by this are from at or",
    "es": "de la que el en y a los se del las un por con no una para es al lo",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec",
}
COMMON = sorted({w for line in COMMON_WORDS.values() for w in line.split()})


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Most texts have no equal windows, which one
    distinct shows; only others are sorted to find the positions.
    """

    def covered(hashes: Column) -> Column:
        at = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def positions(order: Column) -> Column:
            def repeated(s: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(order, i - 1)["h"] == s["h"])
                after = F.get(order, i + 1)["h"] == s["h"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.array_sort(F.transform(F.filter(order, repeated), lambda s: s["i"]))

        def width(p: Column) -> Column:
            gaps = F.zip_with(
                p,
                F.slice(p, 2, F.greatest(F.size(p), F.lit(1))),
                lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))),
            )
            return total(gaps, F.lit(0))

        return let(let(F.array_sort(at), positions), width)

    def paired(step: int) -> Callable[[Column], Column]:
        """From hashes of runs of ``step`` words those of runs twice as long."""

        def pairs(h: Column) -> Column:
            n = F.greatest(F.size(h) - step, F.lit(0))
            return F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + step, n), lambda a, b: F.xxhash64(a, b))

        return pairs

    def count(hashes: Column) -> Column:
        same = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(same, F.lit(0)).otherwise(covered(hashes))

    hashes, run = F.transform(found, lambda w: F.xxhash64(w)), 1
    while run < window:
        hashes = let(hashes, paired(min(run, window - run)))
        run *= 2
    return let(hashes, count)


def measure(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Base metrics and the two histograms (counts) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text")
    )
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    common = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w.isin(COMMON))
    spaced = F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" "))
    split = narrow.withColumns({"words": words(F.col("text")), "lines": lines, "common": spaced})
    split = split.withColumn("vowel", F.length(F.regexp_replace("text", f"[^{VOWELS}]+", "")))
    left = "text"
    for name, pattern in PEELED.items():
        split = split.withColumn(f"after_{name}", F.regexp_replace(left, pattern, ""))
        split = split.withColumn(name, F.length(left) - F.length(f"after_{name}"))
        left = f"after_{name}"
    split = split.withColumn("consonant", F.col("ascii_lower") - F.col("vowel"))
    symbols = F.length(left) - F.length(F.regexp_replace(left, "[#*$%&|<>]+", ""))
    commons = [_occurrences("common", w) for w in COMMON]
    return split.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.col("space")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.array(*CHARACTER_CLASSES).alias("classes"),
        F.array(*commons).alias("commons"),
    ).withColumns(
        {
            "classes": _with_rest("classes", F.col("n_chars")),
            "commons": _with_rest("commons", F.col("n_words")),
        }
    )


def _occurrences(listed: str, word: str) -> Column:
    """How often a word is in a list, given as text with a space on each side of every word."""
    without = F.replace(F.col(listed), F.lit(f" {word} "), F.lit(""))
    return ((F.length(listed) - F.length(without)) / (len(word) + 2)).cast("int")


def _with_rest(counts: str, whole: Column) -> Column:
    """The counts and, last, how much of the whole they leave."""
    longs = F.transform(counts, lambda c: c.cast("long"))
    rest = F.greatest(whole - total(longs, F.lit(0).cast("long")), F.lit(0).cast("long"))
    return F.concat(longs, F.array(rest))


def references(measured: DataFrame) -> list[tuple[list[float], list[float]]]:
    """Both histograms of each language, over all its texts (one row a language)."""
    sizes = {"classes": len(CHARACTER_CLASSES) + 1, "commons": len(COMMON) + 1}
    sums = {
        f"{name}_{i}": F.sum(F.col(name)[i]) for name, size in sizes.items() for i in range(size)
    }
    rows = (
        measured.where("lang IS NOT NULL")
        .groupBy("lang")
        .agg(*(c.alias(name) for name, c in sums.items()))
        .orderBy("lang")
        .collect()
    )
    shares = []
    for row in rows:
        both = [[row[f"{name}_{i}"] for i in range(size)] for name, size in sizes.items()]
        if all(sum(h) for h in both):
            shares.append(tuple([c / sum(h) for c in h] for h in both))
    return shares


def jensen_shannon(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of a histogram to a reference."""
    own = F.greatest(total(counts, F.lit(0).cast("long")), F.lit(1).cast("long"))

    def divergence(whole: Column) -> Column:
        def term(c: Column, q: Column) -> Column:
            p = c / whole
            middle = (p + q) / 2
            left = F.when(p > 0, p * F.log2(p / middle)).otherwise(F.lit(0.0))
            right = F.when(q > 0, q * F.log2(q / middle)).otherwise(F.lit(0.0))
            return (left + right) / 2

        terms = F.zip_with(counts, F.array(*map(F.lit, reference)), term)
        return F.sqrt(F.greatest(total(terms, F.lit(0.0)), F.lit(0.0)))

    return let(own, divergence)


def _nearest(
    rows: DataFrame, shares: list[tuple[list[float], list[float]]], most_class: float, most_word: float
) -> DataFrame:
    """Rows with both distances to the nearest language, rounded to 6 digits, and how far it is.

    A language is as far as the larger of its distances, each in parts of what is allowed. The word
    distance is null if the nearest language is judged without.
    """
    if not shares:
        none = F.lit(None).cast("double")
        return rows.withColumns({"class_distance": none, "word_distance": none, "far": none})
    distances = []
    for at, (classes, commons) in enumerate(shares):
        by_class = F.round(jensen_shannon(F.col("classes"), classes), 6)
        by_word = F.lit(None).cast("double")
        if 1 - commons[-1] >= LEAST_LISTED:
            by_word = F.round(jensen_shannon(F.col("commons"), commons), 6)
        distances.append(F.struct(by_class.alias("c"), by_word.alias("w"), F.lit(at).alias("at")))
    measured = F.transform(
        F.array(*distances),
        lambda d: F.struct(
            F.greatest(d["c"] / most_class, F.coalesce(d["w"] / most_word, F.lit(0.0))).alias("far"),
            d["at"].alias("at"),
            d["c"].alias("c"),
            d["w"].alias("w"),
        ),
    )
    return (
        rows.withColumn("nearest", F.array_min(measured))
        .withColumns({"class_distance": F.col("nearest.c"), "word_distance": F.col("nearest.w")})
        .withColumn("far", F.col("nearest.far"))
        .drop("nearest")
    )


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_class_distance: float = MOST_CLASS_DISTANCE,
    most_word_distance: float = MOST_WORD_DISTANCE,
) -> DataFrame:
    """Metrics, class_distance, word_distance (to the nearest language, 6 digits) and verdicts."""
    base_failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    far = (F.col("n_words") >= JUDGED_WORDS) & (F.col("n_chars") >= JUDGED_CHARS)
    far &= F.coalesce(F.col("far") > 1, F.lit(False))
    measured = measure(docs, id_col, text_col, lang_col).withColumn("base_failed", base_failed)
    measured = stage(measured)
    sound = measured.where("NOT base_failed")
    limits = most_class_distance, most_word_distance
    near = _nearest(sound, references(sound), *limits).where(~far)
    return (
        _nearest(measured, references(near), *limits)
        .withColumn("kept", ~F.col("base_failed") & ~far)
        .drop("classes", "commons", "n_chars", "lang", "far")
    )
