"""Corpus pipeline: documents in, packed sequences of tokens out.

Each stage works on all documents that the one before kept and returns the columns of
documents, the last one the pieces of the packed sequences. ``run`` writes every stage's
result to the staging folder and reads it again, so no stage is computed twice and a lost
executor costs the tasks it had.

Rows without an id pass the language stage by their text alone, the line and near-duplicate stages unchanged, and are
judged like others in the benchmark stage. Null and empty texts have no language and go there. Rows that repeat both id and
text are one document from the near-duplicate stage on. Of equal lines and near copies the one with the smallest
id stays. Texts are worked on whole, whatever their length. Columns of the input keep their values, also under names that an
operator uses. An empty table gives no rows. SQL cannot express the learned labels of the first stage,
so there is no SQL twin; the tests hold every stage against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.llm import decontamination, language, line_dedup, ngram_join, packing
from starledger.sources.staging import stage

LEAST_CERTAINTY = 0.5
WORDS, PERCENT = 5, 80
BROADCAST_ROWS = 500_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _limited(rows: DataFrame) -> DataFrame:
    """Staged; hinted for broadcast if few enough, else left to a shuffle join."""
    rows = stage(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _own(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose words are labelled with some certainty, whether with one language
    or with several in turn."""
    return language.keep_identified(docs, language.train(docs), least_certainty=LEAST_CERTAINTY)


def _short_lines(text: Column) -> Column:
    """Digest of the lines that are too short to be compared, in order; null without any."""
    short = F.filter(
        F.transform(F.split(text, "\n"), F.trim),
        lambda s: (F.length(s) < line_dedup.LEAST_CHARS) & s.rlike(r"\S"),
    )
    return F.when(F.size(short) > 0, F.md5(F.array_join(short, "\n")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out. A document that loses all its long lines goes if nothing but white
    space is left, or if its short lines are, one by one, those of a document with a smaller id."""
    n_lines, n_removed, empty, short, first_doc = (
        _own(docs, f"__{c}") for c in ("n_lines", "n_removed", "empty", "short", "first")
    )
    shorter = line_dedup.dedup_lines(docs, counts=(n_lines, n_removed))
    emptied = (F.col(n_removed) > 0) & ~F.exists(
        F.split("text", "\n"), lambda s: F.length(F.trim(s)) >= line_dedup.LEAST_CHARS
    )
    marked = shorter.withColumn(empty, F.coalesce(emptied, F.lit(False))).withColumn(
        short, F.when(F.col(empty), _short_lines(F.col("text")))
    )
    left = _limited(marked.where(F.col(short).isNotNull()).select("doc_id", short).distinct())
    first = (
        docs.select("doc_id", _short_lines(F.col("text")).alias(short))
        .where(F.col("doc_id").isNotNull() & F.col(short).isNotNull())
        .groupBy(short)
        .agg(F.min("doc_id").alias(first_doc))
    )
    gone = first.join(left, short).where(F.col("doc_id") > F.col(first_doc)).select("doc_id", short)
    kept = marked.where(~F.col(empty) | F.col(short).isNotNull()).join(
        _limited(gone), ["doc_id", short], "left_anti"
    )
    return kept.withColumn(
        "n_chars", F.when(F.col(n_removed) == 0, F.col("n_chars")).otherwise(F.length("text"))
    ).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: that with the smallest id.

    Rows with an id are told apart by id and text, so texts that share an id are documents of their own; rows
    that repeat both are one.
    """
    key = _own(docs, "__key")
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = ngram_join.jaccard_components(keyed, words=WORDS, percent=PERCENT, id_col=key)
    linked = stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key), "component_id").distinct())
    members = linked.unionByName(linked.select(F.col("component_id").alias(key), "component_id").distinct())
    ids = keyed.select(key, "doc_id").join(_limited(members), key).distinct()
    stays = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", F.col(key).alias("key"))).alias("first"))
    gone = ids.join(stays, "component_id").where(F.col(key) != F.col("first.key")).select(key)
    kept = keyed.join(_limited(gone), key, "left_anti")
    repeated = stage(kept.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    if not repeated.isEmpty():
        once = kept.join(_limited(repeated), key, "left_semi").dropDuplicates([key])
        kept = kept.join(_limited(repeated), key, "left_anti").unionByName(once)
    return kept.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = _own(docs, "__key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    hit = decontamination.contaminated(keyed, items, id_col=key)
    gone = _limited(hit.select(F.col("doc_id").alias(key)))
    return keyed.join(gone, key, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_copies", drop_near_copies),
    ("benchmark", decontaminate),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
