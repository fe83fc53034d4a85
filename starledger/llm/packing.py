"""Packing of tokenised documents into sequences of one length.

Shortest-pack-first over the length histogram: documents are tokenised once and
cut into whole sequences and one rest; the histogram of piece lengths (at most
``seq_len`` rows) is packed on the driver, longest first, each length going to the
open packs with the most room; the packing patterns are then joined back to the
pieces by their rank among the pieces of their length.

Null text is an empty document (its end token alone); rows that repeat, and rows
whose id is null, are documents of their own; an empty table gives no rows. Long texts, and long runs of white space in
them, are encoded piecewise with the ids of the whole (see :mod:`starledger.llm.bpe`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starledger.llm import bpe
from starledger.sources.staging import stage

SEQ_LEN = 2048
END_ID = 1
#: Pieces of one length that are ranked together; a longer run is split by a hash.
RANK_BLOCK = 1024

#: Rank file, pattern, and special strings with their ids.
Vocabulary = tuple[str, str, tuple[tuple[str, int], ...]]

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_files() -> Vocabulary:
    """The default vocabulary as a rank file, the pattern that splits text before it, and its special tokens.

    It is the vocabulary of byte_bpe_50k.json as that tokenizer is opened by default: the end-of-text string
    in a text is the id of that token. The rank file gives the same ids (held by tests) several times faster.
    """
    return (*bpe.vocabulary_files(), (("<|endoftext|>", 50256),))


def document_pieces(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    end_id: int = END_ID,
    vocabulary: Vocabulary | None = None,
) -> DataFrame:
    """Pieces of at most ``seq_len`` ids: whole sequences first, then the rest."""
    files = vocabulary or tokenizer_files()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.coder(*files).packed
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, seq_len):
                    piece = ids[4 * start : 4 * (start + seq_len)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(cut, PIECES)


def pack_histogram(
    histogram: dict[int, int], seq_len: int = SEQ_LEN
) -> list[tuple[int, int, int, int, int]]:
    """Slots as (length, first rank, last rank, first sequence, offset).

    Longest lengths first; each goes to the packs that hold least so far and still
    have room, else to new packs. Packs of one content are counted, not listed, so the
    work and the result depend on the number of lengths only.
    """
    open_packs: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(seq_len + 1)]
    top = 0  # no open pack has more room than this
    for length in range(seq_len, 0, -1):
        left = histogram.get(length, 0)
        room = top
        while left:
            while room >= length and not open_packs[room]:
                room -= 1
            if room >= length:
                count, lengths = open_packs[room].pop()
                if count > left:
                    open_packs[room].append((count - left, lengths))
                used = min(count, left)
                open_packs[room - length].append((used, (*lengths, length)))
            else:
                used = left
                open_packs[seq_len - length].append((used, (length,)))
                top = max(top, seq_len - length)
            left -= used
    slots, sequence, ranks = [], 0, dict.fromkeys(histogram, 0)
    for packs in open_packs:
        for count, lengths in packs:
            offset = 0
            for length in lengths:
                first = ranks[length]
                slots.append((length, first, first + count - 1, sequence, offset))
                ranks[length] += count
                offset += length
            sequence += count
    return slots


def _ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Each piece with its rank, from 0, among the pieces of its length.

    A length may hold most of all pieces, so it is split by a hash into blocks
    which are ranked alone and shifted by the sizes of the blocks before.
    """
    spark = pieces.sparkSession
    blocks = spark.createDataFrame(
        [(k, n // RANK_BLOCK + 1) for k, n in histogram.items()], "length long, blocks long"
    )
    blocked = pieces.join(F.broadcast(blocks), "length").withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "start"), "blocks")
    )
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        blocked.groupBy("length", "block")
        .agg(F.count("*").alias("size"))
        .select("length", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    )
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "start")
    return (
        blocked.withColumn("inside", F.row_number().over(inside) - 1)
        .join(shifts, ["length", "block"])
        .withColumn("rank", F.col("inside") + F.col("shift"))
        .drop("blocks", "block", "inside", "shift")
    )


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    end_id: int = END_ID,
    vocabulary: Vocabulary | None = None,
) -> DataFrame:
    """One row per piece of a document with its sequence and offset there.

    Columns: doc_id, start (ids of its document before it), length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. Sequences
    are numbered from 0 and filled without gaps from offset 0.
    """
    pieces = stage(
        document_pieces(
            docs,
            id_col=id_col,
            text_col=text_col,
            seq_len=seq_len,
            end_id=end_id,
            vocabulary=vocabulary,
        )
    )
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # <= seq_len rows
    histogram = {r["length"]: r["n"] for r in counted}
    slots = pieces.sparkSession.createDataFrame(
        pack_histogram(histogram, seq_len) or [(0, 0, -1, 0, 0)],
        "slot_length long, first long, last long, sequence long, offset long",
    )
    placed = _ranked(pieces, histogram).join(
        F.broadcast(slots),  # grows with seq_len, not with the documents
        (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first"), F.col("last")),
    )
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
        "offset",
    )
