"""Byte-level BPE: texts to token ids and back to bytes.

Ids come from the tiktoken library with a local rank file. Texts above ``LONG_TEXT`` characters
are split beforehand at safe boundaries, places where every match of the
pre-tokenising pattern ends whatever stands around: before white space that
follows something else, and between kinds of characters no match spans. A long run of white space
is one match in itself and is handed over as such, past the pattern, whose lookahead would overflow
on it. So the ids are those of the whole text, and work and memory of one call stay small.

Null text is an empty text: no ids. Null ids of rows, repeated rows and further columns need no care: rows are encoded
one by one, and only the id column is carried along. An empty table gives no rows. Ids that the vocabulary lacks, and
ids cut inside their four bytes, decode to null.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_TEXT = 1 << 16
SEGMENT = 1 << 14
IDS_AT_ONCE = 1 << 16
BATCH_BYTES = 1 << 24

# --- fixed values: white space of the pattern, and pairs of neighbours it always parts ---------

_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = r"A-Za-z\u0430-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_STOPS = r"!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1f"

BOUNDARY = re.compile(rf"[^{_WHITE}](?=[{_WHITE}])|[{_LETTERS}](?=[{_STOPS}])|[0-9](?=[{_STOPS}{_LETTERS}])")
LONG_SPACE = re.compile(rf"(?<![{_WHITE}])[{_WHITE}]{{{LONG_TEXT},}}+")


def _slices(text: str, start: int, end: int) -> Iterator[str]:
    while end - start > SEGMENT:
        found = BOUNDARY.search(text, start + SEGMENT - 1, end)
        if found is None or found.end() >= end:
            break
        yield text[start : found.end()]
        start = found.end()
    if start < end:
        yield text[start:end]


def segments(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text that are encoded alone, and whether a part is one match as it is."""
    if len(text) <= LONG_TEXT:
        yield text, False
        return
    at = 0
    for run in LONG_SPACE.finditer(text):
        # the last character of a run goes with what follows
        last = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((part, False) for part in _slices(text, at, run.start()))
        yield text[run.start() : last], True
        at = last
    yield from ((part, False) for part in _slices(text, at, len(text)))


def vocabulary_files() -> tuple[str, str]:
    """The default rank file and the pattern that splits text before its merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Coder:
    """Ids of texts and bytes of ids, with a rank file. ``special`` strings are ids of their own."""

    def __init__(self, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        self.special = dict(special)
        self._cut = re.compile("|".join(f"({re.escape(s)})" for s in self.special)) if special else None
        self._by_pattern = _encoding(ranks_path, pattern)
        self._ranks_path, self._whole = ranks_path, None

    def _plain(self, text: str) -> Iterator[list[int]]:
        for part, whole in segments(text):
            if whole and self._whole is None:
                self._whole = _encoding(self._ranks_path, "(?s:.+)")
            yield (self._whole if whole else self._by_pattern).encode_ordinary(part)

    def ids(self, text: str) -> Iterator[list[int]]:
        """Ids in order, a list a segment."""
        if self._cut is None:
            yield from self._plain(text)
            return
        for part in filter(None, self._cut.split(text)):
            if part in self.special:
                yield [self.special[part]]
            else:
                yield from self._plain(part)

    def packed(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        found = array("I")
        for ids in self.ids(text):
            found.extend(ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def _bytes_of(self, ids: list[int]) -> bytes:
        if not self.special:
            return self._by_pattern.decode_bytes(ids)
        names = {i: s.encode() for s, i in self.special.items()}
        return b"".join(names[i] if i in names else self._by_pattern.decode_bytes([i]) for i in ids)

    def text_bytes(self, packed: bytes) -> bytes | None:
        """The bytes of packed ids; null if there is an id without bytes, or part of one."""
        if len(packed) % 4:
            return None
        ids = array("I", packed)
        if sys.byteorder == "big":
            ids.byteswap()
        parts = []
        for at in range(0, len(ids), IDS_AT_ONCE):
            try:
                parts.append(self._bytes_of(ids[at : at + IDS_AT_ONCE].tolist()))
            except KeyError:
                return None
        return b"".join(parts)


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> Coder:
    """One coder per Python worker and vocabulary."""
    return Coder(ranks_path, pattern, special)


def _mapped(rows: DataFrame, out: str, vocabulary: tuple[str, str] | None, code: str) -> DataFrame:
    """The one other column of ``rows`` by a method of the coder, as binary column ``out``."""
    ranks_path, pattern = vocabulary or vocabulary_files()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert: Callable = getattr(coder(ranks_path, pattern), code)
        for batch in batches:
            ids, made, size = [], [], 0
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(row)
                made.append(convert(value.as_py()) if value.is_valid else None)
                size += len(made[-1] or b"")
                if size >= BATCH_BYTES:
                    yield _batch(ids, made, out)
                    ids, made, size = [], [], 0
            yield _batch(ids, made, out)

    return rows.mapInArrow(apply, f"doc_id long, {out} binary")


def _batch(ids: list, made: list, out: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], ["doc_id", out])


def encode_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: tuple[str, str] | None = None,
) -> DataFrame:
    """doc_id and ids, the token ids of the text as little-endian unsigned 32-bit integers.

    ``vocabulary`` is a rank file, at one path on every executor, and its pattern.
    """
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return _mapped(narrow, "ids", vocabulary, "packed")


def decode_documents(
    encoded: DataFrame,
    *,
    id_col: str = "doc_id",
    ids_col: str = "ids",
    vocabulary: tuple[str, str] | None = None,
) -> DataFrame:
    """doc_id and decoded, the raw bytes of the ids; they need not be UTF-8 if ids were cut."""
    narrow = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return _mapped(narrow, "decoded", vocabulary, "text_bytes")


def round_trip(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: tuple[str, str] | None = None,
) -> DataFrame:
    """doc_id, ids and decoded of every row, encoded and decoded again in one pass."""
    ranks_path, pattern = vocabulary or vocabulary_files()
    encoded = encode_documents(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(ranks_path, pattern).text_bytes
        for batch in batches:
            decoded = [decode(ids.as_py()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"]
            )

    return encoded.mapInArrow(both, "doc_id long, ids binary, decoded binary")
