"""Secret scans: fixed patterns plus assignment-aware lexing.

Base spans come from three patterns (assignments to a telling name, access keys,
hexadecimal runs). The lexer adds what patterns miss: it reads source and
configuration syntax into name-literal pairs, carries constants from one
name to another within a text, and scores each literal by the name it ends up in.

Null text is empty text: no span. Positions count code points, ends are exclusive. Rows are scanned one by
one: repeated rows tell the same, null ids are kept, an empty table gives no rows, and other columns are not
looked at. Texts are scanned whole, whatever their length; what a name holds is kept as references to literals
and earlier values, so constants that are put together again and again take no room.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: base patterns, least sizes ---------------------------------

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]{32,}")  # as [0-9a-f]+ with runs below 32 dropped
KINDS = ("assign", "access", "hex", "literal")

# --- fixed values: parts of names that a secret is assigned to ----------------

SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.9,
    "pass": 0.6,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "privatekey": 1.0,
    "accesskey": 1.0,
    "signingkey": 1.0,
    "encryptionkey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "auth": 0.6,
    "bearer": 0.8,
    "key": 0.4,
    "salt": 0.5,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "<", "${", "{{", "dummy")

# --- lexing --------------------------------------------------------------------

#: From its first character on, so that a long run of word characters is read once.
NAME = r"(?<![\w.-])[A-Za-z_][\w.-]*+"
#: name, assignment sign, then literals and names joined by "+"; in source,
#: configuration and object notation alike. The literal may stand bare.
PAIR = re.compile(
    rf"""(?P<name>{NAME})(?:["']|\])?[\x20\t]*(?::=|=>|=|:)(?![=>:/])[\x20\t]*"""
    r"""(?P<value>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`|[^\s"'`,;(){}\[\]#<>]++)"""
    r"""(?P<rest>(?:[\x20\t]*\+[\x20\t]*(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[A-Za-z_][\w.]*+))*+)""",
    re.ASCII,
)
PART = re.compile(
    r""""(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[A-Za-z_][\w.]*+""", re.ASCII
)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
LEAST_LITERAL = 8
LEAST_SCORE = 1.0


def name_weight(name: str) -> float:
    """How telling a target name is: its words and pairs of words, looked up."""
    words = [w.lower() for w in WORD.findall(name)]
    parts = [*words, *(a + b for a, b in zip(words, words[1:], strict=False))]
    return max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)


def literal_weight(literal: str) -> float:
    """How much a literal looks like a secret: spread of characters and their kinds."""
    if len(literal) < LEAST_LITERAL or any(c.isspace() for c in literal):
        return 0.0
    low = literal.lower()
    if any(p in low for p in PLACEHOLDERS):
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit))
    return min(1.0, entropy / 4.0) * (0.7 + 0.3 * (kinds - 1)) if kinds else 0.0


class _Value:
    """What a name was set to: a literal with its span, or earlier values in order."""

    __slots__ = ("literal", "parts")

    def __init__(self, literal: tuple[str, int, int] | None = None, parts: list[_Value] | None = None):
        self.literal, self.parts = literal, parts or []

    def literals(self) -> list[tuple[str, int, int]]:
        """Its distinct literals, in the order in which they first occur."""
        found, seen, waiting = [], set(), [self]
        while waiting:
            value = waiting.pop()
            if id(value) in seen:
                continue
            seen.add(id(value))
            if value.literal:
                found.append(value.literal)
            waiting.extend(reversed(value.parts))
        return found


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, in order.

    ``name = "a" + "b"`` joins its literals; ``name = other`` takes what ``other`` was last
    set to, and the span reported is that of the literal itself. A literal that is joined twice counts once.
    """
    constants: dict[str, _Value] = {}
    found: set[tuple[int, int]] = set()
    for m in PAIR.finditer(text):
        parts: list[_Value] = []
        value, at = m["value"], m.start("value")
        if value[0] in "\"'`":
            parts.append(_Value((value[1:-1], at + 1, at + len(value) - 1)))
        elif value in constants:
            parts.append(constants[value])
        else:
            parts.append(_Value((value, at, at + len(value))))
        for piece in PART.finditer(m["rest"]):
            start = m.start("rest") + piece.start()
            if piece[0][0] in "\"'":
                parts.append(_Value((piece[0][1:-1], start + 1, start + len(piece[0]) - 1)))
            elif piece[0] in constants:
                parts.append(constants[piece[0]])
        held = parts[0] if len(parts) == 1 else _Value(parts=parts)
        constants[m["name"]] = held
        weight = name_weight(m["name"])
        if weight:
            literals = held.literals()
            likely = literal_weight("".join(p for p, _, _ in literals))
            if likely and weight + likely > LEAST_SCORE:
                found.update((s, e) for p, s, e in literals if p)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    lowered = text.lower()
    if any(cue in lowered for cue in ASSIGN_CUES):
        spans += [
            (m.start(), m.end(), "assign")
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= ASSIGN_LEAST
        ]
    if "AKIA" in text:
        spans += [
            (m.start(), m.end(), "access")
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= ACCESS_LEAST
        ]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def _joined(spans: list[tuple[int, int, str]]) -> str:
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_text(text: str | None) -> tuple[int, int, int, int, str, str]:
    """Counts by kind (literals last), base spans and all spans as text."""
    text = text or ""
    base = base_spans(text)
    counts = Counter(kind for _, _, kind in base)
    added = []
    if "=" in text or ":" in text:
        added = [(s, e, "literal") for s, e in literal_spans(text)]
    return (
        *(counts[k] for k in KINDS[:3]),
        len(added),
        _joined(base),
        _joined(base + added),
    )


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_literal long,"
    " base_spans string, spans string"
)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans per row of ``docs``; spans read ``kind:start:end``, comma-joined."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2
        names = [f.split()[0] for f in SCHEMA.split(",")]
        for batch in batches:
            columns = list(zip(*(scan_text(t.as_py()) for t in batch.column(1)), strict=True))
            columns = columns or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns, types)], names
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(scan, SCHEMA)
