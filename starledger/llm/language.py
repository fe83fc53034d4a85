"""Language identification by a linear-chain conditional random field over words.

Each word has hashed features: its character n-grams with word ends marked (so affixes
are n-grams of their own), longer affixes, and the whole word if it is in the lexicon of
frequent training words. Transitions between the labels of neighbours are learned too.
Forward-backward gives every word a distribution over languages, so text that switches
language is labelled word by word; a document gets the language with the largest
expected share of its words, and that share as its score.

The model is fitted on a bounded sample: about ``docs_per_language`` labelled documents of each
language, cut into runs of words that are joined across languages, so that
transitions see switches. Prediction sees text alone.

Null text and text without a letter: ``und``, score 0, as all texts are when no row has a label.
Words without a letter have no label. A chain holds at most ``CHAIN`` words, longer texts
are several chains. Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
BUCKETS = 1 << 16
CHAIN = 128
DOCS_PER_LANGUAGE = 400
MOST_CHARS = 200_000  # longer texts are not taken as training rows
WORDS_PER_LANGUAGE = 40_000
LEXICON = 2_000
RUN = (4, 40)  # words of one language in a training chain, least and most
EPOCHS = 20
RATE = 0.15
DECAY = 0.1
WORDS_AT_ONCE = 50_000
NEW_WORDS_AT_ONCE = 10_000
CACHED_WORDS = 100_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - 16)
_START, _END = 0x02, 0x03


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-cased words, flat, and where each word's begin."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    last = np.flatnonzero(codes == _END)
    first = np.concatenate([[0], last[:-1] + 1])
    word = np.repeat(np.arange(len(words)), last - first + 1)
    found, owner = [], []
    rolled = np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3):
        rolled = rolled[: len(codes) - n + 1] * _A + codes[n - 1 :] + np.uint64(n)
        whole = word[: len(rolled)] == word[n - 1 :]
        found.append(((rolled[whole] * _B) ^ np.uint64(n)) * _A >> _SHIFT)
        owner.append(word[: len(rolled)][whole])
    for n in (4, 5):  # affixes longer than the n-grams; of short words, the word itself
        size = np.minimum(n, last - first)
        for salt, at in ((n, first), (n + 8, last - size + 1)):
            hashed = np.full(len(words), salt, np.uint64)
            for i in range(n):
                hashed = np.where(i < size, hashed * _A + codes[np.minimum(at + i, last)], hashed)
            found.append(hashed * _B >> _SHIFT)
            owner.append(np.arange(len(words)))
    entries = np.array([lexicon.get(w, -1) for w in words])
    found.append((BUCKETS + entries[entries >= 0]).astype(np.uint64))
    owner.append(np.flatnonzero(entries >= 0))
    features, words_of = np.concatenate(found).astype(np.int64), np.concatenate(owner)
    order = np.argsort(words_of, kind="stable")
    starts = np.searchsorted(words_of[order], np.arange(len(words)))
    return features[order], starts


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the chains of consecutive documents of so many words."""
    ends = np.cumsum(lengths)
    starts, sizes = [], []
    for end, n in zip(ends, lengths, strict=True):
        at = np.arange(end - n, end, CHAIN)
        starts.append(at)
        sizes.append(np.minimum(CHAIN, end - at))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(sizes)


def forward_backward(
    potentials: np.ndarray, transition: np.ndarray, starts: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Word marginals, expected transitions and log partition of all chains.

    ``potentials`` (words x labels) and ``transition`` are exponentiated scores. Chains run side
    by side, longest first, so that each step handles those that are still going.
    """
    labels = transition.shape[0]
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]
    forward = np.empty_like(potentials)
    log_z = 0.0
    for t in range(steps):
        at = starts[: active[t]] + t
        now = potentials[at]
        if t:
            now = now * (forward[at - 1] @ transition)
        total = now.sum(1, keepdims=True)
        log_z += float(np.log(total).sum())
        forward[at] = now / total
    marginals = np.empty_like(potentials)
    expected = np.zeros((labels, labels))
    behind = np.ones((len(sizes), labels), potentials.dtype)
    for t in range(steps - 1, -1, -1):
        at = starts[: active[t]] + t
        if t + 1 < steps and active[t + 1]:
            k = active[t + 1]
            ahead = potentials[at[:k] + 1] * behind[:k]
            back = ahead @ transition.T
            pair = (forward[at[:k]][:, :, None] * transition[None]) * ahead[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            behind[:k] = back / back.sum(1, keepdims=True)
        both = forward[at] * behind[: active[t]]
        marginals[at] = both / both.sum(1, keepdims=True)
    return marginals, expected, log_z


def word_marginals(
    potentials: np.ndarray, transition: np.ndarray, starts: np.ndarray, sizes: np.ndarray
) -> np.ndarray:
    """The marginals of ``forward_backward`` alone."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]
    forward = np.empty_like(potentials)
    for t in range(steps):
        at = starts[: active[t]] + t
        now = potentials[at]
        if t:
            now = now * (forward[at - 1] @ transition)
        forward[at] = now / now.sum(1, keepdims=True)
    behind = np.ones((len(sizes), transition.shape[0]), potentials.dtype)
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        at = starts[:k] + t
        back = (potentials[at + 1] * behind[:k]) @ transition.T
        behind[:k] = back / back.sum(1, keepdims=True)
        forward[at] *= behind[:k]
    return forward / forward.sum(1, keepdims=True)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (buckets + lexicon) x languages
    transition: np.ndarray  # scores, languages x languages
    lexicon: dict[str, int]

    def potentials(self, words: list[str]) -> np.ndarray:
        features, starts = word_features(words, self.lexicon)
        scores = np.add.reduceat(self.weights[features], starts)
        return np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32) + 1e-6


def words_of(text: str | None) -> list[str]:
    """Lower-cased words that have a letter."""
    return [w for w in (text or "").lower().split() if w.isalpha() or any(map(str.isalpha, w))]


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Fit on (language, text) rows; none without any word."""
    rng = np.random.default_rng(seed)
    runs: list[tuple[int, list[str]]] = []
    languages = tuple(sorted({lang for lang, _ in rows}))
    for label, lang in enumerate(languages):
        texts = sorted(text for own, text in rows if own == lang)
        left = WORDS_PER_LANGUAGE
        for i in rng.permutation(len(texts)):
            words = words_of(texts[i])
            at = 0
            while at < len(words) and left > 0:
                size = int(rng.integers(RUN[0], RUN[1] + 1))
                runs.append((label, words[at : at + size]))
                left -= min(size, len(words) - at)
                at += size
    if not runs:
        return None
    runs = [runs[i] for i in rng.permutation(len(runs))]
    flat = [w for _, words in runs for w in words]
    truth = np.repeat([label for label, _ in runs], [len(words) for _, words in runs])
    counts = Counter(flat)
    frequent = sorted(counts, key=lambda w: (-counts[w], w))[:LEXICON]
    lexicon = {w: i for i, w in enumerate(frequent)}
    vocabulary = {w: i for i, w in enumerate(counts)}
    ids = np.array([vocabulary[w] for w in flat])
    features, starts = word_features(list(vocabulary), lexicon)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff([*starts, len(features)]))
    by_feature = np.argsort(features, kind="stable")
    used, feature_starts = np.unique(features[by_feature], return_index=True)
    owner = owner[by_feature]

    n, k = len(flat), len(languages)
    at, sizes = chains(np.array([n]))
    seen_pairs = np.zeros((k, k))
    inner = np.ones(n, bool)
    inner[at] = False
    np.add.at(seen_pairs, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    seen = np.zeros((len(vocabulary), k))
    np.add.at(seen, (ids, truth), 1)
    weights, transition = np.zeros((BUCKETS + LEXICON, k)), np.zeros((k, k))
    squares, squares_t = np.full((len(used), k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(EPOCHS):  # adaptive gradient ascent on the log-likelihood of all chains
        scores = np.add.reduceat(weights[features], starts)
        potentials = np.exp(scores - scores.max(1, keepdims=True)) + 1e-9
        marginals, expected, _ = forward_backward(potentials[ids], np.exp(transition), at, sizes)
        wanted = seen.copy()
        for label in range(k):
            wanted[:, label] -= np.bincount(ids, marginals[:, label], len(vocabulary))
        step = np.add.reduceat(wanted[owner], feature_starts) - DECAY * weights[used]
        squares += step**2
        weights[used] += RATE * step / np.sqrt(squares)
        step = seen_pairs - expected
        squares_t += step**2
        transition += RATE * step / np.sqrt(squares_t)
    return Model(languages, weights.astype(np.float32), transition.astype(np.float32), lexicon)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: every fifth by the CRC of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
) -> Model | None:
    """A model from rows with a label that are not held out, sampled by a hash of the id."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    ).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").count().collect()  # one row a language
    if not sizes:
        return None
    share = F.create_map(
        *(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, docs_per_language / r["count"])))
    )
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) / 1_000_003
    sample = rows.where((draw < share[F.col("lang")]) & (F.length("text") <= MOST_CHARS))
    return fit([(r["lang"], r["text"]) for r in sample.select("lang", "text").collect()])


class _Labeller:
    """Shares of languages for lists of words, with the potentials of words kept."""

    def __init__(self, model: Model):
        self.model = model
        self.ids: dict[str, int] = {}
        self.potentials = np.empty((1 << 12, len(model.languages)), np.float32)
        self.transition = np.exp(model.transition)

    def marginals(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.ids) > CACHED_WORDS:
            self.ids = {}
        ids = self.ids
        known = len(ids)
        flat: list[int] = []
        fresh: list[str] = []
        for words in texts:
            for w in set(words).difference(ids):
                ids[w] = len(ids)
                fresh.append(w)
            flat.extend(map(ids.__getitem__, words))
        if len(ids) > len(self.potentials):
            grown = np.empty((2 * len(ids), self.potentials.shape[1]), np.float32)
            grown[:known] = self.potentials[:known]
            self.potentials = grown
        for at in range(0, len(fresh), NEW_WORDS_AT_ONCE):
            part = fresh[at : at + NEW_WORDS_AT_ONCE]
            self.potentials[known + at : known + at + len(part)] = self.model.potentials(part)
        starts, sizes = chains(np.array([len(words) for words in texts], np.int64))
        return word_marginals(self.potentials[np.array(flat, np.int64)], self.transition, starts, sizes)


def _predicted(texts: Iterable[str | None], labeller: _Labeller | None) -> Iterator[tuple]:
    """Language, score, shares, switches and certainty of each text, some texts at a time."""
    group, size = [], 0
    for text in texts:
        group.append(words_of(text))
        size += len(group[-1])
        if size >= WORDS_AT_ONCE:
            yield from _predicted_group(group, labeller)
            group, size = [], 0
    yield from _predicted_group(group, labeller)


def _predicted_group(group: list[list[str]], labeller: _Labeller | None) -> list[tuple]:
    texts = [words for words in group if words]
    rows = []
    if labeller and texts:
        marginals = labeller.marginals(texts)
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths) - lengths
        shares = np.add.reduceat(marginals.astype(np.float64), starts) / lengths[:, None]
        certainties = np.add.reduceat(marginals.max(1).astype(np.float64), starts) / lengths
        best = marginals.argmax(1)
        differs = np.concatenate([[0], (best[1:] != best[:-1]).astype(np.int64)])
        differs[starts] = 0
        switches = np.add.reduceat(differs, starts)
    at = 0
    for words in group:
        if not (labeller and words):
            rows.append((UNDETERMINED, 0.0, None, 0, 0.0))
            continue
        own = shares[at]
        likeliest = int(own.argmax())
        score = min(1.0, float(own[likeliest]))
        language = labeller.model.languages[likeliest]
        rows.append((language, score, own, int(switches[at]), min(1.0, float(certainties[at]))))
        at += 1
    return rows


def _texts(column: pa.Array) -> Iterator[str | None]:
    return (text.as_py() for text in column)


PREDICTED = "doc_id long, lang_pred string, score double, shares array<double>, n_switches long"


def identify(
    docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score, shares (of the model's languages, in order), n_switches.

    ``n_switches`` counts neighbours among a document's words whose likeliest languages differ.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(model) if model else None
        types = [pa.string(), pa.float64(), pa.list_(pa.float64()), pa.int64()]
        names = ["doc_id", "lang_pred", "score", "shares", "n_switches"]
        for batch in batches:
            rows = list(_predicted(_texts(batch.column(1)), labeller))
            columns = list(zip(*rows, strict=True))[:4] or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, t) for c, t in zip(columns, types, strict=True)),
                ],
                names,
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(predict, PREDICTED)


def keep_identified(
    docs: DataFrame,
    model: Model | None,
    least_score: float = 0.0,
    *,
    least_certainty: float = 0.0,
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least ``least_score``, and whose words
    are labelled with at least ``least_certainty`` (the mean of each word's likeliest label).

    Text that switches between languages has certain words and no large score.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(model) if model else None
        for batch in batches:
            found = _predicted(_texts(batch.column(text_col)), labeller)
            kept = [
                lang != UNDETERMINED and score >= least_score and certainty >= least_certainty
                for lang, score, _, _, certainty in found
            ]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
