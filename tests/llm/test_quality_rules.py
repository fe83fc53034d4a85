from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger.llm import quality_rules
from tests.llm.conftest import EDGE_ROWS

ENGLISH = "The dogs of the town ran to the river and it was cold for them, as on the other days. "
SPANISH = "El perro de la casa no es del señor que vive con una tía en los montes para las fiestas. "


def naive(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        repeated,
        len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


@pytest.fixture(scope="module")
def rows(prose):
    repeats = [
        " ".join(["a b c d e f g h i"] * 3),
        "x " * 40,
        prose(1, 60) + " " + prose(2, 9) + " z " + prose(2, 9) + " " + prose(3, 40),
        prose(4, 12) + "\n" + prose(5, 30) + "\n" + prose(4, 12) + "\n\n \n",
        "a\x0bb\x0cc\rd e f " * 10,
        "😀 # $ % & | < > * " * 4,
        prose(6, 5000),
        prose(7, 19),
        prose(7, 20),
    ]
    texts = [ENGLISH + prose(10 + k, 45) for k in range(12)]
    other = [SPANISH + prose(50 + k, 45) for k in range(6)]
    junk = [prose(90, 80).upper().replace(" ", "!! ") + "!!", prose(91, 90).replace(" ", " ### | ")]
    return [*enumerate(repeats + texts + other + junk), *EDGE_ROWS]


@pytest.fixture(scope="module")
def result(frame, rows):
    languages = {i: "es" if t and "perro" in t else "en" for i, t in rows if t and ("dogs" in t or "perro" in t)}
    return quality_rules.judge(frame(rows, languages)).collect()


def test_base_metrics(result, rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted((r["doc_id"] or -1, *(r[n] for n in names)) for r in result)
    assert got == sorted((i or -1, *naive(t)) for i, t in rows)


def test_clean_texts_stay_and_unlike_ones_go(result, rows):
    texts = dict(rows)
    for r in result:
        text = texts[r["doc_id"]] or ""
        if "dogs" in text or "perro" in text:
            assert r["kept"]
        if "###" in text or "!!" in text and text.isupper():
            assert not r["kept"]
        if r["base_failed"]:
            assert not r["kept"]
        elif r["n_words"] < quality_rules.JUDGED_WORDS:
            assert r["kept"]


def test_distance_is_jensen_shannon(spark):
    rng = np.random.default_rng(1)
    reference = rng.random(6)
    reference = (reference / reference.sum()).tolist()
    counts = [[int(c) for c in rng.integers(0, 9, 6)] for _ in range(20)] + [[0] * 6, [5, 0, 0, 0, 0, 0]]
    frame = spark.createDataFrame([(c,) for c in counts], "c array<long>")
    got = frame.select(quality_rules.jensen_shannon(F.col("c"), reference).alias("d")).collect()
    q = np.array(reference)
    for c, r in zip(counts, got, strict=True):
        p = np.array(c) / max(1, sum(c))
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
        assert r["d"] == pytest.approx(np.sqrt(terms.sum() / 2), abs=1e-12)


def test_without_languages_the_base_rules_decide(frame, rows):
    for r in quality_rules.judge(frame(rows)).collect():
        assert r["kept"] == (not r["base_failed"]) and r["class_distance"] is None


def test_one_language_must_be_near_in_both(frame):
    """Letters like one language's do not pass by the words of another that has no listed words."""
    letters = "αβγδεζηθικλμνξοπρστυφχψω"
    rng = np.random.default_rng(3)
    greek = [" ".join("".join(rng.choice(list(letters), 5)) for _ in range(70)) + "." for _ in range(60)]
    english = [" ".join(rng.permutation((ENGLISH * 4).split())) for _ in range(30)]
    gibberish = " ".join("".join(rng.choice(list("etaoinshrdlu"), 5)) for _ in range(90)) + "."
    rows = list(enumerate([*english, *greek, gibberish]))
    languages = {i: "en" if i < 30 else "el" for i, _ in rows[:-1]}
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame(rows, languages)).collect()}
    assert [i for i, _ in rows if not kept[i]] == [len(rows) - 1]


def test_empty_table(frame):
    assert quality_rules.judge(frame([])).collect() == []
