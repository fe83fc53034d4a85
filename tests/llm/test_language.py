from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger.llm import language
from tests.llm.conftest import EDGE_ROWS

SYLLABLES = {
    "aa": "ka lo mi ne pu ta the and".split(),
    "bb": "schu ver ung keit der und ßen ö".split(),
    "cc": "eau que oi ré les è ment tion".split(),
}


def made(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    texts = [(lang, made(lang, k, 40)) for lang in SYLLABLES for k in range(60)]
    random.Random(1).shuffle(texts)
    return [(i, t) for i, (_, t) in enumerate(texts)], {i: lang for i, (lang, _) in enumerate(texts)}


@pytest.fixture(scope="module")
def model(frame, rows):
    return language.train(frame(*rows))


def test_held_out_accuracy(frame, rows, model):
    texts, truth = rows
    got = {r["doc_id"]: r for r in language.identify(frame(texts), model).collect()}
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 20
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and abs(sum(r["shares"]) - 1) < 1e-5 for r in got.values())


def test_held_out_follows_the_id(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id long")
    for r in ids.select("doc_id", language.held_out(F.col("doc_id")).alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_held_out_labels_change_nothing(frame, rows, model):
    texts, truth = rows
    wrong = {i: "aa" if zlib.crc32(str(i).encode()) % 5 == 0 else lang for i, lang in truth.items()}
    again = language.train(frame(texts, wrong))
    assert again.languages == model.languages and np.array_equal(again.weights, model.weights)


def test_switches_are_found_word_by_word(model):
    words = language.words_of(made("aa", 900, 12) + " " + made("bb", 901, 12))
    best = language._Labeller(model).marginals([words]).argmax(1)
    truth = [0] * 12 + [1] * 12
    assert np.mean(best == truth) > 0.9
    assert np.all(np.diag(model.transition) > model.transition.max(1) - 1e-6)


def test_undetermined_and_edge_rows(frame, model):
    got = {(r["doc_id"], r["lang_pred"]): r for r in language.identify(frame(EDGE_ROWS), model).collect()}
    undetermined = {i for i, lang in got if lang == "und"}
    assert undetermined == {9001, 9002, 9003, 9006}
    assert language.identify(frame([]), model).collect() == []


def test_without_labels(frame):
    rows = [(1, "some words"), (2, "")]
    model = language.train(frame(rows))
    assert model is None
    assert {r["lang_pred"] for r in language.identify(frame(rows), model).collect()} == {"und"}


def test_keep_identified(frame, rows, model):
    docs = frame([*rows[0][:20], *EDGE_ROWS], rows[1])
    kept = language.keep_identified(docs, model, 0.5)
    assert kept.columns == docs.columns
    assert set(range(20)) <= {r["doc_id"] for r in kept.collect()}
    assert not {9001, 9002, 9003, 9006} & {r["doc_id"] for r in kept.collect()}


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(3)
    potentials, transition = rng.random((9, 3)) + 0.1, rng.random((3, 3)) + 0.1
    starts, sizes = np.array([0, 4, 5]), np.array([4, 1, 4])
    marginals, expected, log_z = language.forward_backward(potentials, transition, starts, sizes)
    want, pairs, total = np.zeros((9, 3)), np.zeros((3, 3)), 0.0
    for at, n in zip(starts, sizes, strict=True):
        z, own, moved = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for labels in itertools.product(range(3), repeat=int(n)):
            p = np.prod([potentials[at + t, x] for t, x in enumerate(labels)])
            p *= np.prod([transition[x, y] for x, y in zip(labels, labels[1:], strict=False)])
            z += p
            for t, x in enumerate(labels):
                own[t, x] += p
            for x, y in zip(labels, labels[1:], strict=False):
                moved[x, y] += p
        want[at : at + n], pairs, total = own / z, pairs + moved / z, total + np.log(z)
    assert np.allclose(marginals, want) and np.allclose(expected, pairs) and np.isclose(log_z, total)
    assert np.allclose(language.word_marginals(potentials, transition, starts, sizes), want)


def test_chains_are_bounded():
    starts, sizes = language.chains(np.array([300, 1, 128]))
    assert sizes.max() <= language.CHAIN and sizes.sum() == 429
    assert sorted(starts) == [0, 128, 256, 300, 301]
