from __future__ import annotations

import random
import zlib

import pytest

import corpus_pipeline
from starledger.llm import decontamination, language, ngram_join, packing
from starledger.sources.staging import stage
from tests.llm.conftest import EDGE_ROWS
from tests.llm.test_decontamination import naive as naive_overlaps
from tests.llm.test_language import SYLLABLES, made
from tests.llm.test_line_dedup import naive as naive_lines
from tests.llm.test_ngram_join import components


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(k, made("aa", 700 + k, 20)) for k in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


@pytest.fixture(scope="module")
def rows(folder):
    rng, texts = random.Random(5), []
    for k in range(60):
        lang = rng.choice(list(SYLLABLES))
        texts.append((lang, "\n".join(made(lang, f"{k}.{j}", 15) for j in range(6))))
    line = made("bb", 800, 12)
    for k in range(0, 60, 4):
        texts[k] = (texts[k][0], texts[k][1] + "\n" + line)
    copies = [(lang, text.replace("the", "tha", 1).replace("e", "E", 9)) for lang, text in texts[:8]]
    copies += texts[8:14]
    leaks = [("aa", made("aa", f"l{k}", 30) + "\n" + folder[1][k][1] + " " + made("aa", f"m{k}", 30)) for k in range(3)]
    whole = [(lang, t) for lang, t in texts + copies + leaks]
    return [*((i, t) for i, (_, t) in enumerate(whole)), *EDGE_ROWS], {i: lang for i, (lang, _) in enumerate(whole)}


def test_stages_follow_their_operators(spark, frame, rows, folder):
    path, items = folder
    texts, languages = rows
    docs = frame(texts, languages)
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(step(spark, docs, path))
        after = docs.collect()
        seen[name] = len(after)
        if name != "packing":
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in after)
            kept = sorted(((r["doc_id"], r["text"]) for r in after), key=str)
        if name == "language":
            model = language.train(frame(texts, languages))
            told = language.identify(frame(before), model).collect()
            unsure = corpus_pipeline.LEAST_CERTAINTY
            gone = {r["doc_id"] for r in told if r["lang_pred"] == "und"}
            assert all(r["score"] >= unsure for r in told if r["doc_id"] not in gone)  # none is left to certainty here
            assert kept == sorted((r for r in before if r[0] not in gone), key=str)
            assert {9001, 9002, 9003, 9006} <= gone and not gone & set(range(60))
        elif name == "lines":
            changed = [
                (i, t)
                for i, t, n in naive_lines(before)
                if n == 0 or any(len(x.strip(" ")) >= 30 for x in t.split("\n"))
            ]
            assert kept == sorted(changed, key=str) and len(kept) < len(before)
        elif name == "near_copies":
            gone = {i for i, _, c in components(before, 5, 80) if i != c}
            assert kept == sorted(({r for r in before if r[0] not in gone}), key=str)
        elif name == "benchmark":
            gone = {i for i, _ in naive_overlaps(before, items)}
            assert kept == sorted((r for r in before if r[0] not in gone), key=str) and gone
        else:
            assert {r["doc_id"] for r in after} == {i for i, _ in before}
            fill = {}
            for r in after:
                fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
            assert max(fill.values()) <= packing.SEQ_LEN
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen)


def test_run_writes_all_stages(spark, frame, rows, folder, tmp_path):
    texts, languages = rows
    frame(texts, languages).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(zlib.crc32(b"") <= r["ids_crc32"] for r in got)
    assert {decontamination, ngram_join}  # the operators that the stages call


def test_empty_table(spark, frame, folder):
    docs = frame([])
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, folder[0]))
    assert docs.collect() == []


def test_short_lines_that_stand_nowhere_else_stay(spark, frame):
    licence = "This text is shared under a licence that many documents carry"
    poem = "\n".join(f"line {k}" for k in range(200))
    copied = "A long line of the first document, which a copy repeats\nHello\nBye"
    rows = [
        (1, licence),
        (2, licence + "\n" + poem),
        (3, copied),
        (4, copied),
        (5, licence + "\n \n"),
        (6, licence + "\nBye\nHello"),
        (7, licence + "\nHello\nBye"),
    ]
    got = corpus_pipeline.dedup_lines(spark, frame(rows), "").collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: licence, 2: poem, 3: copied, 6: "Bye\nHello"}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_text_in_several_languages_stays(spark, frame, rows, folder):
    """Sure words in three languages, none of which has half of them, and text of no language known."""
    texts, languages = rows
    names = list(SYLLABLES)
    mixed = "\n".join(made(names[k % len(names)], f"mix{k}", 20) for k in range(3 * len(names)))
    docs = frame([*texts, (5000, mixed)], languages)
    model = language.train(docs)
    told = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    if len(names) > 2:
        assert told[5000]["score"] < 0.5
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, folder[0]).collect()}
    assert 5000 in kept and 9006 not in kept
    sure = language.keep_identified(docs, model, least_certainty=1.01)
    assert sure.collect() == []


def test_texts_that_share_an_id_are_documents_of_their_own(spark, frame, prose):
    """Two texts under one id, the second of which is a near copy of a document with a smaller id."""
    copied = prose(1, 200)
    rows = [(3, copied), (7, prose(2, 200)), (7, copied + " more"), (9, prose(3, 200)), (9, prose(3, 200))]
    rows += [(None, copied), (None, copied), (11, copied), (2, prose(2, 200))]
    got = corpus_pipeline.drop_near_copies(spark, frame(rows), "").collect()
    kept = sorted(((r["doc_id"], r["text"]) for r in got), key=str)
    assert kept == sorted(
        [(3, copied), (2, prose(2, 200)), (9, prose(3, 200)), (None, copied), (None, copied)], key=str
    )


def test_columns_of_the_input_keep_their_values(spark, frame, rows, folder):
    texts, languages = rows
    docs = frame(texts, languages)
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, folder[0]))
        for r in docs.collect():
            assert all(r[c] == c for c in extra), name
