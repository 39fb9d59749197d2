"""Quality classifier, language identification, license scan."""
import zlib

import numpy as np
import pytest

from propcube.llm import crf_langid, license_scan, quality_cnn
from propcube.llm.common import read

SF = "/root/testdata/sf0.01"


def test_quality_held_out_accuracy_and_empty_texts(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = quality_cnn.quality_scores(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    junk = [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(junk) < 0.4
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_odd_rows_and_no_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_cnn.quality_scores(docs, none).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (4, 7), (6, 1), (7, 0)],
                                   "doc_id long, quality int")
    scored = quality_cnn.quality_scores(docs, labels)
    assert scored.count() == docs.count() and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality_cnn.quality_scores(no_docs, labels).count() == 0


def test_quality_chunks_cover_long_texts_alike():
    model = quality_cnn.train(["###&&& $$$ ***" * 20, "plain words of a text " * 20] * 5, [0, 1] * 5, (1, 1), steps=30)
    texts = [b"", b"x", b"plain words " * 5000, b"ab" * 64, b"abc" * 171]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    whole = quality_cnn.score_texts(model, raw, offsets, step=1 << 30)
    one = quality_cnn.score_texts(model, raw, offsets, step=1)
    assert np.allclose(whole, one)
    grid, blocks = quality_cnn.padded(raw, offsets)
    member, first = quality_cnn.chunk_blocks(blocks)
    assert set(member.ravel()) == set(range(blocks.sum()))  # every block is in a chunk


def brute_marginals(score, move):
    from itertools import product
    t, k = score.shape
    p = np.zeros((t, k))
    for path in product(range(k), repeat=t):
        w = np.exp(sum(score[i, c] for i, c in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        for i, c in enumerate(path):
            p[i, c] += w
    return p / p.sum(axis=1, keepdims=True)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    model = crf_langid.Crf(["a", "b", "c"], None, rng.normal(size=(3, 3)))
    score = rng.normal(size=(12, 3))
    first, size = np.array([0, 5, 6]), np.array([5, 1, 6])
    got = model.marginals(score, first, size)
    for f, n in zip(first, size):
        assert np.allclose(got[f:f + n], brute_marginals(score[f:f + n], model.moves))


def test_language_held_out_accuracy(spark):
    docs = read(spark, SF, "documents")
    got = crf_langid.identify(docs)
    rows = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switched_words_are_labelled_one_by_one(spark):
    en, de = "the of and with that this there where", "der die und nicht auf mit schön straße"
    model = crf_langid.train([en] * 20 + [de] * 20, ["en"] * 20 + ["de"] * 20, steps=80)
    df = spark.createDataFrame([(1, f"{en} {de}"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.word_langs for r in crf_langid.label_words(df, model).collect()}
    assert got == {1: ["en"] * 8 + ["de"] * 8, 2: [], 3: []}


def test_language_odd_rows(spark, docs, no_docs):
    got = {r.doc_id: r for r in crf_langid.identify(docs).collect()}
    assert len(got) == docs.count()
    for i in (92, 93, 94):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in got.values()} == {"und", "en"}  # one language is known
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert crf_langid.identify(no_docs).count() == 0
    digits = spark.createDataFrame([(0, "123 456", "en"), (2, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in crf_langid.identify(digits).orderBy("doc_id").collect()] == ["und", "en"]


@pytest.fixture(scope="module")
def license_model(corpus):
    return license_scan.train([x for _, t in corpus for x in (t or "").split("\n")])


def test_license_families_unknowns_and_odd_rows(spark, docs, license_model):
    texts = {1: "Intro line\nLicensed under the Apache License, Version 2.0.\nmore", 2: "Released under the MIT License.",
             3: "This work is licensed under the GNU General Public License, version 3.", 4: None, 5: "", 6: " \n ",
             7: "He lost his driver license near the old station.", 8: "Released under the MIT License.\n"
             "Licensed under CC BY-NC 4.0.", 9: "words " * 50000, 10: "SPDX-License-Identifier: MPL-2.0"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in license_scan.scan(df, license_model).collect()}
    assert {i: r.families for i, r in got.items()} == {
        1: "Apache-2.0", 2: "MIT", 3: "GPL", 4: "", 5: "", 6: "", 7: "", 8: "CC,MIT", 9: "", 10: "MPL-2.0"}
    assert got[7].license == "none" and got[1].n_paragraphs == 3 and got[6].n_paragraphs == 0
    assert all(0 <= r.probability <= 1 for r in got.values())
    clean = license_scan.scan(docs, license_model)
    assert clean.count() == docs.count() and clean.where("license <> 'none'").count() == 0
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_lines_without_gate_words_have_no_feature(license_model):
    for name in license_model.features:
        assert any(w in license_model.gate for w in name.split(" "))


def test_license_wording_common_in_the_corpus_is_still_found(spark, corpus):
    grants = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
              "Redistribution and use in source and binary forms, with or without modification, are permitted",
              "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/")
    rows = [(i, (grants[i // 3 % 3] + "\n" if i % 3 == 0 else "") + (t or "")) for i, t in corpus]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.scan(df).collect()}
    assert got == {i: ("MIT", "BSD", "MPL-2.0")[i // 3 % 3] if i % 3 == 0 else "none" for i, _ in rows}
