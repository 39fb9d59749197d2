"""The trained operators, scored again in plain Python."""
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from propcube.llm import crf_langid, license_scan, quality_cnn
from propcube.llm.common import crc_of, read

SF = "/root/testdata/sf0.001"


def plain_quality(m: quality_cnn.Model, text: bytes) -> float:
    """One text, byte by byte."""
    b, lags = quality_cnn.BLOCK, list(quality_cnn.LAGS)
    blocks = max(1, -(-(len(text) + lags[-1]) // b))
    grid = list(text) + [0] * (blocks * b - len(text) + quality_cnn.WIDTH)
    pooled, same = [], []
    for k in range(blocks):
        at = list(range(k * b, (k + 1) * b, quality_cnn.STRIDE))
        r = np.array([sum(m.tables[j][grid[p + j]] for j in range(quality_cnn.WIDTH)) for p in at])
        if k == blocks - 1:
            r[-1] = r[-2]
        pooled.append(r.max(axis=0))
        near = max(sum(1 for p in range(k * b, (k + 1) * b) if p >= lag and grid[p] and grid[p] == grid[p - lag]) for lag in lags)
        same.append(near * quality_cnn.SAME_SCALE / b)
    logits = []
    for c in range(max(1, -(-(blocks - 1) // quality_cnn.CHUNK_STEP))):
        member = [min(c * quality_cnn.CHUNK_STEP + i, blocks - 1) for i in range(quality_cnn.CHUNK_BLOCKS)]
        x = [*np.maximum(np.max([pooled[i] for i in member], axis=0) + m.bias, 0),
             np.mean([same[i] for i in member]), max(same[i] for i in member)]
        logits.append(float(np.dot(x, m.chunk_w) + m.chunk_b))
    z = float(np.dot([np.mean(logits), min(logits), max(logits)], m.doc_w) + m.doc_b)
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_quality_query_equals_plain_scoring(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = quality_cnn.fit(docs, labels, quality_cnn.learnable())
    got = {r.doc_id: r for r in quality_cnn.quality_scores(docs, labels).collect()}
    rows = sorted(((r.doc_id, (r.text or "").encode()) for r in docs.collect()), key=lambda r: len(r[1]))
    assert len(got) == len(rows)
    for i, t in rows[:25] + rows[60:70]:
        want = plain_quality(model, t)
        assert got[i].score == pytest.approx(want, abs=1e-4)
        assert got[i].predicted == int(got[i].score >= 0.3)


def plain_licenses(m: license_scan.Model, text: str):
    lines = [x for x in text.split("\n") if x.strip(" ") != ""]
    gate = re.compile(license_scan._gate(m))
    out = []
    for n, line in enumerate(lines):
        if not gate.search(line):
            continue
        words = re.sub("[^a-z0-9]+", " ", line.lower()).strip(" ")
        z = np.array(m.bias)
        for name, w in zip(m.features, m.weights):
            if f" {name} " in f" {words} ":
                z = z + np.array(w)
        c = int(z.argmax())
        held = set(words.split(" "))
        own = [set(license_scan.tokens(t)) for t in license_scan.TEMPLATES.get(m.classes[c], ())]
        agree = max([0.0, *[max(len(held & o) / len(held), len(held & o) / len(o)) for o in own]])
        out.append((n, m.classes[c], float(1 / np.exp(z - z[c]).sum()), agree))
    return len(lines), out


def test_license_paragraphs_equal_plain_scoring(spark):
    texts = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"intro line\n{t.upper()}\n\n  \nlast {t[:40]}") for i, t in enumerate(texts)]
    rows += [(200, None), (201, ""), (202, "no license here at all, copyright water"), (203, "\n".join(texts) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(
        read(spark, SF, "documents").select("doc_id", "text").selectExpr("doc_id + 1000 AS doc_id", "text"))
    model = license_scan.fit(docs)
    for r in license_scan.paragraphs(docs, model).join(docs, "doc_id").collect():
        n, want = plain_licenses(model, r.text or "")
        assert (r.n_paragraphs, r.n_scored) == (n, len(want))
        for p, (k, family, prob, agree) in zip(r.found, want):
            assert (p.paragraph, p.family) == (k, family)
            assert p.probability == pytest.approx(prob, abs=1e-9) and p.agreement == pytest.approx(agree, abs=1e-12)


def test_language_query_equals_its_model_on_each_text(spark):
    docs = read(spark, SF, "documents")
    model = crf_langid.fit(docs, crf_langid.learnable())
    got = {r.doc_id: r for r in crf_langid.identify(docs).collect()}
    held = {r.doc_id: r.h for r in docs.select("doc_id", (crc_of("doc_id") % 3 == 1).alias("h")).collect()}
    for r in docs.collect():
        one = crf_langid._doc_result(model, pa.array([r.text or ""]))[0].as_py()
        letters = any(c.isalpha() for c in r.text or "")
        g = got[r.doc_id]
        assert g.held_out == held[r.doc_id]
        assert (g.lang_pred, g.score) == ((one["lang_pred"], one["score"]) if letters else ("und", 0.0))
