"""The pipeline's stages, each against brute force on its own input."""
import hashlib
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from propcube.llm import quality_cnn, source_mix
from propcube.llm.common import read, written
from propcube.llm.queries import tokenizer_path
from tests.llm.test_text_dedup import links

SF = "/root/testdata/sf0.001"


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_and_run_agree_with_brute_force(spark):
    from tokenizers import Tokenizer
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "tokens"]
    docs = read(spark, SF, "documents")
    labels = read(spark, SF, "labels")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, frames[-1], SF), f"test-{name}")
        if name != "tokens":
            assert out.dtypes == docs.dtypes
        frames.append(out)
    _, good, exact, near, mixed, tokens = frames

    scored = quality_cnn.quality_scores(docs, labels).where("predicted = 1").select("doc_id")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scored.collect())

    best = {}
    for i, t in texts(good):
        key = re.sub("[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(t or ""), i))
    assert sorted(r.doc_id for r in exact.collect()) == sorted(i for _, i in best.values())

    rows = texts(exact)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in links(rows, 5, 80).items() if c == i)

    taken = {r.doc_id: r.taken // r["size"] for r in source_mix.mix(near).where("taken > 0").collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(taken)

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation(), t.no_padding()
    want = []
    for i, x in texts(mixed):
        e = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in tokens.collect()]
    assert sorted(got) == sorted(want)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def test_stages_take_empty_tables(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
