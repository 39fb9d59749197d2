"""Results that must not depend on batches, sizes or neighbours."""
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from propcube.llm import bpe, crf_langid, itq_dedup
from propcube.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    words = {"a": "der die das und nicht wasser straße".split(), "b": "the and not water street over".split(),
             "c": "le la les et pas eau rue où".split()}
    texts = [(" ".join(rng.choice(w) for _ in range(rng.randint(3, 60))), k) for k, w in words.items() for _ in range(30)]
    return crf_langid.train([t for t, _ in texts], [k for _, k in texts], steps=40)


def test_language_of_a_text_is_the_same_in_any_batch(model):
    rng = random.Random(5)
    alphabet = "der the le où straße x\n\t é日 ".split(" ") + ["\n", " ", ""]
    texts = ["", " ", "x", "der", "the\n", "où"] + [" ".join(rng.choice(alphabet) for _ in range(rng.randint(1, 700))) for _ in range(120)]
    alone = [crf_langid._doc_result(model, pa.array([t]))[0].as_py() for t in texts]
    for size in (2, 7, len(texts)):
        order = rng.sample(range(len(texts)), len(texts))
        for lo in range(0, len(order), size):
            part = order[lo:lo + size]
            got = crf_langid._doc_result(model, pa.array([texts[i] for i in part])).to_pylist()
            assert got == [alone[i] for i in part]


def test_a_language_of_long_texts_only_is_learned_and_repeated_ids_stay_few(spark):
    long = "vesi ja katu ei ole vettä " * 4000
    rows = [(i, "the water and the street not over " * 5, "en") for i in range(40)]
    rows += [(100 + i, long + str(i), "fi") for i in range(40)] + [(7, f"the water {i}", "en") for i in range(500)]
    rows += [(None, "the street", "en"), (200, None, "fi"), (201, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    fitted = crf_langid.fit(docs, F.lit(True), per_lang=20)
    assert fitted.langs == ["en", "fi"]
    shown = crf_langid._doc_result(fitted, pa.array(["vesi ja katu ei ole", "the water and the street"])).to_pylist()
    assert [r["lang_pred"] for r in shown] == ["fi", "en"]
    got = crf_langid.identify(docs)
    assert got.count() == len(rows)
    assert got.where("doc_id = 200").first().lang_pred == "und"


@pytest.fixture(scope="module")
def mine():
    return bpe.WordBpe(open(tokenizer_path(), encoding="utf-8").read())


def test_long_words_have_the_ids_of_the_scan(mine, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeinorst" if i % 2 else "aab") for _ in range(rng.randint(257, 1500))) for i in range(60)]
    by_heap = [mine.word(t) for t in texts]
    monkeypatch.setattr(bpe, "SHORT", 1 << 30)
    assert by_heap == [mine.word(t) for t in texts]


def test_time_of_a_long_word_is_about_linear(mine):
    def seconds(n):
        text = "".join(random.Random(n).choice("abcdeinorst") for _ in range(n))
        begin = time.perf_counter()
        mine.word(text)
        return time.perf_counter() - begin
    seconds(10_000)
    assert seconds(320_000) < 32 * max(0.02, seconds(20_000))


def test_remembered_results_are_bounded_by_bytes(mine):
    rng = random.Random(2)
    want = {}
    for i in range(60_000):
        w = "w" + "".join(rng.choice("abcdefghij") for _ in range(150))
        got = mine.encode(w)
        if i < 20:
            want[w] = got
    for kept in (mine.cache, mine.known):
        assert kept.old and sum(160 + 2 * len(k) + len(v) for d in (kept.young, kept.old) for k, v in d.items()) <= bpe.CACHE
    assert all(mine.encode(w) == v for w, v in want.items())


def unit_vectors(rng, n, d, share):
    """Vectors whose mean holds ``share`` of the squared norm, and pairs just
    above the threshold."""
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.sqrt(1 - share) * x + np.sqrt(share) * np.eye(d)[0]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n, share", [(500, 0.0), (500, 0.8), (10_000, 0.0), (10_000, 0.8)])
def test_embedding_pairs_are_found_through_tables(n, share):
    rng = np.random.default_rng(n)
    x = unit_vectors(rng, n, 64, share)
    a, b = itq_dedup.pairs_at(x, 0.951, rng)
    coder = itq_dedup.Coder(x[:itq_dedup.SAMPLE], n, 0.95)
    assert coder.bits >= 6
    assert (coder.codes(a) == coder.codes(b)).any(axis=1).mean() >= 0.9


def test_chat_layouts_ignore_extra_fields_and_unknown_ones_are_counted(spark):
    from propcube.llm import chat_format as C
    rows = spark.createDataFrame([(1, 0, "user", "q", 5, "m"), (1, 1, "assistant", "a", None, None), (2, 0, None, None, 1, "x")],
                                 "conv_id long, turn long, role string, text string, score int, layout string")
    made = C.canonical(rows, "conv_id")
    assert {r.conv_id: ([tuple(t) for t in r.turns], r.layout) for r in made.collect()} == {
        1: ([("user", "q"), ("assistant", "a")], "turn_rows"), 2: ([("", "")], "turn_rows")}
    texts = ['{"messages": [{"role": "user", "content": "q", "id": 7}, {"role": "assistant", "content": "a"}], "meta": {"x": [1]}}',
             '{"prompt": "p", "response": "r", "score": 0.5, "tags": ["a"]}', '{"strange": 1}', "no json", None, "[1]", '"text"',
             '{"instruction": "i", "input": "", "output": "o", "uid": null}']
    df = spark.createDataFrame(list(enumerate(texts)), "conv_id int, j string")
    found = C.canonical_json(df, "conv_id", "j")
    got = {r.conv_id: (r.turns and [tuple(t) for t in r.turns], r.layout) for r in found.collect()}
    assert got == {0: ([("user", "q"), ("assistant", "a")], "messages"), 1: ([("user", "p"), ("assistant", "r")], "prompt"),
                   2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None),
                   7: ([("user", "i"), ("assistant", "o")], "instruction_input")}
    assert tuple(C.unknown_layouts(found).first()) == (5, 8)
    assert {r.conv_id for r in C.formatted(found).where("formatted IS NULL").collect()} == {2, 3, 4, 5, 6}
