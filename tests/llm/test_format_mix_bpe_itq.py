"""Chat formatting, source mix, BPE and embedding near-dedup."""
import hashlib
import json
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from propcube.llm import bpe, chat_format, itq_dedup, source_mix
from propcube.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


# -- BPE ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation(), t.no_padding()
    return t


def test_bpe_equals_the_library(library):
    mine = bpe.WordBpe(open(tokenizer_path(), encoding="utf-8").read())
    rng = random.Random(2)
    texts = ["", " ", "<|endoftext|>hi<|startoftext|>", "I'm you'll HE'S", "ΟΔΟΣ Σ ΣΑΣ ς", "İstanbul", "éä x",
             "a\x1cb!\x1c!", "x\x85y\xa0z", "日本語 テスト", "🙂👍🏽", "½² ①", "<|endoftext|", "\x00a", "word " * 5000, "b" * 5000]
    texts += ["".join(rng.choice("aB'sSdD .\ńé<|endoftext|>Σσ12½ \x1d日!?") for _ in range(rng.randint(1, 40)))
              for _ in range(500)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = mine.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, t
        assert mine.decode(got) == library.decode(want, skip_special_tokens=False), t


def test_bpe_of_documents(docs, no_docs, corpus, library):
    got = {r[0]: tuple(r[1:]) for r in bpe.encode_documents(docs, tokenizer_path()).collect()}
    for i, t in corpus:
        e = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest())
    ids = {r.doc_id: r.ids for r in bpe.token_ids(docs, tokenizer_path()).collect()}
    assert {i: len(v) for i, v in ids.items()} == {i: v[0] for i, v in got.items()}
    assert bpe.encode_documents(no_docs, tokenizer_path()).count() == 0


# -- mixing --------------------------------------------------------------------------

def test_mix_meets_targets_and_agrees_with_reruns(docs, corpus):
    rows = source_mix.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, source_mix.mix(docs.repartition(2)).collect())) \
        or {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in source_mix.mix(docs.repartition(2)).collect()}
    size = {i: len(re.findall("[^\x20\x09-\x0D]+", t or "")) for i, t in corpus}
    assert {r.doc_id: r["size"] for r in rows} == size
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(size.values())) < 1e-6
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken <= 3 * r["size"] and r["size"] * (r.taken // max(1, r["size"])) == r.taken
    for m in by.values():
        assert m[0].source_size == sum(r["size"] for r in m) and m[0].target <= 3 * m[0].source_size
        assert abs(sum(r.taken for r in m) - m[0].target) <= max(r["size"] for r in m)


def test_mix_caps_and_shares_the_excess_by_weight(spark):
    rows = [(i, "w " * 10, "a") for i in range(300)] + [(1000, "w " * 10, "b")] + [(2000 + i, "w " * 10, None) for i in range(99)]
    got = {r.source: r.target for r in source_mix.mix(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # b stops at 3 * 10; the other 3970 go 1 : 3, and null stops at 3 * 990
    assert got == {"b": 30.0, None: 2970.0, "a": 1000.0}


def test_mixed_documents_repeat_rows_and_keep_columns(docs, no_docs):
    out = source_mix.mixed_documents(docs)
    assert out.columns == docs.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.taken // r["size"] for r in source_mix.mix(docs).where("taken > 0").collect()}
    assert n == want
    assert source_mix.mix(no_docs).count() == 0 and source_mix.mixed_documents(no_docs).count() == 0


# -- chat formatting -------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "<s><s>", "<", "[", "</s", "a\\</s>\\", "", "\n[/INST]\n", "日本🙂 </s>"]


def test_round_trip_and_loss_mask(spark):
    turns = [(r, t) for t in NASTY for r in ("user", "assistant", "</s>odd[INST]")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, 0, None, None), (2, 0, "assistant", "b"), (None, 5, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    made = chat_format.formatted(chat_format.canonical(df, "conv_id"))
    back = {r.conv_id: r for r in made.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"),
            chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert [tuple(t) for t in back[1].t] == turns
    assert back[1].l == "".join(NASTY)
    assert [tuple(t) for t in back[2].t] == [("", ""), ("assistant", "b")] and back[2].l == "b"
    assert [tuple(t) for t in back[None].t] == [("user", "x")]
    body = back[1].formatted
    assert body.count("</s>") == body.count("<s>") == body.count("[INST]") == len(turns)


def test_layouts_are_found_by_fingerprint(spark):
    data = {
        1: {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        3: {"instruction": "q", "output": "a"}, 4: {"instruction": "q", "input": "i", "output": "a"},
        5: {"prompt": "q", "response": "a"}, 6: {"question": "q", "answer": "a"},
        7: {"system": "s", "prompt": "q", "response": "a"}, 8: {"other": 1}, 10: {"prompt": "q", "completion": "a"},
    }
    rows = [(i, json.dumps(v)) for i, v in data.items()] + [(9, "not json"), (11, None)]
    got = {r.conv_id: r.turns for r in chat_format.canonical_json(
        spark.createDataFrame(rows, "id long, doc string"), "id", "doc").collect()}
    plain = [("user", "q"), ("assistant", "a")]
    want = {i: plain for i in (1, 2, 3, 5, 6, 10)} | {4: [("user", "q\n\ni"), ("assistant", "a")],
            7: [("system", "s"), *plain], 8: None, 9: None, 11: None}
    assert {i: t and [tuple(x) for x in t] for i, t in got.items()} == want
    typed = spark.createDataFrame([(1, "q", "a")], "id long, prompt string, response string")
    assert [tuple(x) for x in chat_format.canonical(typed, "id").first().turns] == plain
    other = spark.createDataFrame([(1, 2)], "id long, z long")
    assert chat_format.canonical(other, "id").first().turns is None


def test_formatting_an_empty_table_and_empty_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.formatted(chat_format.canonical(none, "conv_id"))).count() == 0
    empty = spark.createDataFrame([(1, [])], f"conv_id long, turns array<{chat_format.TURN}>")
    r = chat_format.digests(chat_format.formatted(empty)).first()
    assert (r.n_turns, r.loss_chars, r.formatted_chars) == (0, 0, 0)


# -- embeddings --------------------------------------------------------------------------

def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 32)).astype(np.float32)
    near = np.repeat(base[:40], 6, axis=0) + 0.12 * rng.normal(size=(240, 32)).astype(np.float32)
    x = np.vstack([base, near, base[:10], base[:10], np.tile(base[50], (1500, 1)) + 0.02 * rng.normal(size=(1500, 32))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(9000, None, 1), (9001, [0.0] * 32, 1), (9002, [float("nan")] * 32, 1), (9003, [None] + [1.0] * 31, 1),
           (9004, [1.0, 2.0], 1), (9005, [], 1), (9006, [float("inf")] + [1.0] * 31, 1), (None, base[0].tolist(), 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int").repartition(4)
    got = {r.vec_id: r for r in itq_dedup.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    want = hit.sum(axis=1)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= want).all() and links.sum() >= 0.9 * want.sum()
    label = np.arange(len(x))
    for _ in range(50):
        label = np.minimum(label, np.where(hit, label, len(x)).min(axis=1))
    same = np.mean([got[i].component_id == label[i] for i in range(len(x))])
    assert same > 0.95 and all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    for i in [r[0] for r in odd]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert itq_dedup.near_duplicates(df.limit(0)).count() == 0
    assert itq_dedup.near_duplicates(df.where("vec_id >= 9000")).count() == 7


def test_plan_keeps_buckets_small_as_tables_grow():
    for n in (10, 10 ** 4, 10 ** 7, 10 ** 9):
        bits, tables = itq_dedup.plan(n, 0.95)
        assert n / 2 ** bits <= 2 and tables <= 120


@pytest.mark.parametrize("share", [0.0, 0.5, 0.8])
def test_pairs_just_above_the_threshold_are_found_with_a_common_mean(share):
    rng = np.random.default_rng(1)
    g = itq_dedup.unit(rng.normal(size=(10_000, 64)))
    x = itq_dedup.unit(np.sqrt(share) * np.eye(64)[0] + np.sqrt(1 - share) * g)
    coder = itq_dedup.Coder(x[:itq_dedup.SAMPLE], len(x), 0.95)
    a = x[-4000:]
    w = rng.normal(size=a.shape)
    w = itq_dedup.unit(w - (w * a).sum(axis=1, keepdims=True) * a)
    b = 0.951 * a + np.sqrt(1 - 0.951 ** 2) * w
    assert (coder.codes(a) == coder.codes(b)).any(axis=1).mean() > 0.95


def test_links_are_found_with_a_common_mean(spark):
    rng = np.random.default_rng(2)
    x = itq_dedup.unit(np.sqrt(0.8) * np.eye(64)[0] + np.sqrt(0.2) * itq_dedup.unit(rng.normal(size=(3000, 64))))
    w = rng.normal(size=x.shape)
    w = itq_dedup.unit(w - (w * x).sum(axis=1, keepdims=True) * x)
    x = np.concatenate([x, 0.952 * x + np.sqrt(1 - 0.952 ** 2) * w]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = itq_dedup.unit(x)
    want = np.triu(u @ u.T >= 0.95, 1).sum()
    got = sum(r.n_links for r in itq_dedup.near_duplicates(df).collect()) / 2
    assert 0.95 * want <= got <= want
