"""Exact dedup, Jaccard join and substring dedup against brute force."""
import hashlib
import re
from collections import defaultdict

import pytest

from propcube.llm import components, exact_dedup, jaccard_join, substring_dedup

SPACE = "[\x20\x09-\x0D]"
WORD = re.compile("[^\x20\x09-\x0D]+")


def by_id(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *cols).collect()}


def test_exact_dedup_equals_brute_force(docs, corpus):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), i))
    want = {i: (min(m)[1], len(m), i == min(m)[1], hashlib.sha256(n.encode()).hexdigest())
            for n, m in groups.items() for _, i in m}
    assert by_id(exact_dedup.exact_dedup(docs, digest_all=True), "keep_id", "group_size", "kept", "text_sha256") == want
    lazy = by_id(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256")
    assert {i: v[:3] for i, v in lazy.items()} == {i: v[:3] for i, v in want.items()}
    assert all(v[3] in (None, want[i][3]) for i, v in lazy.items())
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in want.items() if v[2])


def test_exact_dedup_repeated_rows_null_ids_and_empty_table(spark, no_docs):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (2, "ab "), (3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [(-1, -1, 1, True), (-1, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True),
                   (2, 1, 4, False), (3, 3, 1, True)]
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def links(corpus, k, percent):
    sets = {}
    for i, t in corpus:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components_equal_brute_force(docs, corpus, k, percent):
    want = links(corpus, k, percent)
    got = by_id(jaccard_join.jaccard_components(docs, k, percent), "n_shingles", "component_id")
    assert got == want
    assert any(c != i for i, (_, c) in want.items())


def test_jaccard_repeated_rows_null_ids_and_empty_table(spark, no_docs):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"),
                                (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1)
                 for r in jaccard_join.jaccard_components(df, 5, 80).collect())
    assert got == [(-1, 2, -1), (2, 2, 2), (5, 2, 2), (5, 2, 2), (7, 0, 7)]
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_keep_one_leaves_the_least_id_and_all_columns(docs, corpus):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in links(corpus, 5, 80).items() if c == i)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def removed(corpus):
    first, split = {}, {}
    for i, t in corpus:
        w = split[i] = WORD.findall(t or "")
        for j in range(len(w) - 12):
            key = tuple(w[j:j + 13])
            first[key] = min(first.get(key, i), i)
    want = {}
    for i, w in split.items():
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < i:
                gone.update(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return want


def test_substring_dedup_equals_brute_force(docs, corpus):
    got = by_id(substring_dedup.dedup_substrings(docs, with_text=True), "n_words", "n_removed", "kept_sha256", "kept")
    want = removed(corpus)
    assert got == want
    assert sum(v[1] > 0 for v in want.values()) > 20


def test_substring_dedup_of_heavy_bins_finds_the_same(docs, corpus, monkeypatch):
    import numpy as np
    monkeypatch.setattr(substring_dedup, "bin_counts", lambda d: np.full(substring_dedup.BINS, 10 ** 6))
    got = by_id(substring_dedup.dedup_substrings(docs), "n_words", "n_removed", "kept_sha256")
    assert got == {i: v[:3] for i, v in removed(corpus).items()}


def test_substring_dedup_null_ids_and_empty_table(spark, no_docs):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed)
                 for r in substring_dedup.dedup_substrings(df).collect())
    assert got == [(-1, 0, 0), (-1, 20, 20), (3, 20, 0), (3, 20, 0)]
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_rows_go_one_by_one_with_null_ids_and_an_id_of_two_texts(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x"
    other = "the second text of one id has words and links of its own"
    rows = [(2, near), (None, near), (None, "a clean text of no id that nobody copies"), (None, "another clean text of no id"),
            (5, near), (5, other), (7, other), (8, near + " y"), (9, other + " now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for keep, want in ((exact_dedup.drop_duplicates, [rows[0], *rows[2:4], rows[5], *rows[7:]]),
                       (jaccard_join.keep_one, [rows[0], *rows[2:4], rows[5]])):
        assert sorted(map(tuple, keep(df).collect()), key=key) == sorted(want, key=key)


def test_jaccard_an_id_has_the_links_of_all_its_texts(spark):
    a, b = "a b c d e f g h i j k l m n o p", "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(5, a), (5, b), (2, a + " q"), (7, b + " twelve"), (8, "none of these words is shared")],
                               "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df, 5, 80).collect()}
    assert got == {(5, 2), (2, 2), (7, 2), (8, 8)}


def test_one_of_repeated_rows_stays(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text, "s1"), (1, text, "s0"), (1, text, "s0"), (None, text, "s2"), (2, "z", "s3"), (2, "z", "s3"),
            (None, "null id", "s4"), (None, "null id", "s4"), (None, "nul lid", "s5"), (3, None, "s6"), (3, "", "s6")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(((r.doc_id or -1, r.source) for r in exact_dedup.drop_duplicates(df).collect()))
    assert len(kept) == 4 and kept[1:] == [(1, "s0"), (2, "s3"), (3, "s6")] and kept[0] in [(-1, "s4"), (-1, "s5")]
    kept = sorted((r.doc_id or -1, r.source) for r in jaccard_join.keep_one(df).collect())
    assert kept == [(-1, "s4"), (-1, "s5"), (1, "s0"), (2, "s3"), (3, "s6"), (3, "s6")]


def test_substring_dedup_rows_of_one_id_keep_their_own_words(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    clean = " ".join(f"c{i}" for i in range(40))
    mine = " ".join(f"m{i}" for i in range(40))
    rows = [(5, passage), (None, passage + " and more"), (None, clean), (None, "x " + passage), (9, passage + " end"),
            (9, mine), (9, mine), (9, clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.kept) for r in substring_dedup.dedup_substrings(df, with_text=True).collect())
    assert got == sorted([(5, passage), (-1, "and more"), (-1, ""), (-1, "x"), (9, "end"), (9, mine), (9, mine), (9, clean)])
