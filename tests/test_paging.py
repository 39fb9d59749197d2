"""Deep pages by range counts equal the sorted whole."""
import random

import pytest
from pyspark.sql import functions as F

from propcube.operators import paging as P


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    names = ["", "a", "ab", "abc", "b", "ß", "日本", "🙂", "agent", "Agent"]
    data = [(i - 500, None if rng.random() < 0.1 else rng.randint(9000, 9040) if rng.random() < 0.9 else rng.randint(0, 20000),
             None if rng.random() < 0.1 else rng.choice(names) + rng.choice(["", "x", "zz"])) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, day int, name string").select("id", F.date_from_unix_date("day").alias("day"), "name")
    return df.repartition(4), df


@pytest.mark.parametrize("keys", [[P.SortKey("day", True), P.SortKey("id", True)], [P.SortKey("name"), P.SortKey("id")],
                                  [P.SortKey("name", True), P.SortKey("day"), P.SortKey("id", True)], [P.SortKey("id")]])
def test_pages_equal_the_sorted_whole(rows, keys, monkeypatch):
    monkeypatch.setattr(P, "BINS", 16)
    df, _ = rows
    want = [tuple(r) for r in df.orderBy(*[k.order() for k in keys]).collect()]
    for offset, size in ((0, 7), (1234, 40), (2690, 30), (2995, 20), (3000, 5), (9999, 5)):
        got = P.page(df, keys, offset, size, deep=0, few=50)
        assert [tuple(r) for r in got.collect()] == want[offset:offset + size], (offset, size)


def test_only_few_rows_are_sorted(rows):
    df, _ = rows
    keys = [P.SortKey("day", True), P.SortKey("id", True)]
    for part, offset, size in P.pieces(df, keys, 1500, 20, few=30):
        assert part.count() <= 30 and 0 <= offset < 30 and size <= 20
    assert P.pieces(df.limit(0), keys, 0, 5) == []
