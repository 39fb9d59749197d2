"""What the near stage moves: only texts and bitmaps that may matter."""
import random

import numpy as np
from pyspark.sql import functions as F

from propcube.llm import common, jaccard_join


def test_rows_that_match_no_key_are_told_apart_without_a_shuffle(spark):
    rows = spark.range(2000).select("id", F.xxhash64("id").alias("k"))
    keys = rows.where("id % 100 = 0").select(F.col("k").alias("key"))
    marked = common.may_match(rows, "k", keys)
    assert marked.columns == ["id", "k", "__may"]
    got = {r.id: r["__may"] for r in marked.collect()}
    assert len(got) == 2000 and all(got[i] for i in range(0, 2000, 100)) and sum(got.values()) < 30
    none = common.may_match(rows, "k", keys.limit(0))
    assert none.where("__may IS NULL OR __may").count() == 0 and none.count() == 2000


def test_prefixes_in_the_final_order_need_no_texts_where_the_sketch_suffices(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 99)}" for _ in range(40 + i))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs, sketch, order = jaccard_join.sketched(docs, 5, 80, "doc_id", "text")
    nodes = sketch.withColumnRenamed("row", "node")
    before = {r.node: r for r in nodes.collect()}
    hot = np.zeros(1 << (jaccard_join.HOT_BITS - 6), np.uint64)
    for r in before.values():  # one hot shingle in each prefix
        at = r.prefix[0] & ((1 << jaccard_join.HOT_BITS) - 1)
        hot[at >> 6] |= np.uint64(1 << (at & 63))
    bits = spark.sparkContext.broadcast(hot)
    got = {r.id: r.prefix for r in jaccard_join.settled(nodes, docs.limit(0), order, bits, 5, 80).collect()}
    held = lambda v: jaccard_join.is_set(hot, np.array([v], np.int64).view(np.uint64))[0]
    assert got == {i: [v for v in [*r.prefix, *r.more] if not held(v)][:len(r.prefix)] for i, r in before.items()}
    hot[:] = ~np.uint64(0)  # all shingles: only the texts tell the order
    bits = spark.sparkContext.broadcast(hot)
    got = {r.id: r.prefix for r in jaccard_join.settled(nodes, docs, order, bits, 5, 80).collect()}
    assert got == {i: r.prefix for i, r in before.items()}


def test_pairs_of_a_tile_are_those_that_a_link_allows(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        n, comp = rng.randint(20, 60), rng.choice([i, i, 3, 7])
        for token in rng.sample(range(12), 4):
            rows.append((token, rng.randint(0, n // 5), i, n, comp, comp == i and i not in (3, 7)))
    tiles = spark.createDataFrame(rows, "token long, pos long, id long, n long, comp long, alone boolean") \
        .withColumn("band", jaccard_join.band_of(F.col("n"), 80))
    want = {(a[2], b[2]) for a in rows for b in rows
            if a[0] == b[0] and a[2] < b[2] and (a[4] != b[4]) and 100 * min(a[3], b[3]) >= 80 * max(a[3], b[3])
            and min(a[3] - a[1], b[3] - b[1]) * 180 >= 80 * (a[3] + b[3])}
    assert len(want) > 100
    assert {(r.a, r.b) for r in jaccard_join.prefix_pairs(tiles, 80).collect()} == want


def test_the_smaller_set_of_a_tile_stands_only_where_a_link_allows(spark):
    """200 sets that share one shingle behind the places of a link: none goes into the join's smaller side."""
    tiles = spark.range(200).select(F.lit(1).cast("long").alias("token"), F.lit(25).cast("long").alias("pos"), "id",
                                    F.lit(146).cast("long").alias("n"), F.col("id").alias("comp"), F.lit(True).alias("alone")) \
        .withColumn("band", jaccard_join.band_of(F.col("n"), 80))
    pairs = jaccard_join.prefix_pairs(common.written(tiles, "tiles"), 80)
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "* 160" in plan.replace(")", "")  # 2 * percent * n, a filter below the explode


def test_a_stage_of_near_feeds_one_python_worker_a_task(spark):
    """Each Python step that is chained to another in a stage keeps a worker (some 90 MB) of its own beside it."""
    rows = common.written(spark.range(3000).select("id", F.col("id").alias("node"), F.lit("x").alias("text")), "rows")
    ids = common.written(spark.range(0, 3000, 100), "ids")
    got = jaccard_join.narrowed(rows, ids, "node")
    assert got.columns == rows.columns
    kept = {r.node for r in got.collect()}
    assert kept >= set(range(0, 3000, 100)) and len(kept) < 60
    assert jaccard_join.narrowed(rows, ids.limit(0)).count() == 0
    rng = random.Random(7)
    texts = [(i, " ".join(f"w{rng.randint(0, 999)}" for _ in range(50))) for i in range(40)]
    docs, sketch, order = jaccard_join.sketched(spark.createDataFrame(texts, "doc_id long, text string"), 5, 80, "doc_id", "text")
    nodes = jaccard_join.narrowed(sketch.withColumnRenamed("row", "node"), sketch.select(F.col("row").alias("id")), "node")
    bits = spark.sparkContext.broadcast(np.zeros(1 << (jaccard_join.HOT_BITS - 6), np.uint64))
    final = jaccard_join.settled(nodes, docs, order, bits, 5, 80)
    assert final.count() == 40
    plan = final._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 2  # one for each side of the union


def test_prefixes_are_read_in_pieces(spark):
    import pyarrow as pa

    lists = [[1, 2, 3], [], [4], list(range(10, 30)), [5, 6]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([[9]] + lists, pa.list_(pa.int64()))], ["id", "prefix"]).slice(1)
    for step in (1, 3, 100):
        got = []
        for rows, first, token in jaccard_join.prefixes([batch], step):
            assert len(first) == rows.num_rows + 1 and first[0] == 0 and first[-1] == len(token)
            assert len(token) <= max(step, 20)
            got += [(i, token[a:b].tolist()) for i, a, b in zip(rows.column("id").to_pylist(), first[:-1], first[1:])]
        assert got == list(zip(range(1, 6), lists))
