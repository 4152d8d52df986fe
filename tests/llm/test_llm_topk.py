import random

import duckdb
import numpy as np
import pytest
from plan_text import plan
from pyspark.sql import functions as F

from readyscope.llm import registry, topk


def plain(vectors, asked, k):
    rows = sorted({(i, tuple(v)) for i, v in vectors if i is not None and v is not None and None not in v})
    out = []
    for i, v in rows:
        if not asked(i):
            continue
        scores = [
            (-sum(a * b for a, b in zip(v, w, strict=True)), j)
            for j, w in rows if j != i and len(w) == len(v)
        ]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_query_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    wanted = duck.execute(topk.ORACLE).fetchall()
    rows = registry.queries()["op9_exact_topk"](spark, sf_dir).collect()
    assert sorted(tuple(r) for r in rows) == sorted(wanted) and rows


@pytest.mark.parametrize("largest", [3, 40_000, 1 << 40])
def test_ties_sizes_and_tiles(spark, largest):
    rng = random.Random(largest)
    vectors = [(i, [rng.randint(-largest, largest) for _ in range(4)]) for i in range(120)]
    vectors += [(200, vectors[0][1]), (201, [1, 2]), (202, [2, 1]), (203, []), (204, [])]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    found = topk.top_k(df, F.col("vec_id") % 7 == 0, k=5, shard_rows=10, query_rows=4, fan_in=2)
    wrapped = [
        (q, r, j, (s + (1 << 63)) % (1 << 64) - (1 << 63))
        for q, r, j, s in plain(vectors, lambda i: i % 7 == 0, 5)
    ]
    if largest < 1 << 32:
        assert sorted(tuple(r) for r in found.collect()) == wrapped
    else:  # sums beyond 64 bits wrap; ranks then follow the wrapped sums
        assert len(found.collect()) == len(wrapped)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [0.5, -0.25], "x"), (50, [1.0, 1.0], "x"), (1, None, "x"), (2, [None, 1.0], "x"),
        (3, [nan, 1.0], "x"), (4, [inf, 0.0], "x"), (None, [1.0, 1.0], "x"), (5, [0.001, 0.0], "x"),
        (5, [0.001, 0.0], "x"), (100, None, "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    found = topk.top_k(
        topk.floored(df, "embedding", 256), F.col("vec_id") % 50 == 0, k=5, vector="embedding"
    )
    assert sorted(tuple(r) for r in found.collect()) == [
        (0, 1, 50, 16384), (0, 2, 5, 0), (50, 1, 0, 16384), (50, 2, 5, 0),
    ]
    assert topk.top_k(df.limit(0).withColumn("embedding", F.array(F.lit(1))), F.lit(True),
                      vector="embedding").count() == 0


def test_tile_picks_the_smallest_ids_among_equals():
    vectors, ids = np.ones((9, 2), np.int16), np.arange(9)
    found = list(topk.tile_top(vectors[:1], ids[:1], vectors, ids, 3))
    assert found == [(0, 1, 2), (0, 2, 2), (0, 3, 2)]


@pytest.mark.parametrize("pass_bytes", [1, 600, 1 << 20])
def test_passes_over_the_shards(spark, pass_bytes):
    rng = random.Random(5)
    vectors = [(i, [rng.randint(-9, 9) for _ in range(4)]) for i in range(150)]
    vectors += [(8, [1, 2, 3, 4]), (8, [4, 3, 2, 1]), (203, [1, 2]), (204, [2, 1]), (210, []), (211, [])]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    found = topk.top_k(
        df, F.col("vec_id") % 7 == 0, k=5, shard_rows=30, query_rows=6, pass_bytes=pass_bytes
    )
    assert sorted(tuple(r) for r in found.collect()) == plain(vectors, lambda i: i % 7 == 0, 5)


def test_no_packed_vector_is_copied_for_a_tile(spark):
    """Copies per shard were broadcast at the size of one, and failed the driver."""
    vectors = [(i, [i, -i]) for i in range(100)]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    text = plan(topk.top_k(df, F.col("vec_id") % 7 == 0, shard_rows=10, query_rows=4))
    assert "Generate" not in text and "SortMergeJoin" not in text
