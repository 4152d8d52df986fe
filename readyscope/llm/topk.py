"""Exact nearest vectors by integer inner product: tiled matrix products.

Vectors are packed into shards of bounded size, the queries among them into blocks of
bounded size. A tile is one query block against one shard: a matrix product, of which
each query keeps its best ``k``. The short lists are merged in a tree, ``FAN_IN`` of
them at a time, so that no merge grows with the number of shards.

The blocks go to the shards by broadcast, as many as make ``PASS_BYTES`` at a time, and
every such pass reads all shards where they are stored: no packed vector is shuffled or
copied for a tile, and the driver never holds more than the blocks of a pass.

Defined results: vectors that are null, or hold a null or a component that is not
finite, take no part; the empty vector takes part with score zero. Only vectors of the
query's length are candidates. Rows that repeat both id and vector count once; a
row never matches a query with its own id; rows without an id take no part. Equal scores
rank by the smaller id. Scores are exact: products that could pass 2^53 are summed as
integers instead of floats, modulo 2^64.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readyscope.llm.common import lean, stored
from readyscope.sources.scratch import shared_directory

SHARD_ROWS = 2048
QUERY_ROWS = 1024
PASS_BYTES = 16 * 1024 * 1024
FAN_IN = 16

_INTEGERS = (np.int16, np.int32, np.int64)
_EXACT = float(1 << 53)


def floored(vectors: DataFrame, column: str, factor: int) -> DataFrame:
    """Replace each component x by floor(factor * x), computed as double.

    Vectors that are null or hold a null, NaN or infinite component become null.
    """
    value = F.col(column)
    sound = F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    scaled = F.transform(value, lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return vectors.withColumn(column, F.when(sound, scaled))


def _packed(rows: pd.DataFrame) -> dict:
    """Distinct (id, vector) rows by ascending id as one matrix of the least integer type."""
    matrix = np.array(rows["vector"].tolist(), np.int64).reshape(len(rows), -1)
    keyed = np.column_stack([rows["id"].to_numpy(np.int64), matrix])
    keyed = np.unique(keyed, axis=0)
    ids, matrix = np.ascontiguousarray(keyed[:, 0]), keyed[:, 1:]
    low, high = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
    size = next(t for t in _INTEGERS if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return {
        "ids": ids.tobytes(),
        "size": np.dtype(size).itemsize,
        "cells": np.ascontiguousarray(matrix, size).tobytes(),
    }


def _blocks(rows: DataFrame, block: str, name: str) -> DataFrame:
    """One row per (length, block) with its packed vectors."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        return pd.DataFrame([{"length": first["length"], block: first[block]} | _packed(group)])

    schema = f"length int, {block} int, ids binary, size int, cells binary"
    packed = rows.groupBy("length", block).applyInPandas(pack, schema)
    return stored(packed, name)


def _matrix(row, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}_ids"], np.int64)
    kind = {np.dtype(t).itemsize: t for t in _INTEGERS}[row[f"{side}_size"]]
    return ids, np.frombuffer(row[f"{side}_cells"], kind).reshape(len(ids), -1)


def tile_top(queries, query_ids, vectors, vector_ids, k: int):
    """(query position, vector position, score) of the k best of each query in a tile.

    Vectors come by ascending id, so among equal scores the first positions win.
    """
    largest = lambda m: float(np.abs(m, dtype=np.float64).max(initial=0))
    exact = largest(queries) * largest(vectors) * max(1, vectors.shape[1]) < _EXACT
    kind = np.float64 if exact else np.int64
    scores = queries.astype(kind) @ vectors.astype(kind).T
    for q, row in enumerate(scores):
        others = np.flatnonzero(vector_ids != query_ids[q])
        if not len(others):
            continue
        own = row[others]
        if len(own) > k:
            least = np.partition(own, len(own) - k)[len(own) - k]
            above = np.flatnonzero(own > least)
            tied = np.flatnonzero(own == least)[: k - len(above)]
            chosen = np.concatenate([above, tied])
        else:
            chosen = np.arange(len(own))
        for at in chosen:
            yield q, others[at], int(own[at])


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "vector",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    fan_in: int = FAN_IN,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of all vectors for each query.

    ``vector`` is an array of integers, ``is_query`` says which rows are queries.
    """
    # a tile is one row with all its cells, so few of them make a batch
    rows = lean(vectors).select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(vector).cast("array<long>").alias("vector"),
        F.size(vector).alias("length"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    ).where(
        F.col("id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull())
    )
    n, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / query_rows))

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")

    packed = _blocks(rows.withColumn("shard", dealt(shards)), "shard", "topk-shards")
    wanted = _blocks(rows.where("asked").withColumn("block", dealt(blocks)), "block", "topk-queries")

    def side(blocks_of: DataFrame, prefix: str) -> DataFrame:
        names = {c: f"{prefix}_{c}" for c in ("ids", "size", "cells")}
        return blocks_of.withColumnsRenamed(names)

    def best(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                (q_ids, q), (v_ids, v) = _matrix(row, "q"), _matrix(row, "v")
                found = [(q_ids[i], v_ids[j], s) for i, j, s in tile_top(q, q_ids, v, v_ids, k)]
                if found:
                    columns = zip(*found, strict=True)
                    out = dict(zip(("query_id", "vec_id", "score"), columns, strict=True))
                    yield pd.DataFrame(out | {"part": int(row["shard"])})

    size = F.length("ids") + F.length("cells")
    largest = wanted.groupBy("block").agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0]
    step = max(1, pass_bytes // max(1, largest or 0))

    def lists_of(first: int) -> DataFrame:
        """The result for the queries of the blocks from ``first`` on that make a pass."""
        some = side(wanted.where(F.col("block").between(first, first + step - 1)), "q")
        # every shard meets every query block of its length
        tiles = side(packed, "v").join(F.broadcast(some), "length")
        lists = tiles.mapInPandas(best, "query_id long, vec_id long, score long, part int")
        # a query id with several vectors has several rows; each candidate counts at its best
        parts = shards
        while parts > 1:
            lists = _merged(lists.withColumn("part", F.expr(f"part div {fan_in}").cast("int")), k)
            parts = math.ceil(parts / fan_in)
        return _merged(lists, k).select("query_id", "rank", "vec_id", "score")

    if blocks <= step:
        return lists_of(0)
    # one after the other, so that no two passes have their blocks in the driver at once;
    # a query id is in one block only, so its list is whole after its pass
    spark, path = vectors.sparkSession, shared_directory(vectors.sparkSession, "topk-lists")
    for first in range(0, blocks, step):
        lists_of(first).write.mode("append").parquet(path)
    return spark.read.schema(lists_of(0).schema).parquet(path)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each query among the lists of one part."""
    order = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked


ORACLE = """
    WITH v AS (
        SELECT vec_id,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT)
                   AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        WHERE q.vec_id % 50 = 0
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
        FROM scored
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
