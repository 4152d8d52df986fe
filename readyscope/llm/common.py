"""What the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readyscope.sources.scratch import stored

__all__ = [
    "attach", "columns_of", "freeing_shuffles", "lean", "read_table", "sized", "stored", "unused", "whole",
]

# What a worker gets at a time, in rows and bytes
BATCH_ROWS = 2000
BATCH_BYTES = 4 * 1024 * 1024

# Beyond these, rows of a table that grows with the input do not go through the driver
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(docs: DataFrame) -> DataFrame:
    """The same table; its session sends rows to Python workers in batches of bounded size.

    Spark's own batches of 10,000 rows are made for numbers. With whole texts each is
    copied several times over on both sides, outside the heap. A session that already
    asks for less keeps that. No result depends on it.
    """
    conf, prefix = docs.sparkSession.conf, "spark.sql.execution.arrow.max"
    for name, most in (("RecordsPerBatch", BATCH_ROWS), ("BytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", conf.get(prefix + name))
        if not now or not 0 < int(now[1]) <= most:
            conf.set(prefix + name, str(most))
    return docs


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs in here remove their shuffle files as they end.

    Otherwise these stay until the driver's garbage is collected, so that jobs with large
    shuffles need the disk for several at a time. For jobs whose results are stored or come
    to the driver; a table that is left to be computed should be built outside.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def whole(text: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame, *but: str) -> list[Column]:
    """All columns but some, whatever characters their names have."""
    left_out = {c.lower() for c in but}
    return [
        F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in left_out
    ]


def sized(rows: DataFrame, n: int) -> DataFrame:
    """One side of a join, of ``n`` rows: joined by shuffle where they are many.

    Spark goes by the size of the files, where small or repeated values take a small part
    of what they take as rows, and would have the driver broadcast ten times that size.
    """
    return rows.hint("merge") if n > BROADCAST_ROWS else rows


def attach(
    rows: DataFrame, facts: DataFrame, key: list[str], hot_share: int | None = None
) -> DataFrame:
    """Inner join with a table of one row per key, however hot a key is.

    ``facts`` holds the rows per key in ``key_rows``. A key with more than one row in
    ``hot_share`` gets its facts by broadcast: at most ``hot_share`` keys can be that
    frequent, whatever the size of the input. All others are joined by shuffle, where
    none is larger than that share. Both inputs should be stored tables, as they are
    read twice. The share is a thousandth, or that of a shuffle partition if that is less.
    """
    if hot_share is None:
        partitions = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
        hot_share = max(1000, int(partitions))
    total, n = facts.agg(F.sum("key_rows"), F.count("*")).first()
    is_hot = F.col("key_rows") * hot_share > (total or 0)
    hot = F.broadcast(facts.where(is_hot).drop("key_rows"))
    rest = sized(facts.where(~is_hot).drop("key_rows"), n)
    cold_rows = rows.join(hot.select(*key), key, "left_anti")
    return rows.join(hot, key).unionByName(cold_rows.join(rest, key))
