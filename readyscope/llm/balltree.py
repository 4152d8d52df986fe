"""Ranked lexical search: exact inner products by sparse ball trees.

A document is a sparse vector with a whole number for each of its terms, a query a
sparse vector of whole weights; the score is their inner product (see ``profiles`` and
``impacts`` for the numbers). The documents are read once: each leaves its length and the
counts of those terms that a query has. From these come the corpus statistics, over all
documents, and the vectors.

The vectors are searched in shards of bounded size, each by one task. A shard becomes a
ball tree: a node has the mean of its documents as centre and the largest distance from
it as radius, and is split between two documents far apart, down to leaves of a few
documents. No inner product in a node can exceed the centre's plus the query's length
times the radius. One radius over all terms is far too much for a query of a few, so there
is one for each band of terms of like weight, and the query's length in the band goes with
it. Documents hold their terms' weights already, which makes rare terms count in distances
as they do in scores, and queries are ones and noughts. For every query the nodes are visited best bound first, until the best
bound left cannot reach the lists's last place; at the leaves the scores are exact, in
64-bit integers. Bounds are in doubles and rounded up by far more than their error, so
no document is lost to rounding. A task carries its lists on from shard to shard, and
the lists of all tasks are merged by Spark.

Queries come in blocks: as many as make at most ``BLOCK_CELLS`` cells of terms by queries.
Only a block is ever held by the driver or sent to the workers.

Defined results: a null text has no terms, and documents without terms count nowhere;
queries without terms, or of which no term occurs, have no row; rows that repeat an id
are documents, or queries, of their own; equal scores are ordered by id, rows without an
id last. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readyscope.llm.common import lean, stored

TOP = 50
LEAF = 32
BANDS = 256
SHARD_DOCS, SHARD_TERMS = 4096, 1_000_000
BLOCK_CELLS = 4_000_000
NO_ID = (1 << 63) - 1

# Of the scoring rule: weight scale, term frequency scale and saturation, share of length
WEIGHT_SCALE, TF_SCALE, TF_UNIT, LENGTH_UNIT, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 20, 50

# ASCII letters and digits, lower-cased, and all bytes of other characters make terms
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

# Far above the error of a bound's sums, far below what matters
_ERROR = 1e-9


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's part of the score for a weight of 1, by its count and its document's length."""
    m = (100 - LENGTH_SHARE) + (LENGTH_SHARE * length * n_docs) // n_terms
    return (TF_SCALE * tf) // (TF_UNIT * tf + LENGTH_UNIT * m)


def profiles(docs: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, length (all terms), and at and tf: positions in ``terms`` and counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(terms)}.get
        for batch in batches:
            lengths, at, tf, ends = [], [], [], [0]
            for octets in batch.column("text").to_pylist():
                found = terms_of(octets)
                known = np.fromiter(map(place, found, repeat(-1)), np.int32, len(found))
                own, counts = np.unique(known[known >= 0], return_counts=True)
                lengths.append(len(found))
                at.append(own)
                tf.append(counts)
                ends.append(ends[-1] + len(own))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(_joined(at, np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(_joined(tf, np.int64))),
                ],
                ["doc_id", "length", "at", "tf"],
            )

    octets = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    rows = lean(docs).select(F.col(doc_id).cast("long").alias("doc_id"), octets)
    return rows.mapInArrow(read, "doc_id long, length long, at array<int>, tf array<long>")


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([*parts, np.empty(0, kind)]).astype(kind)


@dataclass
class Node:
    low: int  # first document of the tree's order
    high: int
    at: np.ndarray  # the centre, sparse
    centre: np.ndarray
    radii: np.ndarray  # by band
    children: tuple[Node, ...] = ()


class BallTree:
    """The documents of a shard: sparse rows of whole numbers, in the order of the leaves."""

    def __init__(
        self, ids: np.ndarray, ends: np.ndarray, at: np.ndarray, values: np.ndarray,
        band: np.ndarray | None = None, leaf: int = LEAF,
    ):
        """``band`` gives the band of every term; without it there is one."""
        self.leaf = leaf
        self.band = np.zeros(int(at.max(initial=0)) + 1, np.int64) if band is None else band
        self.bands = int(self.band.max(initial=0)) + 1
        self.ids, self.begins, self.sizes = ids, ends[:-1], np.diff(ends)
        self.at, self.values = at, values
        floats = values.astype(np.float64)
        self.squares = np.add.reduceat(np.append(floats * floats, 0.0), ends[:-1]) * (self.sizes > 0)
        # relative error of a sum over terms: at most half this, for any order of adding
        self.error = 8 * np.finfo(np.float64).eps * (len(np.unique(at)) + 8)
        self.order = np.arange(len(ids))
        self.root = self._node(0, len(ids)) if len(ids) else None
        open_nodes = [self.root] if self.root else []
        while open_nodes:
            node = open_nodes.pop()
            middle = self._split(node)
            if middle:
                node.children = (self._node(node.low, middle), self._node(middle, node.high))
                open_nodes.extend(node.children)

    def cells(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the values of some documents, and where each document's begin."""
        sizes = self.sizes[docs]
        starts = np.cumsum(sizes) - sizes
        return np.repeat(self.begins[docs] - starts, sizes) + np.arange(sizes.sum()), starts

    def _sums(self, values: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """One sum per document; those without values have 0."""
        if not len(docs):
            return np.zeros(0, values.dtype)
        found = np.add.reduceat(np.append(values, values.dtype.type(0)), starts)
        return found * (self.sizes[docs] > 0)

    def _distances(self, docs: np.ndarray, at: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances to a sparse point, never too small."""
        cells, starts = self.cells(docs)
        square = float(point @ point)
        if len(at):
            near = np.minimum(np.searchsorted(at, self.at[cells]), len(at) - 1)
            there = np.where(at[near] == self.at[cells], point[near], 0.0)
        else:
            there = np.zeros(len(cells))
        products = self._sums(self.values[cells] * there, starts, docs)
        own = self.squares[docs]
        return np.maximum(own - 2 * products + square, 0.0) + self.error * (own + square)

    def _node(self, low: int, high: int) -> Node:
        docs = self.order[low:high]
        cells, _ = self.cells(docs)
        at, place = np.unique(self.at[cells], return_inverse=True)
        values = self.values[cells].astype(np.float64)
        centre = np.bincount(place, values, len(at)) / len(docs)
        # squared distances by document and band, never too small
        row = np.repeat(np.arange(len(docs)), self.sizes[docs]) * self.bands + self.band[self.at[cells]]
        shape = len(docs) * self.bands
        own = np.bincount(row, values * values, shape).reshape(-1, self.bands)
        products = np.bincount(row, values * centre[place], shape).reshape(-1, self.bands)
        square = np.bincount(self.band[at], centre * centre, self.bands)
        distances = np.maximum(own - 2 * products + square, 0.0) + self.error * (own + square)
        return Node(low, high, at, centre, np.sqrt(distances.max(axis=0)))

    def _row(self, doc: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.begins[doc], self.begins[doc] + self.sizes[doc])
        return self.at[part], self.values[part].astype(np.float64)

    def _split(self, node: Node) -> int | None:
        """Order a node's documents by the nearer of two that lie far apart."""
        docs = self.order[node.low : node.high]
        if len(docs) <= self.leaf:
            return None
        first = docs[np.argmax(self._distances(docs, node.at, node.centre))]
        to_first = self._distances(docs, *self._row(first))
        second = docs[np.argmax(to_first)]
        nearer = to_first <= self._distances(docs, *self._row(second))
        n = int(nearer.sum())
        if n in (0, len(docs)):
            if (node.radii**2).sum() <= 4 * self.error * self.squares[docs].max():
                return None  # all alike: one leaf, however many
            n = len(docs) // 2
            nearer = np.arange(len(docs)) < n
        self.order[node.low : node.high] = np.concatenate([docs[nearer], docs[~nearer]])
        return node.low + n


class Searcher:
    """The best documents of every query so far, over any number of shards."""

    def __init__(self, weights: np.ndarray, k: int, band: np.ndarray | None = None):
        self.weights = weights  # terms by queries, whole numbers
        self.floats = weights.astype(np.float64)
        band = np.zeros(len(weights), np.int64) if band is None else band
        self.lengths = np.zeros((int(band.max(initial=0)) + 1, weights.shape[1]))  # bands by queries
        np.add.at(self.lengths, band, self.floats * self.floats)
        self.lengths = np.sqrt(self.lengths) * (1 + _ERROR)
        self.asked = (weights > 0).any(axis=0)
        self.k = k
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.asked]  # heaps of (score, -id)
        self.scored = self.offered = 0

    def bounds(self, node: Node) -> np.ndarray:
        """What no document of the node can exceed, for every query."""
        inner = self.floats[node.at].T @ node.centre
        return (inner + node.radii @ self.lengths) * (1 + _ERROR) + 1

    def search(self, tree: BallTree) -> None:
        if tree.root is None:
            return
        known: dict[int, np.ndarray] = {}

        def bound(node: Node, query: int) -> float:
            found = known.get(id(node))
            if found is None:
                found = known[id(node)] = self.bounds(node)
            return found[query]

        for query, heap in enumerate(self.best):
            if not self.asked[query]:
                continue
            self.offered += len(tree.ids)
            column = self.weights[:, query]
            count = 0  # of nodes, so that the heap never compares them
            waiting = [(-bound(tree.root, query), count, tree.root)]
            while waiting:
                most, _, node = heapq.heappop(waiting)
                if -most < (heap[0][0] if len(heap) == self.k else 1):
                    break
                if node.children:
                    for child in node.children:
                        count += 1
                        heapq.heappush(waiting, (-bound(child, query), count, child))
                else:
                    self._score(tree, node, column, heap)

    def _score(self, tree: BallTree, node: Node, column: np.ndarray, heap: list) -> None:
        docs = tree.order[node.low : node.high]
        cells, starts = tree.cells(docs)
        scores = tree._sums(column[tree.at[cells]] * tree.values[cells], starts, docs)
        self.scored += len(docs)
        least = heap[0][0] if len(heap) == self.k else 1
        for i in np.flatnonzero(scores >= least):
            found = (int(scores[i]), -int(tree.ids[docs[i]]))
            if len(heap) < self.k:
                heapq.heappush(heap, found)
            elif found > heap[0]:
                heapq.heapreplace(heap, found)


def shards(
    batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, docs: int = SHARD_DOCS, cells: int = SHARD_TERMS
) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, ends, at, impacts) of as many documents as a tree may hold."""
    held: list[tuple[np.ndarray, ...]] = []
    n = m = 0
    for whole_batch in batches:
        for start in range(0, whole_batch.num_rows, 512):
            batch = whole_batch.slice(start, 512)
            tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False)
            sizes = batch.column("at").value_lengths().to_numpy(zero_copy_only=False)
            lengths = np.repeat(batch.column("length").to_numpy(zero_copy_only=False), sizes)
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            at = batch.column("at").flatten().to_numpy(zero_copy_only=False)
            held.append((ids, sizes, at, impacts(tf, lengths, n_docs, n_terms)))
            n, m = n + len(ids), m + len(at)
            if n >= docs or m >= cells:
                yield _shard(held)
                held, n, m = [], 0, 0
    if held:
        yield _shard(held)


def _shard(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    ids, sizes, at, values = (np.concatenate(x) for x in zip(*held, strict=True))
    return ids, np.concatenate([[0], np.cumsum(sizes)]), at, values


def _blocks(queries: DataFrame, cells: int) -> Iterator[list[tuple[int, int | None, list[bytes]]]]:
    """Queries as (number, id, distinct terms), as many at a time as fit."""
    block, terms = [], set()
    for number, row in enumerate(queries.toLocalIterator()):
        own = set(terms_of(bytes(row["text"] or b"")))
        if not own:
            continue
        if block and len(terms | own) * (len(block) + 1) > cells:
            yield block
            block, terms = [], set()
        block.append((number, row["id"], sorted(own)))
        terms |= own
    if block:
        yield block


def rank(
    docs: DataFrame, queries: DataFrame, *, query_id: str = "item_id", query_text: str = "text",
    doc_id: str = "doc_id", text: str = "text", k: int = TOP, block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``query_id``, rank, doc_id and score of the ``k`` best documents of every query."""
    asked = queries.select(F.col(query_id).alias("id"), F.col(query_text).cast("binary").alias("text"))
    # a fixed order, so that a repeated read finds the same blocks
    asked = asked.orderBy("id", "text")
    id_type = queries.schema[query_id].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"number long, id {id_type}, doc_id long, score long")
    for block in _blocks(asked, block_cells):
        found = found.unionByName(_block_lists(docs, block, doc_id, text, k, id_type))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(query_id), F.col("rank").cast("int"), "doc_id", "score")


def _block_lists(docs: DataFrame, block, doc_id: str, text: str, k: int, id_type: str) -> DataFrame:
    """number, id, doc_id and score: the best of every task for every query of a block."""
    spark = docs.sparkSession
    terms = sorted({t for _, _, own in block for t in own})
    rows = stored(profiles(docs, terms, doc_id, text), "search-profiles")
    totals = rows.where("length > 0").agg(F.count("*"), F.sum("length")).first()
    n_docs, n_terms = totals[0], totals[1] or 0
    df = np.zeros(len(terms), np.int64)
    # one row per term of the block at most
    for row in rows.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        df[row["at"]] = row["count"]
    place = {t: i for i, t in enumerate(terms)}
    weights = np.array([weight(n_docs, int(n)) if n else 0 for n in df], np.int64)
    # bands of equally many terms, from the least weight to the greatest
    band = np.argsort(np.argsort(weights, kind="stable")) * BANDS // len(terms)
    asked = np.zeros((len(terms), len(block)), np.int64)
    for column, (_, _, own) in enumerate(block):
        asked[[place[t] for t in own], column] = 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(asked, k, band)
        for ids, ends, at, values in shards(batches, n_docs, n_terms):
            searcher.search(BallTree(ids, ends, at, values * weights[at], band))
        for column, heap in enumerate(searcher.best):
            if heap:
                ids = [None if -i == NO_ID else -i for _, i in heap]
                scores = [score for score, _ in heap]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([column] * len(heap), pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
                    ["place", "doc_id", "score"],
                )

    # documents without a term of the block cannot score
    scored = rows.where(F.size("at") > 0).mapInArrow(search, "place int, doc_id long, score long")
    names = spark.createDataFrame([(p, n, i) for p, (n, i, _) in enumerate(block)], f"place int, number long, id {id_type}")
    return scored.join(F.broadcast(names), "place").select("number", "id", "doc_id", "score")


ORACLE = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT row_number() OVER () AS place, doc_id, terms, len(terms)::HUGEINT AS n
    FROM lowered WHERE len(terms) > 0),
totals AS (SELECT count(*)::HUGEINT AS n_docs, sum(n)::HUGEINT AS n_terms FROM docs),
counts AS (SELECT place, doc_id, n, term, count(*)::HUGEINT AS tf
    FROM (SELECT place, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::HUGEINT AS w
    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
scores AS (SELECT item_id, place, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term), totals GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score::BIGINT AS score,
        row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
