import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from readyscope.llm import balltree, registry

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_rank(docs, items, k=50):
    """Every document against every item, by the wording of the contract."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    big_n, big_l = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    found = []
    for item, text in items:
        rows = []
        for doc, counts, n in counted:
            m = 100 - 50 + (50 * n * big_n) // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                * ((1000000000 * counts[t]) // (1000 * counts[t] + 20 * m))
                for t in set(plain_terms(text)) if t in counts
            )
            if score > 0:
                rows.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1):
            found.append((item, rank, doc, -score))
    return sorted(found, key=str)


def ranked(spark, docs, items, **options):
    rows = balltree.rank(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), **options,
    )
    return sorted((tuple(r) for r in rows.collect()), key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "a1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for _ in range(n)]
    return [(i, rng.choice(texts[: n // 2]) if i % 3 == 0 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_document_against_every_item(spark, monkeypatch, seed):
    """Copies, ties and odd rows, several shards to a task, several blocks of items."""
    rng = random.Random(seed)
    docs = corpus(rng, 400) + [(None, "w1 w50"), (7, "w1 w50"), (7, "w1 w50"), (9000, None), (9001, "-- !")]
    items = [(i, " ".join(t for _, t in rng.sample(docs[:300], 1))) for i in range(15)]
    items += [(3, "w59 w58 W57"), (3, "w59 w58 W57"), (50, None), (51, "?"), (None, "w50 É"), (52, "notthere")]
    wanted = plain_rank(docs, items, k=5)
    assert ranked(spark, docs, items, k=5) == wanted
    assert ranked(spark, docs, items, k=5, block_cells=200) == wanted


def vectors(rng, n, terms=80):
    rows = [sorted(rng.sample(range(terms), rng.randint(0, 12))) for _ in range(n)]
    rows = [rows[i // 4] if i % 4 else r for i, r in enumerate(rows)]  # groups of equal rows
    values = [[rng.randint(1, 10**6) for _ in r] for r in rows]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    at = np.array([t for r in rows for t in r], np.int32)
    return np.arange(n), ends, at, np.array([v for r in values for v in r], np.int64), rows, values


@pytest.mark.parametrize("bands", [1, 7, 80])
def test_bounds_hold_and_cut(bands):
    rng = random.Random(4)
    ids, ends, at, values, rows, own = vectors(rng, 600)
    band = np.arange(80) * bands // 80
    tree = balltree.BallTree(ids, ends, at, values, band, leaf=8)
    weights = np.array([[rng.randint(0, 9000) if rng.random() < 0.1 else 0 for _ in range(20)] for _ in range(80)])
    searcher = balltree.Searcher(weights, 3, band)
    scores = [[sum(int(weights[t, q]) * v for t, v in zip(r, o, strict=True)) for q in range(20)] for r, o in zip(rows, own, strict=True)]
    nodes, leaves = [tree.root], 0
    while nodes:
        node = nodes.pop()
        bounds = searcher.bounds(node)
        for doc in tree.order[node.low : node.high]:
            assert all(scores[doc][q] <= bounds[q] for q in range(20))
        nodes.extend(node.children)
        leaves += not node.children
    assert leaves > 30 and sorted(tree.order) == list(range(600))
    searcher.search(tree)
    for q in range(20):
        best = sorted(((-scores[i][q], i) for i in range(600) if scores[i][q] > 0))[:3]
        assert sorted(((-s, -i) for s, i in searcher.best[q])) == best
    assert searcher.scored < searcher.offered


def test_alike_documents_make_one_leaf_and_are_skipped():
    n = 3000
    ends = np.concatenate([[0], np.cumsum([2] * n + [1])])
    at = np.array([0, 1] * n + [2], np.int32)
    values = np.array([900_000, 5] * n + [7], np.int64)
    tree = balltree.BallTree(np.arange(n + 1), ends, at, values)
    sizes, nodes = [], [tree.root]
    while nodes:
        node = nodes.pop()
        nodes.extend(node.children)
        if not node.children:
            sizes.append(node.high - node.low)
    assert sorted(sizes) == [1, n]
    searcher = balltree.Searcher(np.array([[0], [0], [3]]), 1)
    searcher.search(tree)
    assert searcher.best == [[(21, -n)]] and searcher.scored < 10


def test_scores_need_all_64_bits():
    tree = balltree.BallTree(np.arange(2), np.array([0, 1, 2]), np.array([0, 0], np.int32), np.array([10**9 + 1, 10**9]))
    searcher = balltree.Searcher(np.array([[9 * 10**9]]), 2)
    searcher.search(tree)
    assert sorted(searcher.best[0]) == [(9 * 10**18, -1), (9 * 10**18 + 9 * 10**9, 0)]


def test_query_equals_its_sql(spark, sf_dir):
    found = registry.queries()["op12_ranked_search"](spark, sf_dir)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    sql = balltree.ORACLE
    for name in ("documents", "benchmark"):
        sql = sql.replace(f"FROM {name}", f"FROM '{sf_dir}/{name}.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(duckdb.sql(sql).fetchall())


def test_odd_rows(spark, odd, empty, odd_rows):
    items = [(1, "one haheble"), (2, "日本 ñ"), (3, "")]
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, `rank` string")
    rows = sorted((tuple(r) for r in balltree.rank(odd, asked).collect()), key=str)
    assert rows == plain_rank(odd_rows, items) and rows
    assert balltree.rank(empty, asked).count() == 0
    assert balltree.rank(odd, asked.where("false")).count() == 0
