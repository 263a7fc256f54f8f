"""Ranked search by two trees against the scores of all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from fieldspark.llm import dual_tree
from fieldspark.llm.queries import QUERIES


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(items, docs, k=10):
    counted = [(i, plain_terms(t)) for i, t in docs]
    counted = [(i, ts, Counter(ts)) for i, ts in counted if ts]
    n, total = len(counted), sum(len(ts) for _, ts, _ in counted)
    df = Counter(t for _, _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(plain_terms(t))
    out = {}
    for item, own in asked.items():
        scored = []
        for i, ts, c in counted:
            m = 100 - 90 + (90 * len(ts) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        if scored:
            out[item] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.item_id].append((r.rank, r.doc_id, r.score))
    return {i: sorted(x) for i, x in out.items()}


def tables(spark, items, docs):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS rank"), spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "map('a', 1) AS terms", "2 AS n", "3 AS lead", "4 AS m", "5 AS score"
    )


def test_against_all_pairs(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    items = [(i, text(r.randint(1, 30))) for i in range(37)]
    docs = [(i, text(r.randint(1, 200))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(200)] + [(2000 + i, items[i][1] + " " + text(50)) for i in range(37)]
    a, b = tables(spark, items, docs)
    want = plain(items, docs)
    assert found(dual_tree.rank_documents(a, b)) == want
    assert found(dual_tree.rank_documents(a, b, at_once=120)) == want


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " ,.;"), (4, "Émile ÉMILE émile x_y"), (5, "a" * 30_000), (6, "b " * 100_000 + "rare"), (7, "x y"), (7, "x y"), (None, "rare rare"), (-8, "Y x"), (9, "日本 x\x00y\x7fz")]
    items = [(1, "émile"), (2, None), (3, "..."), (4, "RARE b"), (5, "x"), (5, "y"), (None, "日本 z"), (6, "nowhere"), (7, "a" * 30_000), (8, "x x x")]
    a, b = tables(spark, items, docs)
    assert found(dual_tree.rank_documents(a, b)) == plain(items, docs)
    assert found(dual_tree.rank_documents(a, b, k=1)) == plain(items, docs, 1)
    assert found(dual_tree.rank_documents(a.limit(0), b)) == {}
    assert found(dual_tree.rank_documents(a, b.limit(0))) == {}
    assert found(dual_tree.rank_documents(a, b.filter("doc_id < 4 AND doc_id > 0"))) == {}


def test_whole_batches_are_left_out():
    """Groups of items and documents that share no rare terms: most pairs of leaves are never looked at."""
    r = np.random.default_rng(2)
    weight = np.concatenate([np.full(20, 50), np.full(400, 9000)]).astype(np.int64)
    group = np.repeat(np.arange(20), 64)
    rows = [np.unique(np.concatenate([r.integers(0, 20, 10), 20 + 20 * g + r.integers(0, 20, 6)])) for g in group]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    docs = dual_tree.DocumentTree(np.arange(len(rows)), starts, np.concatenate(rows), np.full(starts[-1], 700), weight)
    items = dual_tree.ItemTree([(g, np.unique(np.concatenate([r.integers(0, 20, 10), 20 + 20 * g + r.integers(0, 20, 8)])).tolist()) for g in range(20)], weight)
    search = dual_tree.Search(items, 10, np.zeros(20, np.int64))
    evaluated = search.visit(docs)
    assert evaluated < 0.5 * sum(not n[3] for n in items.nodes) * len(docs.levels[0])
    dense = np.zeros((len(rows), 420), np.int64)
    for i, x in enumerate(rows):
        dense[i, x] = 700
    for item, own in enumerate(items.terms):
        scores = dense[:, own] @ weight[own]
        assert search.best[item] == sorted((-int(s), i) for i, s in enumerate(scores) if s > 0)[:10]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op13_ranked_search"](spark, folder)) == plain(items, docs)
