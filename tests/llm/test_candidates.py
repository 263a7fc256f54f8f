"""Which pairs of texts the similarity join compares at all."""

from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("xxhash")

from fieldspark.llm import jaccard  # noqa: E402


def test_only_pairs_that_share_enough_lists_are_compared(spark, monkeypatch):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(12):  # each shares the passage, a fifth of its words, with all others, and links with its copy only
        own = [f"w{i}x{j}" for j in range(240)]
        texts[2 * i] = [*own[:120], *passage, *own[120:]]
        texts[2 * i + 1] = list(texts[2 * i])
        texts[2 * i + 1][rng.randrange(300)] = "other"
    asked, plain = [], jaccard.verified

    def verified(pairs, *args):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return plain(pairs, *args)

    monkeypatch.setattr(jaccard, "verified", verified)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar(docs, 4, 85).collect()}
    assert got == {i: i - i % 2 for i in texts}
    assert sorted(asked) == [(2 * i, 2 * i + 1) for i in range(12)]


def test_rows_that_share_an_id_lose_no_link(spark):
    words = [f"w{j}" for j in range(100)]
    near = [*words[:50], "x", *words[51:]]
    other = [f"o{j}" for j in range(30)]
    rows = [(1, " ".join(words)), (1, " ".join(other)), (2, " ".join(near)), (2, " ".join(near)), (3, " ".join(other[:-1])), (4, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in jaccard.similar(docs, 4, 85).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_pairs_whose_sketches_differ_too_much_are_not_compared(spark, monkeypatch):
    texts = {}
    for i in range(12):  # pairs with a similarity of about 0.7, which share as many lists as a link might
        texts[2 * i] = [f"w{i}x{j}" for j in range(300)]
        texts[2 * i + 1] = [f"z{w}" if j % 24 == i else w for j, w in enumerate(texts[2 * i])]
    asked, plain = [], jaccard.verified

    def verified(pairs, *args):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return plain(pairs, *args)

    monkeypatch.setattr(jaccard, "verified", verified)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.similar(docs, 4, 85).collect()} == {i: i for i in texts}
    assert not asked


def test_sketches_never_part_linked_sets():
    r = np.random.default_rng(2)
    for percent in (80, 85):
        for n in (*range(1, 60), 127, 128, 150, 400, 1000):
            for add in (0, n * (100 - percent) // percent, None):  # another size, or as many other shingles
                a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
                gone = n * (100 - percent) // (100 + percent) if add is None else 0
                b = np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 63, gone if add is None else add).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                assert 100 * both >= percent * (len(a) + len(b) - both)
                assert jaccard.may_link(len(a), jaccard.sketch(a), len(b), jaccard.sketch(b), percent)
                assert jaccard.may_link(len(b), jaccard.sketch(b), len(a), jaccard.sketch(a), percent)
        a, b = (np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(2))
        assert not jaccard.may_link(300, jaccard.sketch(a), 300, jaccard.sketch(b), percent)
