"""The trees of personal data are fitted on every candidate."""

from __future__ import annotations

import random
from collections import Counter
from functools import partial

import numpy as np
import pytest

from fieldspark.llm import pii


def texts():
    out = []
    for i in range(900):  # more than one group's weight
        out.append(f"order {i} password = Qx{i:04d}zT9kLm3vB7 tel +1 555 {i:03d} {i * 7 % 10_000:04d} internationalisation 10.0.{i % 256}.{i % 7}")
    return out


def test_every_candidate_is_counted(spark, monkeypatch):
    monkeypatch.setattr(pii, "HELD", 5)
    want: Counter = Counter()
    for t in texts():
        for c in pii.candidates(t):
            want["format", c.kind, c.by_format, c.by_context] += c.by_context >= 0
            want["context", c.kind, c.by_format, c.by_context] += c.by_format >= 0
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got: Counter = Counter()
    for twice in (docs, docs.union(docs)):  # repeated rows count once
        got.clear()
        for r in pii.counted(twice).collect():
            got[r.view, r.kind, r.by_format, r.by_context] += r.n
        assert got == +want
    assert max(got.values()) >= 900
    cells = pii.counted(docs).filter("view = 'format'")
    whole = cells.groupBy().sum("n").first()[0]
    for most in (cells.count() - 1, 1):
        monkeypatch.setattr(pii, "CELLS", most)
        own, coarse = pii.joined(cells)
        assert coarse > 0 and own.groupBy().sum("n").first()[0] == whole
        assert own.count() <= most or coarse == pii.COARSEST
    monkeypatch.undo()
    model = pii.train(docs)
    found = pii.candidates(texts()[3])
    assert "secret" in {c.kind for c, p in zip(found, model.score(found), strict=True) if p > 0}


def test_many_cells_are_fitted_as_finely_as_few(spark, monkeypatch):
    for name in ("fit", "fit_apart"):
        monkeypatch.setattr(pii, name, partial(getattr(pii, name), rounds=4))
    rng, rows = random.Random(3), texts()
    for _ in range(500):  # the longer and the more digits, the likelier with a word that says it is a secret
        kinds = rng.choice(["abcdefgh", "abcXYZ", "abcXYZ0123", "0123456789ab"])
        run = "".join(rng.choices(kinds, k=rng.randrange(12, 50)))
        rows.append(f"{'token: ' if rng.random() < len(run) / 60 + 0.05 * len(kinds) - 0.4 else 'about '}{run} and so on")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    few = pii.train(docs)
    found = [c for t in rows for c in pii.candidates(t)]
    p = few.format.score(pii.placed(np.array([c.format for c in found])))
    assert len(set(p)) > 4
    for most, held in ((5, 50_000), (5, 40)):
        monkeypatch.setattr(pii, "CELLS", most)
        monkeypatch.setattr(pii, "HELD", held)
        many = pii.train(docs)
        assert many.format.score(pii.placed(np.array([c.format for c in found]))) == pytest.approx(p, abs=1e-6)
        assert many.context.score(np.array([c.context for c in found])) == pytest.approx(few.context.score(np.array([c.context for c in found])), abs=1e-6)
        assert (many.format_cut, many.context_cut) == pytest.approx((few.format_cut, few.context_cut), abs=1e-6)
        assert many.score(found) == pytest.approx(few.score(found), abs=1e-6)


@pytest.mark.parametrize("precision", [0.5, 0.9, 1.0])
def test_a_threshold_from_many_scores_is_that_of_few(spark, monkeypatch, precision):
    monkeypatch.setattr(pii, "HELD", 30)
    rng = np.random.default_rng(5)
    trees = pii.Trees(0.3, np.tile(np.arange(3), (8, 1)), rng.uniform(0, 9, (8, 3)), rng.normal(0, 0.4, (8, 4)))
    x, n = rng.integers(0, 10, (500, 3)).astype(np.uint8), rng.integers(1, 2_000, 500)
    p = trees.score(x)
    y = (rng.uniform(0, 1, 500) < p).astype(int)
    cells = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, n, strict=True)], "cell array<int>, y int, n long")
    assert pii.calibrate_apart(cells, trees, "y", precision) == pii.calibrate(p, y.astype(float), precision, n.astype(float))
