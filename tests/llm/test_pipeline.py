"""The pipeline's stages on the smallest tables: what each keeps and what it returns."""

from __future__ import annotations

import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from fieldspark.llm import jaccard, pii, queries  # noqa: E402
from fieldspark.session import materialise  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(materialise(stage(spark, held[-1], FOLDER), name.replace(" ", "-")))
    raw, good, ruled, single, clean, pieces = held
    assert all(df.columns == docs.columns for df in held[:-1])
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in held]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    fine = {i for i, (q, t) in labels.items() if q and not t}
    assert len(fine & ids[1]) >= 0.97 * len(fine)
    # One of each group, by brute force over what the stage was given.
    sets = {r.doc_id: jaccard.shingles(jaccard.tokens(r.text), 5) for r in ruled.collect()}
    root = {i: i for i in sets}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and jaccard.linked(sets[a], sets[b], 80):
                links[a].add(b)
                links[b].add(a)
    for _ in sets:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in sets}
    assert ids[3] == set(root.values())
    before = {r.doc_id: r for r in single.collect()}
    for r in clean.collect():
        assert r.n_chars == len(r.text)
        assert (r.text != before[r.doc_id].text) >= bool(pii.base_spans(before[r.doc_id].text))
    total = defaultdict(int)
    for r in pieces.collect():
        total[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in total.values())


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == [*range(1, 14)]
    assert set(queries.ORACLE) <= set(queries.QUERIES)
