"""What a Python worker holds: workers live on from stage to stage, so tables and memos of one stand beside the memory of the next."""

from __future__ import annotations

import random
import struct
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldspark.llm import bpe, jaccard, packing, pii, quality_classifier
from fieldspark.llm.base import BATCH_BYTES, BATCH_LIMIT, map_batches

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["alpha Alpha alpha, (alpha) ALPHA", "don't <|endoftext|>alpha alpha<|endoftext|>", "Émile x 日本 İstanbul naïve alpha1", "", "a " * 50]


def test_library_encoding_reads_no_tables_and_keeps_a_word_once():
    own = bpe.Codec(PATH, library=True)
    whole = Tokenizer.from_file(PATH)
    for text in TEXTS:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert not {"merges", "strings"} & vars(own).keys()
    assert "alpha" in own.ids and "alpha" not in own.words


def test_own_merges_and_decoding_are_as_the_library():
    own = bpe.Codec(PATH)
    whole = Tokenizer.from_file(PATH)
    for text in TEXTS:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert own.round_trip(text) == (struct.pack(f"<{len(ids)}I", *ids), whole.decode(ids, skip_special_tokens=False))


def test_full_memos_give_the_same_ids():
    small, large = (bpe.Codec(PATH, library=True, limit=n) for n in (2, 1000))
    for text in TEXTS:
        assert small.encode(text) == large.encode(text)


def test_triples_are_sought_in_little_memory():
    lengths = np.arange(1, packing.WINDOW)
    tracemalloc.start()
    packing.combinations(lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


def test_triples_are_all_that_fill_a_window():
    lengths = np.array(sorted(random.Random(5).sample(range(1, 300), 200)))
    x, y = np.meshgrid(lengths, lengths, indexing="ij")
    z = 300 - x - y
    ok = (x >= y) & (y >= z) & np.isin(z, lengths)
    found = packing.combinations(lengths, 300, 10**6)
    assert np.array_equal(found[found[:, 2] > 0], np.stack([x[ok], y[ok], z[ok]], 1))
    assert packing.combinations(np.zeros(0, np.int64), 300).shape == (0, 3)


def test_scorer_remembers_a_bounded_number_of_words():
    zeros = np.zeros(quality_classifier.DIMS, np.float32)
    memo = quality_classifier.Scorer(zeros, 0.0, 0.0, zeros, 0.0, 0.0).memos()
    assert memo.limit * 300 <= 30e6


@pytest.fixture
def unset(spark):
    """A session that states no limit to batches."""
    was = spark.conf.get(BATCH_LIMIT, None)
    spark.conf.unset(BATCH_LIMIT)
    yield spark
    spark.conf.unset(BATCH_LIMIT)
    if was is not None:
        spark.conf.set(BATCH_LIMIT, was)


def _long_texts(spark, n: int):
    return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))


def _batches(docs) -> list[int]:
    def make():
        return lambda batch: iter([pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})])

    got = map_batches(docs, make, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == docs.count()
    return [r["bytes"] for r in got]


def test_batches_of_long_texts_are_small(unset):
    sizes = _batches(_long_texts(unset, 3000))  # 12 MB, and no more rows than Spark puts into one batch
    assert max(sizes) <= BATCH_BYTES + 8192


def test_a_limit_that_the_session_states_stays(unset):
    unset.conf.set(BATCH_LIMIT, str(1 << 20))
    assert max(_batches(_long_texts(unset, 1000))) <= (1 << 20) + 8192


def test_all_that_hand_over_texts_ask_for_small_batches(unset):
    docs = _long_texts(unset, 3)
    labels = docs.select("doc_id", F.lit(True).alias("quality"), F.lit(False).alias("toxic"))
    pairs = unset.createDataFrame([(0, 1)], "a long, b long")
    model = pii.train(docs)
    sketches = jaccard.keyed(docs, 5, 80).select("doc_id", "n", "sketch")
    calls = [
        lambda: pii.train(docs),
        lambda: pii.find(docs, model),
        lambda: quality_classifier.classify(docs, labels),
        lambda: packing.pack_documents(docs, PATH),
        lambda: jaccard.verified(pairs, docs, 5, 80),
        lambda: jaccard.close(pairs, sketches, 80),
    ]
    for call in calls:
        unset.conf.unset(BATCH_LIMIT)
        call()
        assert unset.conf.get(BATCH_LIMIT) == str(BATCH_BYTES)
