"""Extra columns of any name and type come through the filtering operators unchanged; very long runs and repeated rows end soon."""

from __future__ import annotations

import random
import re
import time

from fieldspark.llm import jaccard, pii, quality_classifier
from pyspark.sql import functions as F

CLASHING = ["_h", "_block", "_maybe", "first", "kept", "quality", "abuse", "spans", "row", "rep", "n", "_w0", "c1", "toxic"]


def documents(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = df.select("doc_id", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING], "text", F.create_map(F.lit("k"), "doc_id").alias("sig"), F.length("text").cast("long").alias("n_chars"))
    return df


def unchanged(out, df):
    assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    rows = out.collect()
    for r in rows:
        assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING) and r.sig == {"k": r.doc_id}
    return {r.doc_id: r.text for r in rows}


def sentence(i):
    r = random.Random(i)
    return " ".join(f"word{r.randrange(500)}" for _ in range(40)) + "."


def test_names_that_clash(spark):
    texts = [sentence(i) for i in range(40)] + [sentence(3), sentence(5) + " more", "mail a.b@example.com now"]
    df = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert len(unchanged(quality_classifier.keep_good(df, labels), df)) > 30
    kept = unchanged(jaccard.one_of_each(df), df)
    assert 3 in kept and 40 not in kept and 41 not in kept and len(kept) == 41
    twice = unchanged(jaccard.one_of_each(df.union(df)), df)
    assert twice == kept
    redacted = unchanged(pii.redacted(df), df)
    assert "a.b@example.com" not in redacted[42] and redacted[7] == texts[7]


def test_ip_is_leftmost_and_long_runs_are_read_once():
    old = re.compile(r"[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)".replace("\\\\", "\\"))
    for text in ("1.2.3.4.5.6.7.8", "12.34.5.678 9.9.9", "1.2..3.4.5.6", "a1.2.3.4b5.6.7.8", "1.2.3.4.5", "00.1.2.3x.4", "1234567.1.1.1.", "...1.1.1.1.1.1"):
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in old.finditer(text)]
    began = time.time()
    for text in ("7" * 1_000_000, "7" * 500_000 + "." + "8" * 500_000, "1.2.3 " * 200_000):
        assert [s for s in pii.base_spans(text) if s[1] == 1] == []
        pii.candidates(text)
    assert time.time() - began < 30


def test_repeated_rows_of_two_linked_documents(spark):
    a, b = sentence(1), sentence(1) + " more"
    df = spark.createDataFrame([(1, a)] * 1000 + [(2, b)] * 1000 + [(3, sentence(2))], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r.component_id for r in jaccard.similar(df).distinct().collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert time.time() - began < 60
