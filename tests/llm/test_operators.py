"""Each operator against a plain version of it, and on rows that are null, empty, repeated or long."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldspark.llm import bpe, components, embeddings, jaccard, licenses, packing, pii, quality_classifier, quality_rules, url_filter, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \t\n", "a", "Émile x don't <|endoftext|> 日本", "word " * 30, "x" * 20_000]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def prose(seed, n=200):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "on", "er", "an"]) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", "."]) for _ in range(n))


def plain_measures(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(ws) - 7):
        at[tuple(ws[i : i + 8])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    line = "one two three four five six seven eight nine ten"
    texts = [*ODD, *(prose(i) for i in range(30)), f"{line}\n{line}\nx y\n{line}", "a|b # ### " * 40, " ".join([prose(1, 40)] * 5)]
    rows = quality_rules.quality_rules(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert all(r.kept for r in rows if len(ODD) <= r.doc_id < len(ODD) + 30)
    kept = quality_rules.keep_good(documents(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert quality_rules.quality_rules(documents(spark, [])).count() == 0


def test_quality_classifier(spark):
    texts = [prose(i) for i in range(120)] + [prose(i).upper().replace(" ", "!! ") for i in range(40)] + [prose(i) + " idiot moron stupid" for i in range(40)] + ODD
    labels = spark.createDataFrame([(i, int(not 120 <= i < 160), int(160 <= i < 200)) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(rows) == len(texts)
    assert sum(rows[i].kept for i in range(120)) >= 118
    assert sum(rows[i].kept for i in range(120, 200)) <= 4
    assert not rows[200].kept and not rows[201].kept
    assert quality_classifier.classify(documents(spark, []), labels).count() == 0
    assert quality_classifier.classify(docs, labels.limit(0)).filter("kept").count() == len(texts) - 3
    # A reader who is right nearly always, one who errs often.
    truth = np.random.default_rng(1).random(2000) < 0.8
    noise = np.random.default_rng(2).random((2000, 3)) < [0.02, 0.3, 0.1]
    p, right = quality_classifier.posterior(np.where(truth[:, None] ^ noise, 1, -1), 0.8)
    assert ((p > 0.5) == truth).mean() > 0.97 and right[0][1] < right[0][0]


def test_quality_of_whole_runs_and_repeated_documents(spark):
    good = [prose(i, 60) for i in range(160)]
    bad = [prose(i, 60).replace(" ", "!#*$% ") for i in range(80)]
    joined = lambda t: t.replace(" ", "")
    texts = [*good, *bad, *["a" * 24 + joined(t) for t in good], *["a" * 24 + joined(t) for t in bad]]
    labels = spark.createDataFrame([(i, int(i < 160 or 240 <= i < 400), 0) for i in range(480)], "doc_id long, quality int, toxic int")
    scorer = quality_classifier.train(documents(spark, texts), labels)
    memo = scorer.memos()
    junk = [scorer.score("a" * 24 + joined(prose(i, 60).replace(" ", "!#*$% ")), memo)[0] for i in range(500, 540)]
    clean = [scorer.score("a" * 24 + joined(prose(i, 60)), memo)[0] for i in range(500, 540)]
    assert np.median(junk) < min(clean), (sorted(junk), sorted(clean))
    assert quality_classifier.shapes("a" * 24 + "#1") != quality_classifier.shapes("a" * 24)
    assert sum(x for _, x in quality_classifier.shapes("a" * 36)) == 1.5
    repeated = documents(spark, texts).unionByName(documents(spark, texts).filter("doc_id = 3").crossJoin(spark.range(500)).drop("id"))
    again = quality_classifier.train(repeated, labels)
    assert (again.quality == scorer.quality).all() and (again.abuse == scorer.abuse).all()


def test_bpe_round_trip(spark):
    own, library = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    r = random.Random(3)
    letters = "abzÀéİΣσςßñ '<|>1२½Ⅻ́\x1c\x85 ​日ガ가ﬁ😀\x00\n.,-_"
    texts = [*ODD, *("".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)), "a<|endoftext|>b<|startoftext|>"]
    for t in texts[:7] + texts[7:]:
        want = library.encode(t or "", add_special_tokens=False).ids
        ids, decoded = own.round_trip(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(ids)
    rows = bpe.encode_documents(documents(spark, ODD), PATH).collect()
    assert [(r.n_tokens, bytes(r.ids)) for r in sorted(rows)] == [(len(x) // 4, x) for x in map(own.encode, ODD)]
    assert bpe.encode_documents(documents(spark, []), PATH).count() == 0


def test_personal_data(spark):
    base = "x a.b@c.de, 10.0.0.1; +1 (555) 123-4567, 4111 1111 1111 1111, 4111111111111112 a 300.1.1.1 a@b.c_x@d.e"
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(5)
    texts = [base, *ODD, *("".join(r.choice("ab.@@-_1 ") for _ in range(60)) for _ in range(300))]
    for t in texts:
        assert list(pii.emails(t or "")) == [m.span() for m in email.finditer(t or "")]
    train = [f"{prose(i, 20)} password={hashlib.md5(str(i).encode()).hexdigest()} and {prose(i, 9)}1 {base}" for i in range(60)]
    docs = documents(spark, texts + train)
    rows = {x.doc_id: x for x in pii.digests(pii.find(docs, pii.train(docs))).collect()}
    assert len(rows) == len(texts) + len(train)
    got = rows[0]
    spans = [("email", 2, 10), ("ip", 12, 20), ("phone", 22, 39), ("card", 41, 60)]
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (3, 1, 1, 1)
    assert got.spans.split(",")[:4] == [f"{k}:{s}:{e}" for k, s, e in spans]
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[1].spans == ""
    assert sum("secret" in rows[len(texts) + i].spans for i in range(60)) >= 57
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns
    assert "[EMAIL], [IP]; [PHONE], [CARD]" in clean.filter("doc_id = 0").first().text
    assert pii.redacted(documents(spark, [])).count() == 0


def test_personal_data_of_any_length_and_form(spark):
    code = lambda i: hashlib.sha512(str(i).encode()).hexdigest()
    known = [f"{prose(i, 20)} password={code(i)[:40]} {prose(i, 9)} Tel: +1 (555) 123-{1000 + i} {prose(i, 5)} date 2024-01-{10 + i % 20} on" for i in range(90)]
    long = (code(1) * 2)[:201]
    secrets = [f"token = {long}", f"api_key: '{code(2) * 4}'", "password=correcthorsebatterystaple", "password: Hunter2xy", 'x "secret": "a b!c"', "passwd=p&s"]
    values = [long, code(2) * 4, "correcthorsebatterystaple", "Hunter2xy", "a b!c", "p&s"]
    national = ["Tel: (555) 123-4567 on", "they", "date 2024-01-15 on"]
    docs = documents(spark, [*secrets, *national, *known])
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    for i, v in enumerate(values):
        assert v not in clean[i] and "[SECRET]" in clean[i], (secrets[i], clean[i])
    assert clean[6] == "Tel: [PHONE] on" and [clean[7], clean[8]] == national[1:]
    assert all("[SECRET]" in clean[9 + i] and clean[9 + i].count("[PHONE]") == 1 for i in range(90))
    for text in ("token" * 20_000, "token=" * 20_000, "token='" * 20_000, "a " * 20_000 + "=", "x" * 200_000):
        assert len(pii.candidates(text)) <= 20_000
    national = pii.candidates("(555) 123-4567")
    assert {c.by_format for c in national if c.kind == "phone"} == {-1}
    assert not set(pii.FORMAT[4:]) & set(pii.CONTEXT[4:])


def test_revisits_without_a_time_or_address_are_in_no_window(spark):
    rows = spark.sql("SELECT id AS record_id, IF(id % 2 = 0, 'u', NULL) AS canonical, CAST(NULL AS TIMESTAMP) AS ts, id % 3 = 0 AS full FROM range(3000)")
    known = spark.sql("SELECT id AS record_id, 'u' AS canonical, timestamp_seconds(id) AS ts, id = 3000 AS full FROM range(3000, 3010)")
    got = warc.latest_before(rows.unionByName(known))
    assert {r.record_id: r.source for r in got.collect()} == {i: 3000 if i > 3000 else None for i in range(3010)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window [max(_own") :]
    window = window[: window.index("Project [canonical")]
    assert "Range (3000, 3010" in window and "Range (0, 3000" not in window, plan


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.NET/x", "http://example.net/en/1?q#f", "https://www.Example.com/de/", "http://x.org/fr/a", "http://b.io/p/?utm_x=1&b=2&a=1", "https://b.io/p?a=1&b=2", "http://b.io", "http://net/"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]
    listed = spark.createDataFrame([("b.io/p?a=1&b=2",), (None,), ("b.io/p?a=1&b=2",)], "canonical string")
    rows = sorted(url_filter.judge(pages, listed, rules).collect())
    want = [("", "allow"), ("", "allow"), ("", "allow"), ("a.net", "block"), ("example.net", "allow"), ("www.example.com", "block"), ("x.org", "allow"), ("b.io", "block"), ("b.io", "block"), ("b.io", "allow"), ("net", "block")]
    assert [(r.host, r.verdict) for r in rows] == want * 2
    assert url_filter.judge(pages, listed.limit(0), rules).filter("listed").count() == 0
    assert url_filter.judge(pages.limit(0), listed, rules).count() == 0


def plain_components(n, links):
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    return root


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, k, percent):
    r = random.Random(k)
    texts, passage = [*ODD, "a b", "A B", "a b"], prose(999, 60)
    for i in range(40):
        words = prose(i, r.choice([5, 9, 12, 16, 18, 22, 40, 150])).split()
        texts.append(" ".join(words))
        for _ in range(r.randint(0, 4)):
            w = [*words]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"q{r.randint(0, 99)}"
            texts.append(" ".join(w))
    hub = prose(77, 120).split()
    for i in range(150):  # one large group of near copies
        w = [*hub]
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 9999)}"
        texts.append(" ".join(w))
    texts += [f"{passage} {prose(2000 + i, 25)}" for i in range(150)]  # one passage in texts that are not alike
    sets = [jaccard.shingles(jaccard.tokens(t), k) for t in texts]
    links = defaultdict(set)
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.linked(sets[i], sets[j], percent):
                links[i].add(j)
                links[j].add(i)
    want = plain_components(len(texts), links)
    rows = sorted(jaccard.similar(documents(spark, texts), k, percent).collect())
    assert [x.n_shingles for x in rows] == [len(s) for s in sets]
    assert [x.component_id for x in rows] == want
    kept = jaccard.one_of_each(documents(spark, texts), k, percent)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want))


def test_jaccard_keys():
    """Linked sets of any size share a key, whichever list they may leave out."""
    r = np.random.default_rng(1)
    for percent in (80, 85):
        bands = jaccard.Bands(percent)
        for n in (*range(6, 60), 150, 400, 1000):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            gone = n * (100 - percent) // (100 + percent)
            b = np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 63, gone).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= percent * (len(a) + len(b) - both)
            assert len(np.intersect1d(jaccard.list_keys(a, bands)[0], jaccard.list_keys(b, bands)[0]))


def test_jaccard_empty(spark):
    assert jaccard.similar(documents(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert sorted(x.component_id or -1 for x in jaccard.similar(rows).collect()) == [-1, 3, 3]
    assert jaccard.one_of_each(rows).count() == 2


def test_packing(spark):
    r = random.Random(2)
    for sizes in ([], [1], [2048], [4096, 1], [1100] * 50, [r.randint(1, 5000) for _ in range(400)]):
        total, cover = Counter(), defaultdict(list)
        places = defaultdict(list)
        for item, start, length, seq, offset in packing.pack(sizes):
            total[seq] += length
            cover[item].append((start, length))
            places[seq].append((offset, length))
        assert sum(total.values()) == sum(sizes)
        assert all(t == 2048 or t & (t - 1) == 0 for t in total.values())
        for found in (*cover.values(), *places.values()):
            at = 0
            for start, length in sorted(found):
                assert start == at and length > 0
                at += length
        assert [sum(x[1] for x in cover[i]) for i in range(len(sizes))] == sizes
    texts = [*ODD, *(prose(i, 900) for i in range(12))]
    library = Tokenizer.from_file(PATH)
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    rows = packing.pack_documents(documents(spark, texts), PATH).collect()
    got = defaultdict(list)
    for x in sorted(rows, key=lambda x: x.start):
        assert x.doc_tokens == len(ids[x.doc_id]) and zlib.crc32(x.ids) == zlib.crc32(struct.pack(f"<{x.length}I", *ids[x.doc_id][x.start : x.start + x.length]))
        got[x.doc_id] += struct.unpack(f"<{x.length}I", x.ids)
    assert [got[i] for i in range(len(texts))] == ids
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0


def test_licenses(spark):
    text = "Released under the MIT License. Licensed under the Apache-License, Version 2.0. GNU General Public License"
    holder = "Neither the name of the Foo Bar Institute nor the names of its contributors may be used"
    texts = [text, *ODD, "licensed under cc by-nc 4.0", "licensed under the gnu general public license version 3 or later version", holder]
    rows = sorted(licenses.scan(documents(spark, texts)).collect())
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels) == (3, 3, 14, "apache,gpl,mit")
    assert rows[0].labels == "apache,apache-2.0,gpl,mit,mit-notice" and rows[0].score == 1.0
    assert all(x.n_base == 0 and x.labels == "" and x.first_word is None and x.score == 0 for x in rows[1:8])
    assert rows[8].labels == "cc-by-nc-4.0" and rows[8].base_labels == ""
    assert rows[9].labels == "gpl,gpl-3.0" and rows[10].labels == ""
    a = licenses.Automaton("t", "a [[b]] {{2}} c")
    assert [a.run(w.encode().split(), 0)[0] for w in ("a c", "a b c", "a b x y c", "a x y z c", "b c")] == [2, 3, 5, None, None]
    assert licenses.scan(documents(spark, [])).count() == 0


def test_license_score_of_a_text_that_is_cut(spark):
    start = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    whole = licenses.Automaton("mit-text", licenses.TEMPLATES["mit-text"]).total
    row = licenses.scan(documents(spark, [start])).first()
    assert row.labels == "" and row.score == len(start.split()) / whole


def test_revisits(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        kind = r.choice(["response", "revisit", "revisit", "request"])
        tag = r.choice(["x", 'W/x', "y", None])
        headers = None if tag is None else {"etag": tag, "date": str(i), "length": str(i)}
        rows.append((i, r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, r.randint(0, 50_000)]), kind, r.choice([200, 200, 404]), headers, f"body{i}"))
    df = spark.createDataFrame(rows, "record_id long, canonical string, s long, type string, status int, headers map<string,string>, body string")
    got = {x.record_id: x for x in warc.resolve_revisits(df.selectExpr("*", "timestamp_seconds(s) AS ts"), ["body"]).collect()}
    for i, url, s, kind, _, headers, _ in rows:
        if kind != "revisit":
            assert i not in got
            continue
        past = [x for x in rows if x[3] == "response" and x[4] == 200 and url is not None and x[1] == url and None not in (s, x[2]) and x[2] < s]
        best = max(past, key=lambda x: (x[2], x[0]), default=None)
        assert got[i].source == (best[0] if best else None)
        strip = lambda h: (h or {}).get("etag", "").removeprefix("W/")
        ok = best is not None and bool(strip(headers)) and strip(headers) == strip(best[5])
        assert got[i].outcome == ("no earlier response" if best is None else "resolved" if ok else "changed")
        assert got[i].body == (best[6] if ok else None)
        assert got[i].headers == ({**best[5], "etag": headers["etag"], "date": headers["date"]} if ok else headers or {})
    assert warc.resolve_revisits(df.selectExpr("*", "timestamp_seconds(s) AS ts").limit(0), ["body"]).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(7)
    base = r.standard_normal((60, 16))
    vectors = [*base, *(base[i % 20] + 0.12 * r.standard_normal(16) for i in range(120)), *([base[3]] * 40), *(base[5] + 0.2 * r.standard_normal(16) for _ in range(80))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [None] + [1.0] * 15), (n + 4, [float("nan")] * 16), (n + 5, [float("inf")] * 16), (None, rows[0][1])]
    got = {x.vec_id: x for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=50).collect()}
    u = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    links = {i: {int(j) for j in np.flatnonzero(hit[i]) if j != i} for i in range(n)}
    want = plain_components(n, links)
    assert len(got) == len(rows)
    assert [got[i].n_links for i in range(n)] == [len(links[i]) for i in range(n)]
    assert [got[i].component_id for i in range(n)] == want
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(n, n + 6))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    r = random.Random(9)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect())
    links = defaultdict(set)
    for a, b in pairs:
        links[a].add(b)
        links[b].add(a)
    want = plain_components(601, links)
    assert {k: want[k] for p in pairs for k in p} | {3: want[3]} == got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
