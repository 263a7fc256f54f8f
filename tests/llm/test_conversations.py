"""Repair of conversations against a plain dynamic programme and, for few rows, against every sequence of edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from fieldspark.llm import conversations as conv
from fieldspark.llm.queries import QUERIES

TYPE = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if hit == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, lines) by the least of (cost, audit) at each row and state of roles; two insertions in a row at most."""
    step = {"": "su", "s": "u", "su": "a", "sua": "u"}  # what may follow: nothing yet, s, ..u, ..a
    after = {("", "s"): "s", ("", "u"): "su", ("s", "u"): "su", ("su", "a"): "sua", ("sua", "u"): "su"}
    full = {"u": "user", "a": "assistant"}

    def insert(best):
        for _ in range(3):
            for s, (cost, audit, lines) in list(best.items()):
                for r in step[s]:
                    if r in full:
                        new = (cost + 5, audit + "I", [*lines, f"{full[r]}:"])
                        if after[s, r] not in best or new < best[after[s, r]]:
                            best[after[s, r]] = new
        return best

    best = insert({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}

        def put(s, *x, new=new):
            if s not in new or x < new[s]:
                new[s] = x

        for s, (cost, audit, lines) in best.items():
            put(s, cost + 2, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role and (s, role[0]) in after:
                    put(after[s, role[0]], cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for r in step[s]:
                    if r in full:
                        put(after[s, r], cost + more + 1, audit + "R", [*lines, f"{full[r]}:{text}"])
        best = insert(new)
    return min(best[s] for s in ("", "sua") if s in best)


def plain(table):
    groups = defaultdict(list)
    for r in plain_damage(table):
        groups[r[0]].append(r)
    out = {}
    for c in {r[0] for r in table}:
        rows = sorted(groups[c], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in rows if r[1] is not None]
        roles = [r[2][:1] for r in rows]
        found = faults(rows)
        cost, audit, lines = plain_repair(rows)
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def as_dict(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def invented(seed, conversations=60, most=14):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "what is", "\t ", "", None, "é?", "a. b \n", *(f"line {i}." for i in range(8))]
    out = []
    for c in range(conversations):
        for t in range(r.randint(1, most)):
            role = r.choice([["system", "user"][t > 0], ["user", "assistant"][t % 2], ["user", "assistant"][t % 2], ["user", "assistant"][t % 2], "tool", "", None])
            out.append((c if c else None, r.choice([t, t, t, t, t + 1, None]), role, r.choice(texts)))
    return out


def test_search_against_all_edits():
    """Every string of edits of up to two insertions, for every short conversation of three kinds of row."""
    kinds = [("s", False, False), ("u", False, False), ("a", False, True), ("u", True, False), ("", False, False)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            options = []
            for letters in itertools.product("DKR", repeat=n):
                for gaps in itertools.combinations_with_replacement(range(n + 1), 2 if n < 3 else 0):
                    for used in range(len(gaps) + 1):
                        options.append((letters, gaps[:used]))
            best = None
            for letters, gaps in options:
                cost, audit, told = 5 * len(gaps), "", [""]
                for i in range(n + 1):
                    for _ in range(gaps.count(i)):
                        audit, told = audit + "I", [x + y for x in told for y in "ua"]
                    if i < n:
                        initial, must, cut = rows[i]
                        cost += {"D": 2, "K": 0, "R": 1}[letters[i]] + 5 * (cut and letters[i] != "D")
                        if letters[i] != "D" and (must or (letters[i] == "K" and not initial)):
                            told = []
                        told = told if letters[i] == "D" else [x + initial for x in told] if letters[i] == "K" else [x + y for x in told for y in "ua"]
                        audit += letters[i]
                if any(GRAMMAR.fullmatch(x) for x in told) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
            assert conv.cheapest([(*r, 1) for r in rows]) == best, rows


def test_chapters_give_the_same_as_the_whole():
    r = random.Random(5)
    for _ in range(60):
        rows = [(r.choice("suax"), r.random() < 0.1, r.random() < 0.2, 1) for _ in range(r.randint(1, 24))]
        cuts = sorted(r.sample(range(len(rows) + 1), 2)) if len(rows) > 1 else [0, 1]
        chapters = [rows[a:b] for a, b in itertools.pairwise([0, *cuts, len(rows)])]
        ways = [{(e, x): found for e in range(4) for x in range(4) if (found := conv.cheapest(c, e, (x,)))} for c in chapters]
        cost, audits = conv.chained(ways)
        assert (cost, "".join(audits)) == conv.cheapest(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, seed):
    table = invented(seed)
    df = spark.createDataFrame(table, TYPE).selectExpr("*", "1 AS cost", "'x' AS audit", "map('a', 1) AS chapter", "2 AS pos", "3 AS copies")
    want = plain(table)
    assert as_dict(conv.planted_and_repaired(df)) == want
    # Long conversations by chapters of a few rows.
    assert as_dict(conv.planted_and_repaired(df, rows=4)) == want
    assert as_dict(conv.planted_and_repaired(df, size=20)) == want


def test_odd_tables(spark):
    assert conv.planted_and_repaired(spark.createDataFrame([], TYPE)).count() == 0
    assert conv.repair(spark.createDataFrame([], TYPE)).count() == 0
    # 3,000 times the same row, one very long text, and turns all null.
    table = [(1, 4, "user", "Same.")] * 3000 + [(2, 0, "user", "Long " * 400_000 + "."), (2, 1, "assistant", "Ok.")] + [(3, None, "user", f"{i}.") for i in range(5)] + [(4, i, ["user", "assistant"][i % 2], f"{i}.") for i in range(600)]
    df = spark.createDataFrame(table, TYPE)
    want = plain(table)
    assert as_dict(conv.planted_and_repaired(df)) == want
    assert as_dict(conv.planted_and_repaired(df, rows=100)) == want


def test_repaired_turns_read_well(spark):
    rows = conv.repair(spark.createDataFrame(invented(3), TYPE), rows=6).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append(r)
    for chapters in by.values():
        chapters.sort(key=lambda r: r.chapter)
        assert [r.chapter for r in chapters] == list(range(chapters[0].chapters))
        assert GRAMMAR.fullmatch("".join(t.role[:1] for r in chapters for t in r.turns))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(QUERIES["op12_conversation_repair"](spark, folder)) == plain(table)
