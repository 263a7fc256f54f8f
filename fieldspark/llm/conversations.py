"""Repair of conversations: the cheapest edits after which roles read system?, then user and assistant by turns.

Edits are Keep, Rerole (to user or assistant), Delete and Insert; the cheapest sequence is found by depth-first branch and
bound. An explicit stack holds prefixes (row, role state, cost, audit); a suffix bound, the cost of what is left if an
insertion were as cheap as a deletion, drops prefixes that cannot reach the incumbent (cost, audit); a table for each node
(row, state) drops prefixes that are worse than one which has been there. When the stack is empty the incumbent is proved.

A conversation of usual length is one stretch of rows in one task. A long one is cut into chapters by order, whatever share
of all rows it holds: each chapter is solved for every state it may start and end in, and the conversation is the best
chain of chapters. Its texts are never gathered; only edit letters are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import ceil, inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.base import SPACES, ship
from fieldspark.session import materialise

#: Conversations beyond either are cut into chapters of about so many rows or bytes.
ROWS, BYTES = 2_048, 32_000_000

START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a row whose role may be chosen.
CHOSEN = (USER, USER, ASSISTANT, USER)
LEGAL = ("su", "ua", "au")
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Delete, Insert, Rerole, and a row that is left though truncated.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5

#: What the search knows of a row: initial of its role, whether it must go, whether it is truncated, how many such rows.
Row = tuple[str, bool, bool, int]


def moves(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """(letters, cost, new state) of the edits that take up the row."""
    initial, must, cut, copies = row
    yield "D" * copies, DELETE * copies, state
    if not must:
        more = TRUNCATED if cut else 0
        if (state, initial) in KEPT:
            yield "K", more, KEPT[state, initial]
        yield "R", REROLE + more, CHOSEN[state]


def suffix_bounds(rows: list[Row], ends: Iterable[int]) -> list[list[float]]:
    """For each row and state the least cost from there to one of `ends`, with insertions at the price of a deletion."""
    out = [[0 if s in ends else inf for s in range(4)]]
    for k in range(len(rows), -1, -1):
        here = out[-1] if k == len(rows) else [min(cost + out[-1][to] for _, cost, to in moves(rows[k], s)) for s in range(4)]
        for _ in range(3):  # start, user, assistant, user
            here = [min(x, DELETE + here[CHOSEN[s]]) for s, x in enumerate(here)]
        out.append(here)
    return out[:0:-1]


def cheapest(rows: list[Row], entry: int = START, ends: Iterable[int] = ENDS) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from `entry` over all rows to one of `ends`; None where nothing does."""
    bound, n = suffix_bounds(rows, ends), len(rows)
    best: tuple[float, str] = (inf, "")
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + bound[i][state]
        if least == inf or least > best[0] or (least == best[0] and audit > best[1][: len(audit)]):
            continue
        if (i, state) in reached and reached[i, state] <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == n and state in ends:
            best = min(best, (cost, audit))
        steps = [(cost + INSERT + bound[i][CHOSEN[state]], "I", INSERT, i, CHOSEN[state])]
        if i < n:
            steps += [(cost + more + bound[i + 1][to], letters, more, i + 1, to) for letters, more, to in moves(rows[i], state)]
        for _, letters, more, at, to in sorted(steps, reverse=True):  # the most promising comes off the stack first
            stack.append((at, to, cost + more, audit + letters))
    return None if best[0] == inf else best  # type: ignore[return-value]


def chained(chapters: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, list[str]]:
    """Cost and audits of the best chain of chapters, each given as (entry, exit): (cost, audit). At one state and cost no
    audit is the beginning of another, as further letters cost more, so the least one stays least whatever follows."""
    at: dict[int, tuple[int, str, list[str]]] = {START: (0, "", [])}
    for chapter in chapters:
        new: dict[int, tuple[int, str, list[str]]] = {}
        for (entry, leave), (cost, audit) in chapter.items():
            if entry in at:
                had = at[entry]
                path = (had[0] + cost, had[1] + audit, [*had[2], audit])
                if leave not in new or path[:2] < new[leave][:2]:
                    new[leave] = path
        at = new
    cost, _, audits = min(at[s] for s in ENDS if s in at)
    return cost, audits


def repaired_turns(rows: Iterable[tuple[str, str, int]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns after the edits; rows are (role, text, copies), all copies but the first deleted."""
    i = 0
    for role, text, copies in rows:
        while audit[i] == "I":
            state = CHOSEN[state]
            yield NAMES[state], ""
            i += 1
        letter = audit[i]
        # Equal rows stand together; the first may stay, the others are repeated and go.
        i += copies
        if letter == "K":
            state = KEPT[state, role[:1]]
            yield role, text
        elif letter == "R":
            state = CHOSEN[state]
            yield NAMES[state], text
    for _ in audit[i:]:
        state = CHOSEN[state]
        yield NAMES[state], ""


def blank(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES)) == ""


def truncated(text: Column) -> Column:
    return ~F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1)).isin(".", "!", "?")


class Tally:
    """Counts over rows in order; `add` also gives what the search must know of the rows."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, initial: str, is_blank: bool, is_cut: bool, earlier: bool, copies: int = 1) -> list[Row]:
        self.illegal += (self.last is not None and self.last + initial not in LEGAL) + (copies - 1)
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if is_blank:
            self.blank += copies
            return [(initial, True, False, copies)]
        self.duplicate += copies - (not earlier)
        if earlier:
            return [(initial, True, False, copies)]
        self.truncated += is_cut
        one = (initial, False, is_cut, 1)
        return [one] if copies == 1 else [one, (initial, True, False, copies - 1)]

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TURNS = "array<struct<role:string,text:string>>"


def _schema(id_type: str) -> str:
    return f"conv_id {id_type}, chapter int, chapters int, {', '.join(f'{c} long' for c in COUNTS)}, audit string, turns {TURNS}"


def _runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """The rows of sorted batches, in runs of equal keys."""
    held: list[dict] = []
    at = None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != at:
                yield held
                held = []
            at = key
            held.append(row)
    if held:
        yield held


def _whole(row_type: pa.Schema):
    """Solves conversations whose rows come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        for rows in _runs(batches, ("conv_id",)):
            tally, known, seen = Tally(), [], set()
            for r in rows:
                said = (r["role"], r["text"])
                known += tally.add(r["turn"], r["role"][:1], r["blank"], r["cut"], said in seen)
                seen.add(said)
            cost, audit = cheapest(known)
            turns = [{"role": a, "text": b} for a, b in repaired_turns(((r["role"], r["text"], 1) for r in rows), audit)]
            out.append(
                {"conv_id": rows[0]["conv_id"], "chapter": 0, "chapters": 1, "gaps": tally.gaps(), "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated, "illegal": tally.illegal, "cost": cost, "audit": audit, "turns": turns}
            )
            size += sum(len(r["text"]) for r in rows) + 100
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(out, row_type)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, row_type)

    return run


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, where a null role or text is one space."""
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text")
    )


def repair(conversations: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """Chapters of repaired conversations: conv_id, chapter (from 0), chapters, the conversation's gaps, blank, duplicate,
    truncated, illegal and cost, and the chapter's audit and turns (role, text). Nearly every conversation has one chapter.

    Rows stand by turn, nulls first, then role, then text. A null role or text is one space. Each row has one fault at most:
    blank, else said before by the same role in the conversation, else truncated. Blank and repeated rows must be deleted. A
    row whose role is empty has no initial and can't be kept, only reroled or deleted. All rows with a null conv_id are one
    conversation. Repeated rows count as such. An empty table gives no rows; other columns are ignored."""
    whole, cut = _repaired(conversations, rows, size)
    return whole if cut is None else whole.unionByName(cut)


def _repaired(conversations: DataFrame, rows: int, size: int) -> tuple[DataFrame, DataFrame | None]:
    """Conversations of one chapter, and those of several if there are any."""
    ship(conversations.sparkSession)
    turns = turns_of(conversations)
    schema = _schema(turns.schema["conv_id"].dataType.simpleString())
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).filter((F.col("n") > rows) | (F.col("bytes") > size))
    sizes = materialise(sizes, "long-conversations")
    total = sizes.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    short = turns
    if total.n:
        short = turns.join(sizes.withColumnRenamed("conv_id", "long_id"), F.col("conv_id").eqNullSafe(F.col("long_id")), "left_anti")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    short = short.withColumns({"blank": blank(F.col("text")), "cut": truncated(F.col("text"))})
    done = short.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_whole(_arrow(schema)), schema)
    if not total.n:
        return done, None
    parts = max(ceil(total.n / rows), ceil(total.bytes / size), 1)
    # Equal rows are one with a count, so any number of them moves as one row.
    long = turns.join(sizes.withColumnRenamed("conv_id", "long_id"), F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
    long = long.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    ordered = long.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    ordered = materialise(ordered.withColumn("chapter", F.shiftright("pos", 33).cast("int")), "ordered-turns")
    return done, _in_chapters(ordered, schema)


def _in_chapters(ordered: DataFrame, schema: str) -> DataFrame:
    """Long conversations: rows in order with their pos, chapter and copies."""
    id_type = ordered.schema["conv_id"].dataType.simpleString()
    told = F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256)
    known = ordered.select(
        "conv_id", "chapter", "pos", "turn", "copies", F.left("role", F.lit(1)).alias("initial"), blank(F.col("text")).alias("blank"), truncated(F.col("text")).alias("cut"), told.alias("told")
    )
    first = known.groupBy("told").agg(F.min("pos").alias("first"))
    known = known.join(first, "told").withColumn("earlier", F.col("pos") > F.col("first"))
    solved_type = (
        f"conv_id {id_type}, chapter int, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string,"
        " ways array<struct<entry:int,leave:int,cost:long,audit:string>>"
    )
    solved_arrow = _arrow(solved_type)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("conv_id", "chapter")):
            tally, facts = Tally(), []
            for r in rows:
                facts += tally.add(r["turn"], r["initial"], r["blank"], r["cut"], r["earlier"], r["copies"])
            ways = [
                {"entry": entry, "leave": leave, "cost": found[0], "audit": found[1]} for entry in range(4) for leave in range(4) if (found := cheapest(facts, entry, (leave,)))
            ]
            kept = {k: getattr(tally, k) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")}
            yield pa.RecordBatch.from_pylist([{"conv_id": rows[0]["conv_id"], "chapter": rows[0]["chapter"], **kept, "ways": ways}], solved_arrow)

    known = known.select("conv_id", "chapter", "pos", "turn", "copies", "initial", "blank", "cut", "earlier")
    solved = known.repartition("conv_id", "chapter").sortWithinPartitions("conv_id", "chapter", "pos").mapInArrow(solve, solved_type)
    plan_type = f"conv_id {id_type}, chapter int, number int, chapters int, {', '.join(f'{c} long' for c in COUNTS)}, audit string, state int"
    plan_arrow = _arrow(plan_type)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("conv_id",)):
            cost, audits = chained([{(w["entry"], w["leave"]): (w["cost"], w["audit"]) for w in r["ways"]} for r in rows])
            out = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}
            out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
            timed = [r for r in rows if r["low"] is not None]
            turns = sum(r["turns"] for r in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
            out["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0
            state = START
            for k, (r, audit) in enumerate(zip(rows, audits, strict=True)):
                yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "chapter": r["chapter"], "number": k, "chapters": len(rows), **out, "cost": cost, "audit": audit, "state": state}], plan_arrow)
                state = next(w["leave"] for w in r["ways"] if w["entry"] == state and w["audit"] == audit)

    plans = solved.repartition("conv_id").sortWithinPartitions("conv_id", "chapter").mapInArrow(chain, plan_type)
    # A chapter's plan comes before its rows.
    nothing = {"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "copies": F.lit(0).cast("long"), "pos": F.lit(-1).cast("long")}
    rows = ordered.select("conv_id", "chapter", "pos", "role", "text", "copies")
    both = plans.withColumns(nothing).unionByName(rows, allowMissingColumns=True)
    arrow = _arrow(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ("conv_id", "chapter")):
            plan, *rest = group
            turns = [{"role": a, "text": b} for a, b in repaired_turns(((r["role"], r["text"], r["copies"]) for r in rest), plan["audit"], plan["state"])]
            yield pa.RecordBatch.from_pylist([{k: plan[k] for k in ("conv_id", "chapters", *COUNTS, "audit")} | {"chapter": plan["number"], "turns": turns}], arrow)

    return both.repartition("conv_id", "chapter").sortWithinPartitions("conv_id", "chapter", "pos").mapInArrow(apply, schema)


def digests(whole: DataFrame, cut: DataFrame | None) -> DataFrame:
    """One row per conversation: its counts, cost and audit, and repaired_sha256 of its `role:text` lines. A hash reads a
    long conversation from its first line to its last, so one task reads its chapters in turn, one in memory at a time."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = whole.select("conv_id", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    if cut is None:
        return one
    schema = one.schema

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["chapter"] == 0:
                    if at:
                        yield closed(at, state)
                    at, state = row, [hashlib.sha256(), [], False]
                for t in row["turns"]:
                    state[0].update((b"\n" if state[2] else b"") + f"{t['role']}:{t['text']}".encode())
                    state[2] = True
                state[1].append(row["audit"])
        if at:
            yield closed(at, state)

    arrow = None

    def closed(row: dict, state: list) -> pa.RecordBatch:
        nonlocal arrow
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = arrow or to_arrow_schema(schema)
        return pa.RecordBatch.from_pylist([{k: row[k] for k in ("conv_id", *COUNTS)} | {"audit": "".join(state[1]), "repaired_sha256": state[0].hexdigest()}], arrow)

    many = cut.repartition("conv_id").sortWithinPartitions("conv_id", "chapter").mapInArrow(hashed, schema)
    return one.unionByName(many)


def damaged(conversations: DataFrame) -> DataFrame:
    """The faults that the query plants, by crc32 of `conv_id:turn` modulo 20: row dropped, text emptied, `.!?` removed,
    row repeated, role user. A null is one space."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hit = F.crc32(named) % 20
    rows = turns_of(conversations).select(
        "conv_id",
        "turn",
        F.when(hit == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(hit == 3, F.array(F.lit(1), F.lit(2))).when(hit == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def planted_and_repaired(conversations: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """Every conv_id of the table with the digests of its damaged conversation; zeros and the hash of nothing where no row
    is left."""
    found = digests(*_repaired(damaged(conversations), rows, size)).withColumnRenamed("conv_id", "found_id")
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
