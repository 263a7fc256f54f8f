"""Personal data: generators propose overlapping spans, two sets of boosted trees judge them, one by format and one by
context, and thresholds calibrated on held-out candidates select what is reported and redacted. Every candidate is counted, by
what its features say on a grid; trees and thresholds come from these counts.

The trees that see the format are fitted on labels that the context gives, and the reverse, so neither sees what its labels
are made of. Where neither can tell, a candidate has no label and only the trees judge it.

The base patterns are fixed and always reported. The trees add spans, such as secrets, that no base span overlaps."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.ordered import with_running_sum
from fieldspark.llm.base import named, plain_names, ship, small_batches
from fieldspark.llm.bpe import slices
from fieldspark.session import materialise

#: Fixed by the contract: the kinds and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Begins where a run of digits does and gives none of them back: what fails there fails from each of its digits, and a
# million of them are then read once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Spans and candidates of any kind hold one of these or follow it, so texts without them are not looked at further.
SOME = "[0-9@=:]|[A-Za-z0-9+/_-]{12}"
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of LOCAL @ DOMAIN. The local part is the whole run of its characters before the @, so each @ is
    looked at once however long the run is."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1  # the run before this @ can't begin a match further on
            at = text.find("@", at + 1)


def digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_ip(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in span.split("."))


def is_card(span: str) -> bool:
    return 14 <= len(d := digits(span)) <= 19 and luhn(d)


def is_phone(span: str) -> bool:
    return 10 <= len(digits(span)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kind counts in KINDS."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for kind, pattern, valid in ((1, IP, is_ip), (2, CARD, is_card), (3, PHONE, is_phone)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(m.group())]
    return sorted(out)


#: What the generators propose: recall first, they may overlap. A secret is a whole run, however long; values of any form
#: come from `values`.
GENERATORS = (
    ("ip", IP),
    ("card", CARD),
    ("phone", re.compile(r"\+?\(?[0-9][\x20().0-9-]{5,40}[0-9]")),
    ("secret", re.compile(r"[A-Za-z0-9+/_-]{12,}")),
)
#: Words before a value that say what it is.
SECRET_WORDS = ("password", "passwd", "secret", "token", "key", "api", "auth")
PHONE_WORDS = re.compile(r"phone|mobile|\b(?:tel|call|fax|cell)\b")
CARD_WORDS = re.compile(r"card|visa|account|iban")
OTHER_WORDS = re.compile(r"\b(?:date|version|isbn|order|page|year|total|price|invoice)\b")
SEPARATOR = re.compile(r"[=:][=:>\x20\t]*")
VALUE = re.compile(r"[^\s\"<>]+")
QUOTES = "\"'`"
#: Characters of context that are looked at.
NEAR = 24
FORMAT = (
    "ip", "card", "phone", "secret", "length", "digit share", "upper share", "lower share", "separators", "entropy", "runs",
    "longest digits", "plus", "luhn",
)
CONTEXT = ("ip", "card", "phone", "secret", "assigned", "quoted", "secret word", "phone word", "card word", "other word", "alone")
DATE = re.compile(r"[0-9]{4}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{4}")
_NAME_CHARS = _LOCAL_CHARS - frozenset("%+")


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    #: What format and context say, each for its own trees.
    format: tuple[float, ...] = field(compare=False)
    context: tuple[float, ...] = field(compare=False)
    #: By format and by context: 1 or 0 where a rule knows, -1 where it is in doubt.
    by_format: int = field(compare=False)
    by_context: int = field(compare=False)


def values(text: str) -> Iterator[tuple[int, int]]:
    """What follows a secret word and = or :, of any length and form: up to the closing quote, or the next white space, double
    quote or angle bracket. The word is in the name before the sign, or near it. Each stretch of text is read once."""
    done = 0
    for m in SEPARATOR.finditer(text):
        if m.start() < done:
            continue
        left = text[done : m.start()].rstrip(" \t\"'`)]")
        done = m.end()
        name = len(left)
        while name and left[name - 1] in _NAME_CHARS:
            name -= 1
        said = left[min(name, max(0, len(left) - NEAR)) :].lower()
        if not any(w in said for w in SECRET_WORDS):
            continue
        start, end = m.end(), -1
        if (quote := text[start : start + 1]) and quote in QUOTES:
            start += 1
            end = text.find(quote, start)
            if end >= 0 and text.find("\n", start, end) >= 0:
                end = -1
        if end < 0 and (v := VALUE.match(text, start)):
            end = start + len(v.group().rstrip(".,;:!?)]}'`"))
        if end > start:
            yield start, end
            done = end


def candidates(text: str) -> list[Candidate]:
    """Of every kind but email, where the pattern proposes nothing that is not a base span."""
    assigned = set(values(text)) if "=" in text or ":" in text else set()
    out = [_candidate(text, "secret", s, e, True) for s, e in sorted(assigned)]
    for kind, pattern in GENERATORS:
        out += [_candidate(text, kind, *m.span()) for m in pattern.finditer(text) if kind != "secret" or m.span() not in assigned]
    return out


def _candidate(text: str, kind: str, start: int, end: int, named: bool = False) -> Candidate:
    """`named`: `values` found it."""
    span, n = text[start:end], end - start
    before, after = text[max(0, start - NEAR) : start], text[end : end + 2]
    number = digits(span)
    n_upper, n_lower = sum("A" <= c <= "Z" for c in span), sum("a" <= c <= "z" for c in span)
    entropy = -sum(c / n * log2(c / n) for c in Counter(span).values())
    assigned = named or before.rstrip(" \"'").endswith(("=", ":"))
    said = before.lower()
    secret_word = named or any(w in said for w in SECRET_WORDS)
    phone_word, card_word, other_word = (bool(p.search(said)) for p in (PHONE_WORDS, CARD_WORDS, OTHER_WORDS))
    kinds = tuple(float(kind == k) for k in ("ip", "card", "phone", "secret"))
    of_format = (
        *kinds, float(min(n, 100)), len(number) / n, n_upper / n, n_lower / n, float(n - len(number) - n_upper - n_lower), entropy,
        float(len(re.findall("[0-9]+|[A-Z]+|[a-z]+", span))), float(max(map(len, re.findall("[0-9]+", span)), default=0)),
        float(span[0] == "+"), float(is_card(span)),
    )
    of_context = (
        *kinds, float(assigned), float(after[:1] in ("'", '"') and after != ""), float(secret_word), float(phone_word), float(card_word),
        float(other_word), float((not before or before[-1].isspace()) and (not after or after[0].isspace())),
    )
    glued = before[-1:].isalnum() or after[:1].isalnum()
    contact = {"phone": phone_word, "card": card_word}.get(kind, False)
    if kind == "secret":
        by_context = 1 if assigned and secret_word else -1 if assigned or secret_word else 0
    else:
        by_context = 1 if contact else 0 if other_word or glued else -1
    return Candidate(kind, start, end, of_format, of_context, _by_format(kind, span, number, entropy), by_context)


def _by_format(kind: str, span: str, number: str, entropy: float) -> int:
    if kind == "ip":
        return int(is_ip(span))
    if kind == "card":  # cards of 12 and 13 digits exist
        return 1 if is_card(span) else -1 if 12 <= len(number) <= 13 and luhn(number) else 0
    if kind == "phone":  # without + it may be in national form
        if not 7 <= len(number) <= 15 or DATE.fullmatch(span) or IP.fullmatch(span):
            return 0
        return int(is_phone(span)) if span[0] == "+" else -1
    if re.fullmatch("AKIA[0-9A-Z]{16}", span):
        return 1
    if len(span) >= 20 and entropy >= 3 and 0.15 <= len(number) / len(span) < 1 and span.isascii() and not any(c.isspace() for c in span):
        return 1
    # Words and numbers, alone or joined, as in any text; longer ones may be anything.
    parts = [p for p in re.split("[+/_-]+", span) if p]
    return 0 if all(len(p) <= 20 and (p.isdigit() or p.isalpha() and (p.islower() or p.isupper() or p.istitle())) for p in parts) else -1


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees of a fixed depth: of each, (feature, cut) at inner nodes and values at leaves."""

    start: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features."""
        return 1 / (1 + np.exp(-self.margin(x)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        inner = self.features.shape[1]
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), int)
            while (live := node < inner).any():
                k = node[live]
                node[live] = 2 * k + 1 + (x[rows[live], f[k]] > c[k])
            total += leaf[node - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2) -> Trees:
    """Logistic loss, second-order leaf values, rows of weight w, cuts at every value of each feature."""
    if not len(y):
        return NOTHING
    cuts = [np.unique(x[:, j]) for j in range(x.shape[1])]
    places = [np.searchsorted(own, x[:, j], "left") for j, own in enumerate(cuts)]  # x <= own[place]
    start = _start(np.average(y, weights=w))
    margin = np.full(len(y), start)
    inner = 2**depth - 1
    out_f, out_c, out_v = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        f, c = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), int)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            if w[own].sum() >= 10:
                sums = [[np.bincount(at[own], of[own], len(cut)) for of in (g, h)] for at, cut in zip(places, cuts, strict=True)]
                f[k], c[k] = _best_cut(sums, cuts, g[own].sum(), h[own].sum())
            node[own] = 2 * k + 1 + (x[own, f[k]] > c[k])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1.0)
        margin += value[leaf]
        out_f.append(f)
        out_c.append(c)
        out_v.append(value)
    return Trees(start, np.array(out_f), np.array(out_c), np.array(out_v))


#: Of no candidates at all.
NOTHING = Trees(-9.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))


def _start(share: float) -> float:
    """The margin that trees begin with, from the share of ones."""
    p = min(0.999, max(0.001, share))
    return float(np.log(p / (1 - p)))


def _best_cut(sums, cuts, whole: float, weight: float) -> tuple[int, float]:
    """`sums`: of each feature, the first and second derivatives at each of its cuts; `whole`, `weight`: of all of them."""
    best, found = 1e-9, (0, np.inf)
    for j, ((gs, hs), own) in enumerate(zip(sums, cuts, strict=True)):
        gs, hs = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
        if not len(gs):
            continue
        gain = gs**2 / (hs + 1) + (whole - gs) ** 2 / (weight - hs + 1) - whole**2 / (weight + 1)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (j, float(own[k]))
    return found


#: The grid of the format's features: a value's place is the number of these at or below it.
_SHARE = [k / 16 for k in range(1, 17)]
GRID: dict[str, list[float]] = {
    "length": [*range(7, 33), 36, 40, 48, 56, 64, 80, 100], "digit share": _SHARE, "upper share": _SHARE, "lower share": _SHARE,
    "separators": [*range(1, 9), 10, 12, 16, 24, 32], "entropy": [k / 4 for k in range(1, 25)], "runs": [*range(2, 13), 14, 16, 20, 24, 32],
    "longest digits": [*range(1, 21), 24, 32],
}
#: Places of any feature, at most.
PLACES = 1 + max(map(len, GRID.values()))


def placed(x: np.ndarray) -> np.ndarray:
    """Rows of the format's features by their places."""
    out = x.astype(np.uint8)
    for j, name in enumerate(FORMAT):
        if name in GRID:
            out[:, j] = np.searchsorted(GRID[name], x[:, j], "right")
    return out


@dataclass(frozen=True)
class Model:
    """Trees and threshold of the format, and of the context."""

    format: Trees
    format_cut: float
    context: Trees
    context_cut: float

    def score(self, found: list[Candidate]) -> np.ndarray:
        """The greater probability of those at or above their threshold, 0 where neither is or the digits of a number forbid it."""
        if not found:
            return np.zeros(0)
        p = self.format.score(placed(np.array([c.format for c in found])))
        q = self.context.score(np.array([c.context for c in found]))
        best = np.maximum(np.where(p >= self.format_cut, p, 0), np.where(q >= self.context_cut, q, 0))
        return np.where([c.kind != "secret" and c.by_format == 0 for c in found], 0, best)


def calibrate(p: np.ndarray, y: np.ndarray, precision: float, weight: np.ndarray | None = None) -> float:
    """The least threshold at or above which held-out candidates, each standing for `weight` ones, are right as often as
    asked; above 1 where none is."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(-p, kind="stable")
    right = np.cumsum((weight * y)[order]) / np.maximum(1e-9, np.cumsum(weight[order]))
    last = np.append(p[order][1:] != p[order][:-1], True)  # equal scores stand or fall together
    good = np.flatnonzero((right >= precision) & last) if len(y) else np.zeros(0, int)
    return max(0.5, float(p[order][good[-1]])) if len(good) else 2.0


#: Candidates of each kind and pair of labels weigh as much as so many at most when trees are fitted, or the most frequent would
#: drown all others; a third is held out, and of those, each for itself, this precision is asked.
BALANCE, PRECISION = 750, 0.98
#: Different cells that the driver fits on by itself at most; of more, tasks hand it sums.
CELLS = 1 << 14
#: Cells that a task counts before it hands them on, and about what a task sums.
HELD = 50_000
GROUP = ("kind", "by_format", "by_context")
COUNTED = "view string, kind string, by_format int, by_context int, held boolean, cell array<int>, n long"


def once(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that may hold candidates; rows that share both count once, and only such are moved."""
    rows = docs.select("doc_id", "text").filter(F.col("text").rlike(SOME))
    mark = F.xxhash64("text").alias("_m")
    again = docs.filter("text is not null").groupBy("doc_id", mark).count().filter("count > 1")
    again = materialise(again.select(F.col("doc_id").alias("_id"), "_m"), "again")
    if again.isEmpty():
        return rows
    rows = rows.withColumn("_h", mark)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_m"))
    return rows.join(again, same, "left_anti").select("doc_id", "text").union(rows.join(again, same, "left_semi").select("doc_id", "text").distinct())


def counted(docs: DataFrame) -> DataFrame:
    """How many candidates that the other view can label fall into each cell: (view, kind, by_format, by_context, held, cell, n).
    All of them are counted, combined before the shuffle. A third is held out by a hash of document, place and surroundings."""
    names = [part.split()[0] for part in COUNTED.split(", ")]

    def run(batches):
        seen: Counter = Counter()

        def handed():
            rows = [(view, *group, held, list(cell), n) for (view, group, held, cell), n in seen.items()]
            for i in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + 1000]], schema=schema)
            seen.clear()

        for batch in batches:
            for part in slices(batch):
                found, held = [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for c in candidates(text):
                        if c.by_format >= 0 or c.by_context >= 0:
                            about = f"{doc_id}:{c.start}:{c.end}:{c.kind}:{text[max(0, c.start - NEAR) : c.end + 2]}"
                            found.append(c)
                            held.append(crc32(about.encode("utf-8", "replace")) % 3 == 0)
                if not found:
                    continue
                by_format = placed(np.array([c.format for c in found]))
                by_context = np.array([c.context for c in found]).astype(np.uint8)
                for c, out, f, q in zip(found, held, by_format, by_context, strict=True):
                    group = (c.kind, c.by_format, c.by_context)
                    if c.by_context >= 0:
                        seen["format", group, out, f.tobytes()] += 1
                    if c.by_format >= 0:
                        seen["context", group, out, q.tobytes()] += 1
                if len(seen) > HELD:
                    yield from handed()
        yield from handed()

    kinds = {"view": pa.string(), "kind": pa.string(), "by_format": pa.int32(), "by_context": pa.int32(), "held": pa.bool_(), "cell": pa.list_(pa.int32())}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    return _summed(once(docs).mapInArrow(run, COUNTED))


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("view", *GROUP, "held", "cell").agg(F.sum("n").alias("n"))


def blocks(cells: DataFrame, scale: dict[tuple, float], label: str) -> DataFrame:
    """Cells, labels and weights as bytes, a batch of them in a row: stored, as each level of each tree reads them."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = np.array(batch.column("n"), float)
                of = zip(*[batch.column(g).to_pylist() for g in GROUP], strict=True)
                w = n * np.array([scale[group] for group in of])
                x = np.array(batch.column("cell").flatten()).astype(np.uint8)
                y = np.array(batch.column(label)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (x, y, w)], ["x", "y", "w"])

    ship(cells.sparkSession)
    dealt = cells.repartition(1 + cells.count() // HELD)
    return materialise(dealt.mapInArrow(run, "x binary, y binary, w binary"), "blocks")


def _sums(rows: DataFrame, trees: Trees, f: np.ndarray, c: np.ndarray, level: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the nodes of one level of the tree (f, c) that comes after `trees`: first and second derivatives by node, feature and
    place, and weights by node. All are rounded to a fixed step, so their sums are exact and don't depend on how cells are dealt."""
    nodes, step = 2**level, 2.0**32
    n = nodes * wide * PLACES

    def run(batches):
        total = np.zeros(2 * n + nodes)
        for batch in batches:
            for x, y, w in zip(*[batch.column(k).to_pylist() for k in ("x", "y", "w")], strict=True):
                x, y, w = np.frombuffer(x, np.uint8).reshape(-1, wide), np.frombuffer(y, np.uint8), np.frombuffer(w)
                p = trees.score(x)
                node, at = np.zeros(len(x), int), np.arange(len(x))
                for _ in range(level):
                    node = 2 * node + 1 + (x[at, f[node]] > c[node])
                node -= nodes - 1
                place = ((node[:, None] * wide + np.arange(wide)) * PLACES + x).ravel()
                g, h, w = (np.round(v * step) for v in (w * (y - p), w * p * (1 - p), w))
                total += np.concatenate([np.bincount(place, np.repeat(g, wide), n), np.bincount(place, np.repeat(h, wide), n), np.bincount(node, w, nodes)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = sum(np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()) / step
    g, h = total[: 2 * n].reshape(2, nodes, wide, PLACES)
    return g, h, total[2 * n :]


def fit_apart(rows: DataFrame, wide: int, start: float, rounds: int = 60, depth: int = 3, rate: float = 0.2) -> Trees:
    """What `fit` gives, of any number of cells: `rows` are their `blocks`, `wide` the number of features. Tasks sum, the driver
    only sees sums by node, feature and place."""
    inner, last = 2**depth - 1, 2 ** (depth - 1)
    trees = Trees(start, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.arange(PLACES)] * wide
    for _ in range(rounds):
        f, c = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            g, h, w = _sums(rows, trees, f, c, level, wide)
            for own in range(2**level):
                if w[own] >= 10:
                    k = 2**level - 1 + own
                    f[k], c[k] = _best_cut(list(zip(g[own], h[own], strict=True)), cuts, g[own, 0].sum(), h[own, 0].sum())
        leaves = np.zeros((2, inner + 1))
        for own in range(last):
            k = last - 1 + own
            left = np.arange(PLACES) <= c[k]
            for out, v in zip(leaves, (g[own, f[k]], h[own, f[k]]), strict=True):
                out[2 * own], out[2 * own + 1] = v[left].sum(), v[~left].sum()
        value = rate * leaves[0] / (leaves[1] + 1.0)
        trees = Trees(start, np.vstack([trees.features, f]), np.vstack([trees.cuts, c]), np.vstack([trees.leaves, value]))
    return trees


def calibrate_apart(cells: DataFrame, trees: Trees, label: str, precision: float) -> float:
    """What `calibrate` gives, of any number of held-out cells: a score's candidates count together, and running sums over the
    scores, the highest first, are made in pieces."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("cell").flatten()).astype(np.uint8).reshape(batch.num_rows, -1)
                right = np.array(batch.column("n")) * np.array(batch.column(label))
                yield pa.RecordBatch.from_arrays([pa.array(-trees.score(x)), pa.array(right, pa.int64()), batch.column("n")], ["below", "right", "n"])

    ship(cells.sparkSession)
    scores = cells.mapInArrow(run, "below double, right long, n long").groupBy("below").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
    scores = scores.repartitionByRange(1 + cells.count() // HELD, "below").withColumn("piece", F.spark_partition_id())
    rows = materialise(scores, "scores")
    for name in ("right", "n"):
        rows = with_running_sum(rows, [], ["below"], F.col("piece"), F.col(name), f"{name}_so_far")
    least = rows.filter(F.col("right_so_far") / F.col("n_so_far") >= precision).agg(F.max("below")).first()[0]
    return 2.0 if least is None else max(0.5, -least)


def train(docs: DataFrame, balance: int = BALANCE, precision: float = PRECISION) -> Model:
    """Fit on all candidates that format or context can label, as counts of cells: the format's on its grid, the context's are
    yes or no by themselves and a few thousand at most. However many cells there are, all stay as fine as the grid."""
    cells = materialise(counted(docs), "cells")

    def judge(view: str, names: tuple[str, ...], label: str) -> tuple[Trees, float]:
        own = cells.filter(F.col("view") == view)
        if own.limit(CELLS + 1).count() > CELLS:
            return _judged_apart(own, len(names), label, balance, precision)
        rows = sorted(own.collect(), key=lambda r: (*[r[g] for g in GROUP], r["held"], r["cell"]))
        x, y = np.array([r["cell"] for r in rows], float).reshape(len(rows), len(names)), np.array([r[label] for r in rows], float)
        groups, n = [tuple(r[g] for g in GROUP) for r in rows], np.array([r["n"] for r in rows], float)
        whole: Counter = Counter()
        for group, k in zip(groups, n, strict=True):
            whole[group] += k
        weight = n * np.array([min(1, balance / whole[group]) for group in groups])
        out = np.array([r["held"] for r in rows], bool)
        trees = fit(x[~out], y[~out], weight[~out])
        return trees, calibrate(trees.score(x[out]), y[out], precision, n[out])

    return Model(*judge("format", FORMAT, "by_context"), *judge("context", CONTEXT, "by_format"))


def _judged_apart(own: DataFrame, wide: int, label: str, balance: int, precision: float) -> tuple[Trees, float]:
    counts = own.groupBy(*GROUP, "held").agg(F.sum("n").alias("n")).collect()
    whole: Counter = Counter()
    for r in counts:
        whole[tuple(r[g] for g in GROUP)] += r["n"]
    scale = {group: min(1, balance / k) for group, k in whole.items()}
    fitted = [(r[label], r["n"] * scale[tuple(r[g] for g in GROUP)]) for r in counts if not r["held"]]
    if not fitted:
        return NOTHING, calibrate_apart(own, NOTHING, label, precision)
    start = _start(sum(y * w for y, w in fitted) / sum(w for _, w in fitted))
    trees = fit_apart(blocks(own.filter("not held"), scale, label), wide, start)
    return trees, calibrate_apart(own.filter("held"), trees, label, precision)


#: Steps that leave one place of each feature of GRID.
COARSEST = 6


def joined(cells: DataFrame) -> tuple[DataFrame, int]:
    """The cells of the format with places joined until there are at most CELLS, and the steps that took: a rougher view of them.
    Nothing is fitted on it."""
    smooth = F.array(*[F.lit(name in GRID) for name in FORMAT])
    for coarse in range(COARSEST + 1):
        steps = F.transform("cell", lambda v, i: F.when(F.get(smooth, i), F.shiftright(v, coarse)).otherwise(v))  # noqa: B023
        own = cells if coarse == 0 else _summed(cells.withColumn("cell", steps))
        if coarse == COARSEST or own.limit(CELLS + 1).count() <= CELLS:
            return own, coarse


def added(found: list[Candidate], p: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, probability) of candidates with a probability above 0, the likeliest and then the longest first,
    without those that overlap a base span or one already chosen."""
    taken: list[tuple[int, int]] = []  # apart and in order
    for s, _, e in sorted(base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = []
    for i in sorted(np.flatnonzero(p > 0), key=lambda i: (-p[i], found[i].start - found[i].end, found[i].start, found[i].kind)):
        c = found[i]
        at = bisect_left(taken, (c.start, c.end))
        if (at == 0 or taken[at - 1][1] <= c.start) and (at == len(taken) or c.end <= taken[at][0]):
            taken.insert(at, (c.start, c.end))
            out.append((c.start, c.end, c.kind, float(p[i])))
    return sorted(out)


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean, probability: double>>"


def _spans(text: str, found: list[Candidate], p: np.ndarray) -> list[dict]:
    base = base_spans(text)
    rows = [(s, k, {"kind": KINDS[k], "start": s, "end": e, "base": True, "probability": 1.0}) for s, k, e in base]
    for s, e, kind, q in added(found, p, base):
        order = KINDS.index(kind) if kind in KINDS else len(KINDS)
        rows.append((s, order, {"kind": kind, "start": s, "end": e, "base": False, "probability": q}))
    return [r[2] for r in sorted(rows, key=lambda r: r[:2])]


def _redacted(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Model, redact: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the spans of each row of `docs`, in code points, by start; with `redact` also the text with a tag for each
    stretch of spans. A null text has no spans and stays null. Repeated rows stay."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    some = F.coalesce(F.col("text").rlike(SOME), F.lit(False))
    wanted = [*keep, "text", "spans"] if redact else [*keep, "spans"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep), *(["text string"] if redact else []), f"spans {SPANS}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                found = [candidates(t) for t in texts]
                p = np.split(model.score([c for own in found for c in own]), np.cumsum([len(own) for own in found])[:-1])
                spans = [_spans(*of) for of in zip(texts, found, p, strict=True)]
                own = [part.column(c) for c in keep]
                new = [pa.array([_redacted(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())] if redact else []
                yield pa.RecordBatch.from_arrays([*own, *new, pa.array(spans, kind)], wanted)

    # Rows that can hold no candidate never leave the JVM.
    looked = docs.filter(some).select(*keep, "text").mapInArrow(run, schema)
    rest = docs.filter(~some).withColumn("spans", F.array().cast(SPANS))
    return looked.unionByName(rest.select(*looked.columns))


def _equal(value: str):
    return lambda x: x == value


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of their list, and the list of all spans."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equal(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with all their columns, whatever these are called, spans replaced by tags in text, and n_chars, where there is
    one, counted anew."""
    plain = plain_names(docs)
    others = tuple(c for c in plain.columns if c != "text")
    out = named(find(plain, train(docs), redact=True, keep=others), docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
