"""Quality classifier: heuristic labellers overlap and err, expectation-maximisation estimates how often each is right,
and posterior labels train a hashed linear scorer, one head for quality and one for abuse.

The labellers read only a bounded sample of documents that have a row in the labels table; that row's opinion is one labeller
among the others. The scorer then reads every whole text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.base import LOWER_STR, SPACE, named, plain_names, ship, small_batches
from fieldspark.llm.bpe import Memo, slices

#: Documents that labellers read, a quarter of them held out for the thresholds.
SAMPLE = 4_000
#: Hashed features, and how many standard errors apart a feature's frequency must be in the two classes to have a weight:
#: among hundreds of words of a text, weights of chance would drown those of a few.
DIMS, APART = 1 << 18, 5.0
#: Share of clean held-out documents that a threshold may cost.
LOSS = 0.002
WORD = re.compile(f"[^{SPACE}]+")
SYMBOLS = frozenset("#*$%&|<>!=_~^@{}[]\\")
#: Words whose weights a task remembers, at about 300 bytes each.
WORDS = 100_000
INSULTS = frozenset(("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "imbecile", "jerk"))
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def echoes(ws: list[str]) -> float:
    """Share of three-word runs that came before."""
    runs = max(1, len(ws) - 2)
    return 1 - len(set(zip(ws, ws[1:], ws[2:], strict=False))) / runs if len(ws) > 2 else 0.0


def quality_votes(text: str, ws: list[str], opinion: int) -> list[int]:
    """1 for good, -1 for bad, 0 for no opinion."""
    n = max(1, len(ws))
    odd = sum(any(c in SYMBOLS for c in w) for w in ws) / n
    capitals = sum(len(w) > 1 and w.isupper() for w in ws) / n
    fresh, echo = len(set(ws)) / n**0.6, echoes(ws)
    lines = [x for x in text.split("\n") if x.strip()]
    again = 1 - len(set(lines)) / max(1, len(lines))
    ends = sum(w[-1] in ".?" for w in ws) / n
    return [
        opinion,
        -1 if odd > 0.25 else 0,
        -1 if capitals > 0.4 else 0,
        -1 if fresh < 0.5 else 0,
        -1 if echo > 0.2 else 0,
        -1 if len(lines) > 3 and again > 0.5 else 0,
        -1 if odd > 0.1 or capitals > 0.25 else 1 if odd < 0.03 and capitals < 0.1 and fresh > 0.9 and echo < 0.1 else 0,
        1 if 0.01 <= ends <= 0.4 and odd < 0.05 else 0,
    ]


def abuse_votes(text: str, ws: list[str], opinion: int) -> list[int]:
    found = {x for w in set(ws) for x in LETTERS.findall(w.translate(LOWER_STR)) if x in INSULTS}
    return [opinion, -1 if found else 0, -1 if len(found) > 1 else 0]


def posterior(votes: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each row, and each labeller's accuracy when voting for and against: expectation-maximisation from 0.8, the
    first labeller (a reader's opinion) from 0.95. A vote less often right than the prior alone counts nothing, so that none
    turns round."""
    m = votes.shape[1]
    right = np.full((2, m), 0.8)
    right[:, 0] = 0.95
    logit = lambda p: np.log(p / (1 - p))
    p = np.full(len(votes), prior)
    for _ in range(rounds):
        base = logit(prior)
        up, down = np.maximum(0, logit(right[0]) - base), np.minimum(0, -logit(right[1]) - base)
        p = 1 / (1 + np.exp(-(base + (votes > 0) @ up + (votes < 0) @ down)))
        was = right.copy()
        for row, side, good in ((0, votes > 0, p), (1, votes < 0, 1 - p)):
            right[row] = np.clip((side.T @ good + 8) / (side.sum(0) + 10), 0.02, 0.99)
        prior = float(np.clip((p.sum() + 8) / (len(p) + 10), 0.5, 0.98)) if len(p) else prior
        if np.abs(was - right).max() < 1e-4:
            break
    return p, right


def place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & (DIMS - 1)


#: Characters of a piece of a word, and kinds of characters of one shape.
PIECE, KINDS = 24, 8


def shape(piece: str) -> str:
    """Letters, capitals, digits and other characters, each kind once in a row."""
    out = ""
    for c in piece:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if out[-1:] != k:
            out += k
    return out


def shapes(word: str) -> list[tuple[int, float]]:
    """Places of the shapes of a word, and their weights, together 1 if it is no longer than PIECE. A run of more than PIECE characters, such as a line of a
    script without spaces, counts as consecutive pieces: 1 each, and the last by its length. All of a piece's shape counts."""
    out = []
    for i in range(0, len(word), PIECE):
        piece = word[i : i + PIECE]
        whole = shape(piece)
        parts = [whole[k : k + KINDS] for k in range(0, len(whole), KINDS)]
        weight = (len(piece) / PIECE if len(word) > PIECE else 1.0) / len(parts)
        out += [(place("s " + x), weight) for x in parts]
    return out


def word_features(word: str) -> tuple[int, int]:
    """Of the abuse head: the letters and how they begin."""
    letters = "".join(LETTERS.findall(word)).lower()
    return place("w " + letters), place("p " + letters[:5])


def text_features(ws: list[str], distinct: int) -> tuple[int, ...]:
    n = len(ws)
    fresh = min(20, int(10 * distinct / max(1, n) ** 0.6))
    return place(f"fresh {fresh}"), place(f"echo {int(10 * echoes(ws))}"), place(f"length {min(20, n.bit_length())}")


@dataclass(frozen=True)
class Scorer:
    """quality: weights over shapes, by their shares of all pieces of words, and over text features; abuse: over distinct words. Cuts are least log odds of
    quality and greatest of abuse that a kept document may have."""

    quality: np.ndarray
    quality_bias: float
    quality_cut: float
    abuse: np.ndarray
    abuse_bias: float
    abuse_cut: float

    def memos(self):
        q, a = self.quality, self.abuse

        def of(word):
            own, (w, p) = shapes(word), word_features(word)
            return sum(float(q[s]) * x for s, x in own), sum(x for _, x in own), float(a[w] + a[p])

        return Memo(of, WORDS)

    def score(self, text: str | None, memo: Memo) -> tuple[float, float]:
        """Log odds of quality and of abuse."""
        ws = words(text)
        if not ws:
            return -9.0, -9.0
        counts = Counter(ws)
        pairs = [*map(memo.__getitem__, counts)]
        own = sum(float(self.quality[k]) for k in text_features(ws, len(counts)))
        seen, weight = (sum([c * x[k] for c, x in zip(counts.values(), pairs, strict=True)]) for k in (0, 1))
        return self.quality_bias + own + SHARE * seen / weight, self.abuse_bias + sum([x[2] for x in pairs])


#: A share counts so many times, that weights of shares and of single features be of one size.
SHARE = 8.0


def _fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n: int, rounds: int = 120, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows and soft labels (Adam on whole batches). Classes weigh the same together."""
    w, b = np.zeros(DIMS), 0.0
    if not n:
        return w, b
    weight = y / max(1e-9, y.sum()) + (1 - y) / max(1e-9, (1 - y).sum())
    used = np.unique(cols)
    slot = np.zeros(DIMS, np.int32)
    slot[used] = np.arange(len(used))
    cols = slot[cols]
    v = np.zeros(len(used) + 1)
    m1, m2 = np.zeros_like(v), np.zeros_like(v)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, values * v[cols], n) + v[-1]
        g = weight * (1 / (1 + np.exp(-z)) - y)
        grad = np.append(np.bincount(cols, values * g[rows], len(used)), g.sum()) + penalty * v
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        v -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-7)
    w[used] = v[:-1]
    return w, float(v[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Fit on at most `sample` documents that have labels, the smallest by a hash of doc_id, of repeated ones the text that is
    smallest by a hash. Without any, everything with a word passes."""
    own = labels.select("doc_id", "quality", "toxic").filter("doc_id is not null and quality is not null and toxic is not null")
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    every = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id")
    chosen = every.groupBy("doc_id", "quality", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc_id, text, good, toxic in zip(*[part.column(c).to_pylist() for c in ("doc_id", "text", "quality", "toxic")], strict=True):
                    ws = words(text)
                    counts = Counter(ws)
                    weights: dict[int, float] = {}
                    for w, c in counts.items():
                        for k, x in shapes(w):
                            weights[k] = weights.get(k, 0.0) + c * x
                    out.append(
                        {
                            "doc_id": doc_id,
                            "q_votes": quality_votes(text, ws, 1 if good else -1), "a_votes": abuse_votes(text, ws, -1 if toxic else 1),
                            "shapes": [*weights], "tally": [*weights.values()], "own": list(text_features(ws, len(counts))), "names": [x for w in counts for x in word_features(w)],
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.list_(pa.float32()) if c == "tally" else ints) for c in ("q_votes", "a_votes", "shapes", "tally", "own", "names"))])
    ddl = "doc_id long, q_votes array<int>, a_votes array<int>, shapes array<int>, tally array<float>, own array<int>, names array<int>"
    got = chosen.mapInArrow(run, ddl).toArrow().sort_by("doc_id")
    n = got.num_rows
    if not n:
        return Scorer(np.zeros(DIMS), 9.0, 0.0, np.zeros(DIMS), -9.0, 0.0)
    column = {c: got.column(c).combine_chunks() for c in ("q_votes", "a_votes", "shapes", "tally", "own", "names")}
    held = np.arange(n) % 4 == 0

    def sparse(name):
        """Rows and entries of a column of lists."""
        lists = column[name]
        return np.repeat(np.arange(n, dtype=np.int32), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()

    def votes(name):
        return np.array(column[name].to_pylist()).reshape(n, -1)

    q, _ = posterior(votes("q_votes"), 0.85)
    a, _ = posterior(votes("a_votes"), 0.9)
    rows, tally = sparse("tally")
    share = (SHARE * tally / np.maximum(1e-9, np.bincount(rows, tally, n))[rows]).astype(np.float32)
    forms, texts, names = sparse("shapes"), sparse("own"), sparse("names")
    qx = tuple(np.concatenate([x, y]) for x, y in zip((*forms, share), (*texts, np.ones(len(texts[0]), np.float32)), strict=True))
    ax = (*names, np.ones(len(names[0]), np.float32))

    def head(x, y):
        rows, cols, values = x
        train_rows = ~held[rows]
        once = np.unique(rows[train_rows].astype(np.int64) * DIMS + cols[train_rows])
        seen, bad = (np.bincount(once % DIMS, v, DIMS) for v in (np.ones(len(once)), 1 - y[once // DIMS]))
        share = (1 - y[~held]).mean()
        z = (bad - share * seen) / np.sqrt(np.maximum(1e-9, share * (1 - share) * seen) + 1)
        keep = train_rows & (np.abs(z) >= APART)[cols]
        slot = np.cumsum(~held) - 1
        w, b = _fit(slot[rows[keep]], cols[keep], values[keep], y[~held], int((~held).sum()))
        z = np.bincount(rows, values * w[cols], n) + b
        return w, b, z[held], y[held]

    qw, qb, z, y = head(qx, q)
    good = np.sort(z[y > 0.5])
    q_cut = min(0.0, float(good[int(LOSS * len(good))])) if len(good) else 0.0
    aw, ab, z, y = head(ax, 1 - a)
    clean = np.sort(z[y < 0.5])[::-1]
    a_cut = max(0.0, float(clean[int(LOSS * len(clean))])) if len(clean) else 0.0
    return Scorer(qw.astype(np.float32), qb, q_cut, aw.astype(np.float32), ab, a_cut)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` (by default doc_id) of each row of `docs`, quality and abuse (probabilities) and kept. A text without words, null
    included, has quality near 0 and goes. Repeated rows stay; other columns are ignored."""
    scorer = train(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # DIMS weights, whatever the corpus
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "quality double, abuse double, kept boolean"])
    names = [f.name for f in fields]

    def run(batches):
        own = shared.value
        memo = own.memos()
        for batch in batches:
            for part in slices(batch):
                z = np.array([own.score(t, memo) for t in part.column("text").to_pylist()]).reshape(-1, 2)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                kept = (z[:, 0] >= own.quality_cut) & (z[:, 1] <= own.abuse_cut)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(kept)], [*names, "quality", "abuse", "kept"])

    read = [*names, *(["text"] if "text" not in names else [])]
    return docs.select(*read).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with all their columns, whatever these are called."""
    plain = plain_names(docs)
    return named(classify(plain, labels, sample, tuple(plain.columns)).filter("kept"), docs.columns)
