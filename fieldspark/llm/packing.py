"""Packing documents into sequences of a fixed number of tokens.

A window's worth of tokens at the front of a long document is a sequence of its own; what is left of each document is
packed by non-negative least squares. Combinations of two or three lengths that fill a window exactly are the columns,
the histogram of lengths is the right-hand side, and the solution, rounded down, says how often each is used. What
rounding leaves is packed greedily: the longest piece that fits goes next, and where none fits one is cut. The last,
partly filled window is cut into powers of two, which need no padding.

Every task packs what it reads, in blocks of a bounded number of tokens. So nothing is shuffled, no task needs more
memory when the input grows, and a task that is run again gives the same rows."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldspark.llm.base import ship, small_batches
from fieldspark.llm.bpe import codec, slices

WINDOW = 2048
#: Tokens of a block, and columns of its least squares problem.
BLOCK, COLUMNS = 3_000_000, 6_000
#: Pieces of an output batch: 2 MB of ids at most.
PIECES = 256
#: Lengths that are met with all others at once when triples are sought.
ROWS = 128
END_ID = 1


def combinations(lengths: np.ndarray, window: int = WINDOW, most: int = COLUMNS) -> np.ndarray:
    """Rows (a, b, c) of present lengths with a + b + c = window and c <= b <= a; c is 0 in pairs. All pairs, and triples
    evenly thinned to `most`."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    a = lengths[(lengths * 2 >= window) & present[window - lengths]]
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    parts = []
    for low in range(0, max(1, len(lengths)), ROWS):
        x, y = np.meshgrid(lengths[low : low + ROWS], lengths, indexing="ij")
        z = window - x - y
        ok = (x >= y) & (y >= z) & (z > 0)
        x, y, z = x[ok], y[ok], z[ok]
        ok = present[z]
        parts.append(np.stack([x[ok], y[ok], z[ok]], 1))
    triples = np.concatenate(parts)
    if len(triples) > most:
        triples = triples[np.linspace(0, len(triples) - 1, most).astype(int)]
    return np.concatenate([pairs, triples])


def repeats(histogram: np.ndarray, columns: np.ndarray, steps: int = 60) -> np.ndarray:
    """x >= 0 that makes the used lengths fit the histogram in the least squares sense (accelerated projected gradient)."""
    if not len(columns):
        return np.zeros(0)
    weight = (columns > 0).astype(float)
    size = len(histogram)

    def used(x):
        return np.bincount(columns.ravel(), (weight * x[:, None]).ravel(), size)

    def back(r):
        return (r[columns] * weight).sum(1)

    v = np.ones(len(columns))
    for _ in range(8):
        v = back(used(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y + back(histogram - used(y)) / (1.05 * bound))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


def pack(sizes: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items with these many tokens; sequences count from 0 and each is
    full, or as long as a power of two."""
    out, at = [], 0
    left: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, size in enumerate(sizes):
        for start in range(0, size - window + 1, window):
            out.append((item, start, window, at, 0))
            at += 1
        if size % window:
            left[size % window].append((item, size - size % window))
    histogram = np.zeros(window + 1)
    for length, items in left.items():
        histogram[length] = len(items)
    columns = combinations(np.array(sorted(left), dtype=np.int64), window)
    times = np.floor(repeats(histogram, columns) + 1e-6).astype(int)
    for k in np.argsort(-times, kind="stable"):
        if not times[k]:
            break
        need = [int(c) for c in columns[k] if c]
        for _ in range(min([times[k], *(len(left[c]) // need.count(c) for c in need)])):
            offset = 0
            for length in need:
                item, start = left[length].pop()
                out.append((item, start, length, at, offset))
                offset += length
            at += 1
    present = sorted(c for c, items in left.items() if items)
    offset = 0

    def take(length: int) -> tuple[int, int]:
        found = left[length].pop()
        if not left[length]:
            present.remove(length)
        return found

    tail: list[tuple[int, int, int]] = []
    while present:
        fit = bisect_right(present, window - offset)
        length = present[fit - 1] if fit else present[-1]
        item, start = take(length)
        if length > (room := window - offset):
            rest = length - room
            if not left[rest]:
                insort(present, rest)
            left[rest].append((item, start + room))
            length = room
        tail.append((item, start, length))
        offset += length
        if offset == window:
            out += _filled(tail, at)
            tail, offset, at = [], 0, at + 1
    while tail:
        size = 1 << (sum(p[2] for p in tail).bit_length() - 1)
        filled, tail = _cut(tail, size)
        out += _filled(filled, at)
        at += 1
    return out


def _filled(pieces, at):
    offset = 0
    for item, start, length in pieces:
        yield item, start, length, at, offset
        offset += length


def _cut(pieces, size):
    """The first `size` tokens of the pieces, and the rest."""
    first, rest = [], []
    for item, start, length in pieces:
        now = min(size, length)
        if now:
            first.append((item, start, now))
        if length > now:
            rest.append((item, start + now, length - now))
        size -= now
    return first, rest


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all rows of `docs` (doc_id, text): doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset. A
    document is its ids and then END_ID; a null, empty or blank text is END_ID alone. Rows that repeat are packed each
    for itself; other columns are ignored. Sequences have `window` tokens or a power of two, so none is padded."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)

    def run(batches):
        from pyspark import TaskContext

        own, at = codec(path, library=True, limit=400_000), TaskContext.get().partitionId() << 36
        end = END_ID.to_bytes(4, "little")
        doc_ids: list = []
        ids: list[bytes] = []
        held = 0

        def flush():
            nonlocal at, held
            pieces = pack([len(x) // 4 for x in ids], window)
            for low in range(0, len(pieces), PIECES):
                now = pieces[low : low + PIECES]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_ids[p[0]] for p in now], pa.int64()),
                        pa.array([p[1] for p in now], pa.int64()),
                        pa.array([p[2] for p in now], pa.int64()),
                        pa.array([ids[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in now], pa.binary()),
                        pa.array([len(ids[p[0]]) // 4 for p in now], pa.int64()),
                        pa.array([at + p[3] for p in now], pa.int64()),
                        pa.array([p[4] for p in now], pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            at += 1 + max((p[3] for p in pieces), default=0)
            doc_ids.clear()
            ids.clear()
            held = 0

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(own.encode(text) + end)
                    held += len(ids[-1]) // 4
                    if held >= BLOCK:
                        yield from flush()
        if ids:
            yield from flush()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
