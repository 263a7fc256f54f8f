"""Ranked lexical search of all documents for many items by two trees.

Over the items and over the documents stand hierarchies whose nodes hold the largest value of each coordinate: of an item the
weights of its terms, of a document what each of its terms is worth in it. The product of two nodes' maxima bounds every score
below them, so a pair of nodes whose bound is below the weakest k-th score of the items' node is dropped with all its pairs.
Pairs are visited from the highest bound down.

Documents are laid out by their heaviest term, so that those with a rare term in common share a leaf. Each task builds trees over
the documents that it reads, a bounded number at a time. A first pass looks at each item's most promising leaf in each task;
the best k-th score of any task is where all tasks start in the second."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.base import LOWER, UPPER, lower_ascii, ship
from fieldspark.session import materialise

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: For bytes.translate: A-Z in lower case, a blank for all that separates terms.
TO_TERMS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
#: Terms of the items that are searched in one pass, summed over the items: what a task and the driver hold.
TERMS_AT_ONCE = 65_536
#: Documents of a leaf, nodes below one node of the documents' tree, items of a leaf, and coordinates of all leaves in memory.
LEAF, FAN, ITEMS, COORDINATES = 32, 8, 4, 4_000_000


def terms(text: bytes) -> list[bytes]:
    return text.translate(TO_TERMS).split()


def length_factor(n: int, documents: int, total: int) -> int:
    return 100 - 90 + (90 * n * documents) // total


class ItemTree:
    """Items in the order of the tree's leaves; nodes as (first, last, their terms, children)."""

    def __init__(self, items: list[tuple[object, list[int]]], weight: np.ndarray):
        self.nodes: list[tuple[int, int, np.ndarray, list[int]]] = []
        self.order: list[int] = []
        self.weight = weight
        self.vectors = [np.array(sorted(t), np.int64) for _, t in items]
        self.root = self._build(list(range(len(items))))
        self.ids = [items[i][0] for i in self.order]
        self.terms = [self.vectors[i] for i in self.order]

    def _build(self, own: list[int]) -> int:
        first = len(self.order)
        union = np.unique(np.concatenate([self.vectors[i] for i in own]))
        children: list[int] = []
        if len(own) <= ITEMS:
            self.order += own
        else:
            # Those that share more weight with one of two unlike items go together.
            shared = lambda a, b: int(self.weight[np.intersect1d(self.vectors[a], self.vectors[b], assume_unique=True)].sum())
            a = own[0]
            b = min(own[1:], key=lambda i: (shared(a, i), i))
            ranked = sorted(own, key=lambda i: (shared(b, i) - shared(a, i), i))
            children = [self._build(ranked[: len(own) // 2]), self._build(ranked[len(own) // 2 :])]
        self.nodes.append((first, len(self.order), union, children))
        return len(self.nodes) - 1


class DocumentTree:
    """Documents as rows of (term, worth), leaves of LEAF documents in the order given, and maxima of worth times weight."""

    def __init__(self, docs: np.ndarray, starts: np.ndarray, ids: np.ndarray, worth: np.ndarray, weight: np.ndarray):
        self.docs, self.starts, self.ids, self.worth = docs, starts, ids, worth
        leaves = -(-len(docs) // LEAF)
        top = np.zeros((leaves, len(weight)), np.int64)
        leaf = np.repeat(np.arange(len(docs)) // LEAF, np.diff(starts))
        np.maximum.at(top, (leaf, ids), worth * weight[ids])
        self.levels = [top]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append(np.maximum.reduceat(low, np.arange(0, len(low), FAN), axis=0))

    def children(self, level: int, node: int) -> range:
        return range(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1])))


class Search:
    """The k best documents of each item among those shown so far; `floor` are scores that k documents are known to reach."""

    def __init__(self, tree: ItemTree, k: int, floor: np.ndarray):
        self.tree, self.k = tree, k
        self.kth = floor.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in tree.ids]

    def offer(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.kth[item])
        if good.any():
            new = self.best[item] + list(zip((-scores[good]).tolist(), docs[good].tolist(), strict=True))
            self.best[item] = heapq.nsmallest(self.k, new)
            if len(self.best[item]) == self.k:
                self.kth[item] = max(self.kth[item], -self.best[item][-1][0])

    def score(self, first: int, last: int, union: np.ndarray, docs: DocumentTree, leaf: int) -> None:
        """All items of a leaf with all documents of one."""
        a, b = leaf * LEAF, min((leaf + 1) * LEAF, len(docs.docs))
        part = slice(docs.starts[a], docs.starts[b])
        at = np.minimum(np.searchsorted(union, docs.ids[part]), len(union) - 1)
        worth = np.where(union[at] == docs.ids[part], docs.worth[part], 0)
        for item in range(first, last):
            weight = np.zeros(len(union), np.int64)
            own = np.searchsorted(union, self.tree.terms[item])
            weight[own] = self.tree.weight[self.tree.terms[item]]
            self.offer(item, docs.docs[a:b], np.add.reduceat(weight[at] * worth, docs.starts[a:b] - docs.starts[a]))

    def visit(self, docs: DocumentTree) -> int:
        """Pairs from the highest bound down; returns how many pairs of leaves were evaluated."""
        nodes, evaluated, ties = self.tree.nodes, 0, 0
        root = (len(docs.levels) - 1, 0)
        heap = [(-int(docs.levels[-1][0][nodes[self.tree.root][2]].sum()), ties, self.tree.root, *root)]
        while heap:
            bound, _, node, level, at = heapq.heappop(heap)
            first, last, union, below = nodes[node]
            if -bound <= 0 or -bound < self.kth[first:last].min():
                continue
            if level == 0 and not below:
                self.score(first, last, union, docs, at)
                evaluated += 1
                continue
            rows = list(docs.children(level, at)) if level else [at]
            level = max(level - 1, 0)
            for child in below or [node]:
                first, last, union, _ = nodes[child]
                bounds = docs.levels[level][np.ix_(rows, union)].sum(1)
                for r, most in zip(rows, bounds.tolist(), strict=True):
                    if most > 0 and most >= self.kth[first:last].min():
                        ties += 1
                        heapq.heappush(heap, (-most, ties, child, level, r))
        return evaluated

    def glance(self, docs: DocumentTree) -> None:
        """Each item leaf with the document leaf of the highest bound only."""
        for first, last, union, below in self.tree.nodes:
            if not below:
                self.score(first, last, union, docs, int(docs.levels[0][:, union].sum(1).argmax()))


def _chunks(batches: Iterator[pa.RecordBatch], weight: np.ndarray) -> Iterator[DocumentTree]:
    """Trees over so many documents that their leaves' coordinates fit the bound."""
    room = LEAF * max(1, COORDINATES // max(1, len(weight)))
    held: list[pa.RecordBatch] = []
    size = 0

    def tree() -> DocumentTree:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table["terms"].chunk(0)
        starts = lists.offsets.to_numpy().astype(np.int64)
        return DocumentTree(table["doc_id"].to_numpy(), starts - starts[0], lists.flatten().to_numpy().astype(np.int64), table["worth"].chunk(0).flatten().to_numpy(), weight)

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, room - size)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(part.num_rows)
            if size == room:
                yield tree()
                held, size = [], 0
    if held:
        yield tree()


def rank_documents(items: DataFrame, documents: DataFrame, k: int = 10, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents (doc_id, text) with the highest scores above 0 for each item
    (item_id, text); equal scores by smaller doc_id.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A score sums w * (10^9 tf div (1000 tf + 8 m))
    over an item's distinct terms, with w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, N documents with a
    term, L terms in all, n in the document. Null and empty texts have no terms. Rows of one item_id are one item with all their
    terms, a null one too; rows of documents count each, so repeated rows rank each; a null doc_id counts but isn't ranked. Empty
    tables give no rows; other columns are ignored. Items are searched in batches of about `at_once` terms, whole texts always."""
    spark = documents.sparkSession
    ship(spark)
    item_type = items.schema["item_id"].dataType.simpleString()
    out_type = f"item_id {item_type}, doc_id long, score long"
    words = F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)))
    asked = materialise(items.select("item_id", words.alias("term")).distinct(), "item-terms")
    batches = math.ceil(asked.count() / at_once)
    found = None
    for number in range(batches):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == number)
        here = _search(spark, own, documents, k, out_type)
        found = here if found is None or here is None else found.unionByName(here)
    if found is None:
        found = spark.createDataFrame([], out_type)
    ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search(spark, asked: DataFrame, documents: DataFrame, k: int, out_type: str) -> DataFrame | None:
    """The candidates of one batch of items, at least the k best of each; None without terms or documents."""
    by_item: dict[object, list[str]] = {}
    for r in asked.collect():
        by_item.setdefault(r.item_id, []).append(r.term)
    number = {t: i for i, t in enumerate(sorted({t for ts in by_item.values() for t in ts}))}
    if not number:
        return None
    vocabulary = spark.sparkContext.broadcast({t.encode(): i for t, i in number.items()})

    def count(batches):
        get = vocabulary.value.get
        for batch in batches:
            sizes, ids, tfs = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text or b"")
                seen = Counter(map(get, words))
                seen.pop(None, None)
                sizes.append(len(words))
                ids.append(list(seen))
                tfs.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"]
            )

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    index = materialise(texts.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>"), "term-counts")
    n_docs, total = index.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return None
    weight = np.full(len(number), 0, np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        weight[r.t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    items = ItemTree([(i, [number[t] for t in ts]) for i, ts in by_item.items()], weight)

    def place(batches):
        for batch in batches:
            out = []
            for doc, n, ids, tfs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tfs")), strict=True):
                m = length_factor(n, n_docs, total)
                out.append((doc, max(ids, key=lambda t: (weight[t], t)), m, ids, [1_000_000_000 * tf // (1000 * tf + 8 * m) for tf in tfs]))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "lead", "m", "terms", "worth"])

    placed = index.filter("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(place, "doc_id long, lead int, m long, terms array<int>, worth array<long>")
    placed = placed.repartitionByRange("lead", "m", "doc_id").sortWithinPartitions("lead", "m", "doc_id").select("doc_id", "terms", "worth")
    placed = materialise(placed, "documents-by-term")
    tree = spark.sparkContext.broadcast(items)

    def glance(batches):
        search = Search(tree.value, k, np.zeros(len(tree.value.ids), np.int64))
        for docs in _chunks(batches, tree.value.weight):
            search.glance(docs)
        reached = [i for i, best in enumerate(search.best) if len(best) == k]
        yield pa.RecordBatch.from_arrays([pa.array(reached, pa.int32()), pa.array([int(search.kth[i]) for i in reached], pa.int64())], ["item", "kth"])

    floor = np.zeros(len(items.ids), np.int64)
    for r in placed.mapInArrow(glance, "item int, kth long").groupBy("item").agg(F.max("kth").alias("kth")).collect():
        floor[r.item] = r.kth
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    id_type = to_arrow_type(_parse_datatype_string(out_type)["item_id"].dataType)

    def look(batches):
        search = Search(tree.value, k, floor)
        for docs in _chunks(batches, tree.value.weight):
            search.visit(docs)
        rows = [(tree.value.ids[i], doc, -score) for i, best in enumerate(search.best) for score, doc in best]
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item_id", "doc_id", "score"])

    return placed.mapInArrow(look, out_type)
