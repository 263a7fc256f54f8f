"""Similarity join of word-shingle sets: a size-aware heavy-light join.

Small sets list their fixed-size subsets, of each size that a link asks to share; large sets go into inverted lists. The
boundary between them is the one of least cost for the sizes at hand. An inverted list is not that of one shingle, since a
passage that many texts share would make such lists grow with its square. Shingles are dealt by hash over more parts than a
link allows differences, so that linked sets agree in a whole part, and a list holds the sets that are equal in one part.

A linked set shares more lists with its partner than one, and how many at least is known for each set and band; pairs that share
fewer go before any text is moved, and so do pairs whose sketches differ in more places than a link's sets differ in shingles.
The others are compared by their words themselves, each set first with the smallest it may
link with; only pairs that this leaves in different components are compared further. So a large group of near copies costs a
comparison for each copy, and no link between different components is lost."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import bloom
from fieldspark.llm.base import LOWER, UPPER, map_batches, named, plain_names, ship, small_batches
from fieldspark.llm.bpe import slices
from fieldspark.llm.components import components, reach
from fieldspark.session import materialise

LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Sets above this size never list subsets, and a list key costs as much as so many subset keys, since its candidates
#: are read and compared.
TOP, LIST_COST = 16, 4
#: Lists of at most so many members are finished by pairs of different components, larger ones by blocks of members.
SHORT, BLOCK = 64, 512
#: A list of more members than this is long.
HOT = 16
#: Slots of the filter on lists, each a word in which a key, random bits itself, sets three: 2 MB of bits.
SLOTS = 1 << 18
_U = np.uint64


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case. bytes.split() separates at just the six characters of the contract."""
    return (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()


def shingles(words: list[bytes], k: int) -> set:
    """Distinct k-word shingles; of fewer words, all as one; of none, none."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(k)], strict=False))


def linked(a: set, b: set, percent: int) -> bool:
    if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hashed(words: list[bytes], k: int) -> np.ndarray:
    """The set as sorted 64-bit hashes."""
    if not words:
        return np.zeros(0, _U)
    if len(words) < k:
        return _mix(np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], _U))
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, _U)
    for i in range(k):
        h = h * _U(0x9E3779B97F4A7C15) + w[i : i + n]
    return np.unique(_mix(h))


def shared(s: int, t: int, percent: int) -> int:
    """The least intersection of linked sets of these sizes."""
    return -(-percent * (s + t) // (100 + percent))


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, percent: int) -> list[int]:
    return sorted({c for t in partners(n, percent) if (c := shared(n, t, percent)) <= min(n, t)})


#: A key's last bits say its band.
BAND_BITS = 6


class Bands:
    """Bands of sizes, each half as wide again as its least size. A set is listed in its own band and in each that holds
    the sizes of larger partners; a band has more parts than a link in it has differences, so that linked sets agree in
    several. A set may then do without some of its parts: those where it has nothing, and those in long lists."""

    def __init__(self, percent: int):
        self.percent, self.held = percent, [(6, 9)]

    def of(self, n: int):
        largest = 100 * n // self.percent
        while self.held[-1][1] < largest:
            low = self.held[-1][1] + 1
            self.held.append((low, low + low // 2))
        for band, (low, high) in enumerate(self.held):
            if low <= largest and high >= n:
                rate = 100 - self.percent, 100 + self.percent
                parts = 2 * high * rate[0] // rate[1]
                parts += 2 + parts // 8
                # In at least so many parts this set and a linked one of the band agree.
                yield band, parts, parts - (n + min(high, largest)) * rate[0] // rate[1]


def list_keys(h: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The keys, and by band how many of them a link can do without: -1 where some link may agree only in empty parts, and
    then the keys of the first shingles by hash, of which a link has one in common, are among them too."""
    out, spare = [], []
    for band, parts, agree in bands.of(len(h)):
        part = ((h >> _U(32)) * _U(parts)) >> _U(32)  # never decreases, as h is sorted
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        room = agree - 1 - (parts - len(start))
        spare.append((band, max(-1, room)))
        content = np.add.reduceat(_mix(h + _U(1)), start)
        out.append(_in_band(_mix(content ^ _mix(part[start] + _U(1))), band))
        if room < 0:
            keep = len(h) - -(-bands.percent * len(h) // 100) + 1
            out.append(_in_band(_mix(h[:keep] ^ _U(0x5851F42D4C957F2D)), band))
    return (np.concatenate(out) if out else np.zeros(0, _U)), spare


def _in_band(keys: np.ndarray, band: int) -> np.ndarray:
    return (keys & ~_U((1 << BAND_BITS) - 1)) | _U(band)


def subset_keys(h: np.ndarray, percent: int) -> np.ndarray:
    out = []
    for size in subset_sizes(len(h), percent):
        chosen = np.array(list(combinations(range(len(h)), size)))
        out.append(_mix(_mix(h + _U(2))[chosen].sum(1, dtype=_U) ^ _U(size)))
    return _in_band(np.concatenate(out), (1 << BAND_BITS) - 1) if out else np.zeros(0, _U)


def sketch(h: np.ndarray) -> bytes:
    """For each place that shingles fall on by hash, whether they are odd in number; places are a power of two and more than
    the shingles. Sets differ in at least as many shingles as their sketches do in places."""
    places = 1 << max(3, len(h).bit_length())
    odd = np.bincount((h & _U(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(n: int, a: bytes, m: int, b: bytes, percent: int) -> bool:
    """False only for sketches of sets, of n and m shingles, that do not link."""
    x, y = (np.frombuffer(one, np.uint8) for one in ((a, b) if len(a) <= len(b) else (b, a)))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= n + m - 2 * shared(n, m, percent)


#: Sets that a task remembers to find exact copies by itself.
REMEMBERED = 200_000


def keyed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, rep, subsets, lists, spare, sketch): the set's size and keys, band by band how many of the list keys it can do
    without, and its sketch. Of equal sets that one task sees, the first carries the
    keys and is the others' rep."""

    def make():
        bands, seen = Bands(percent), {}

        def step(batch):
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                sizes, reps, subsets, lists, spare, sketches = [], [], [], [], [], []
                for doc_id, text in zip(ids, part.column("text").to_pylist(), strict=True):
                    h = hashed(tokens(text), k)
                    sizes.append(len(h))
                    rep = doc_id
                    if len(h) and doc_id is not None:
                        digest = xxhash.xxh128_digest(h)
                        rep = seen.get(digest, doc_id)
                        if rep == doc_id and len(seen) < REMEMBERED:
                            seen[digest] = doc_id
                    reps.append(rep)
                    own = len(h) > 0 and doc_id is not None and rep == doc_id
                    subsets.append(subset_keys(h, percent).view(np.int64) if own and len(h) <= TOP else None)
                    keys, room = list_keys(h, bands) if own else (None, None)
                    lists.append(keys.view(np.int64) if own else None)
                    spare.append(room)
                    sketches.append(sketch(h) if own else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(reps, pa.int64()), pa.array(subsets, pa.list_(pa.int64())), pa.array(lists, pa.list_(pa.int64())), pa.array(spare, pa.map_(pa.int32(), pa.int32())), pa.array(sketches, pa.binary())],
                    ["doc_id", "n", "rep", "subsets", "lists", "spare", "sketch"],
                )

        return step

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n long, rep long, subsets array<long>, lists array<long>, spare map<int, int>, sketch binary")


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size that lists subsets, at least cost over the sets of each size up to TOP. Sets of fewer than 6
    shingles always do: they link with equal sets only, or nearly."""
    bands = Bands(percent)
    by_subsets = {n: sum(comb(n, c) for c in subset_sizes(n, percent)) for n in range(1, TOP + 1)}
    by_lists = {n: LIST_COST * sum(parts for _, parts, _ in bands.of(n)) for n in range(1, TOP + 1)}

    def cost(x: int) -> int:
        both = -(-percent * (x + 1) // 100)
        return sum(c * ((n <= x) * by_subsets[n] + (n > x or n >= both) * by_lists[n]) for n, c in sizes.items())

    return min(range(5, TOP + 1), key=lambda x: (cost(x), x))


def close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that their sketches (doc_id, n, sketch) allow to link. A sketch is about a fiftieth of its text."""
    ship(pairs.sparkSession)
    small_batches(pairs.sparkSession)
    met = pairs.join(sketches.toDF("a", "na", "sa"), "a").join(sketches.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "sa", "nb", "sb")

    def run(batches):
        for batch in batches:
            ok = [may_link(*row, percent) for row in zip(*[batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return met.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts link, compared by words. Of `texts`, only those of the pairs are moved, and the few
    others that a filter lets pass."""
    ship(pairs.sparkSession)
    small_batches(pairs.sparkSession)

    def ends(name: str) -> DataFrame:
        own = texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"t{name}"))
        return bloom.flagged(own, bloom.build(pairs, name), name).filter("_maybe").drop("_maybe")

    met = pairs.join(ends("b"), "b").join(ends("a"), "a")

    def run(batches):
        last, one = None, set()
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                part = batch.slice(low, 256)
                low += 256
                ok = []
                for a, ta, tb in zip(*[part.column(c).to_pylist() for c in ("a", "ta", "tb")], strict=True):
                    if (a, ta) != last:  # rows of one leader follow each other
                        last, one = (a, ta), shingles(tokens(ta), k)
                    ok.append(linked(one, shingles(tokens(tb), k), percent))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return met.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _band(sig: str = "sig") -> Column:
    return F.col(sig).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")


def _members(postings: DataFrame, lists: DataFrame) -> DataFrame:
    """(sig, id, c) of the lists of three and more; of two, the smallest and the largest id are all. Only their postings are moved,
    and the few others that the filter lets pass."""
    more = lists.filter("c > 2").select("sig", "c")
    slot = F.shiftright("sig", BAND_BITS).bitwiseAND(F.lit(SLOTS - 1)).alias("_slot")
    one, two, three = (F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("sig", at).bitwiseAND(F.lit(63)).cast("int")) for at in (28, 34, 40))
    bits = one.bitwiseOR(two).bitwiseOR(three)
    held = more.groupBy(slot).agg(F.bit_or(bits).alias("_held"))
    maybe = postings.select("sig", "id", slot).join(F.broadcast(held), "_slot").filter(F.col("_held").bitwiseAND(bits) == bits)
    return maybe.join(more, "sig").select("sig", "id", "c")


def _limits(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(id, band, room, long): how many lists of the band a set can do without, and how many of its lists are long. Linked sets share
    more than either can do without; a set with more long lists than that is stuck: all that it shares may be long."""
    room = sets.select(F.col("doc_id").alias("id"), F.explode("spare").alias("band", "room")).groupBy("id", "band").agg(F.min("room").alias("room"))
    long = members.filter(F.col("c") > HOT).groupBy("id", _band().alias("band")).agg(F.count("*").alias("long"))
    return room.join(long, ["id", "band"], "full").select("id", "band", F.coalesce("room", F.lit(-1)).alias("room"), F.coalesce("long", F.lit(0)).alias("long"))


def _likely(lists: DataFrame, members: DataFrame, limits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of sizes that may link, which in some band share as many lists that are not long as a link asks of both.
    A list gives pairs of at most HOT members, and a pair has to share several, so pairs grow with the sets."""
    two = lists.filter("c = 2 AND lo < hi").select("sig", F.col("lo").alias("a"), F.col("hi").alias("b"))
    few = members.filter(F.col("c") <= HOT).groupBy("sig").agg(F.collect_set("id").alias("ids"))
    more = few.select("sig", F.explode("ids").alias("a"), "ids").select("sig", "a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
    pairs = two.union(more).groupBy("a", "b", _band().alias("band")).agg(F.count("*").alias("common"))
    need = limits.select("id", "band", (F.col("room") + 1 - F.col("long")).alias("need"))
    for end in ("a", "b"):
        pairs = pairs.join(need.withColumnsRenamed({"id": end, "need": f"_{end}"}), [end, "band"], "left")
    # Subsets have no band of their own: one in common is enough.
    pairs = pairs.filter(F.col("common") >= F.greatest(F.lit(1), F.coalesce("_a", F.lit(1)), F.coalesce("_b", F.lit(1)))).select("a", "b").distinct()
    spans = sets.groupBy(F.col("doc_id").alias("id")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    for end in ("a", "b"):
        pairs = pairs.join(spans.toDF(end, f"least_{end}", f"most_{end}"), end)
    near = (100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a"))
    return pairs.filter(near).select("a", "b")


def _rare_first(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, id, lead, n): lists of single shingles, of each set's rarest ones among these texts, as many as a link needs to have
    one in common. A passage that many share is never among them, unless a set consists of little else."""

    def make():
        def step(batch):
            for part in slices(batch):
                sets = [hashed(tokens(t), k) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(h) for h in sets], pa.int64()), pa.array([xxhash.xxh64_intdigest(h) >> 1 for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))],
                    ["id", "n", "key", "all"],
                )

        return step

    flat = map_batches(texts.select("doc_id", "text"), make, "id long, n long, key long, all array<long>").distinct()
    flat = flat.select("id", "n", "key", F.explode("all").alias("g"))
    ranked = flat.join(flat.groupBy("g").agg(F.count("*").alias("f")).filter("f > 1"), "g")
    # Shingles of one text only are the rarest and in no list: they take up places without being moved.
    held = ranked.groupBy("id", "n", "key").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("own"))
    alone = F.col("n") - F.size("own")
    places = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - alone
    chosen = held.select("id", "n", F.explode(F.slice("own", 1, F.greatest(places, F.lit(0)).cast("int"))).alias("e"))
    mask = F.lit((1 << BAND_BITS) - 1)
    chosen = materialise(chosen.select("id", "n", F.col("e.g").bitwiseAND(F.bitwise_not(mask).cast("long")).bitwiseOR(F.lit((1 << BAND_BITS) - 2)).alias("sig")), "rare")
    leads = chosen.groupBy("sig").agg(F.min("id").alias("lead"), F.max("id").alias("hi")).filter("lead < hi").drop("hi")
    return chosen.join(leads, "sig").select("sig", "id", "n", "lead")


def _near(n: Column, other: Column, percent: int) -> Column:
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


def _cross_short(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one list, of different components and sizes that may link."""
    other = rows.select("sig", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    apart = (F.col("id") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & _near(F.col("n"), F.col("n_b"), percent)
    return rows.join(other, "sig").filter(apart).select(F.col("id").alias("a"), "b").distinct()


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of a with each of b, by products of parts of their incidence matrices."""
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)))
    out = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, len(both), 4096):
        part = both[low : low + 4096]
        sides = []
        for sets in (a, b):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                at = np.searchsorted(part, own := s[(s >= part[0]) & (s <= part[-1])])
                at = at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == own)]
                m[i, at] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def _cross_long(rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join components within long lists. Members outside a list's largest component are compared with all its
    members, block by block; a pair of blocks gives one edge for each member that links, to the smallest it reaches there."""
    counts = rows.groupBy("sig", "comp").agg(F.count("*").alias("c"))
    tops = counts.groupBy("sig").agg(F.max(F.struct("c", "comp")).alias("t"), F.sum("c").alias("all"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    tops = tops.select("sig", F.col("t.comp").alias("top"), blocks(F.col("all") - F.col("t.c")).alias("asking"), blocks(F.col("all")).alias("asked"))
    placed = rows.join(tops, "sig").withColumn("h", F.xxhash64("id"))
    asking = placed.filter(F.col("comp") != F.col("top")).select(
        "sig", "id", F.pmod("h", "asking").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("j"), F.lit(0).alias("side")
    )
    asked = placed.select(
        "sig", "id", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("i"), F.pmod("h", "asked").cast("int").alias("j"), F.lit(1).alias("side")
    )
    members = rows.select(F.col("id").alias("doc_id")).distinct()

    def make():
        def step(batch):
            for part in slices(batch):
                sets = [hashed(tokens(t), k).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["id", "s"])

        return step

    # Few texts are in long lists: a filter passes them before they are moved.
    few = bloom.flagged(texts.select("doc_id", "text"), bloom.build(members, "doc_id"), "doc_id").filter("_maybe").drop("_maybe")
    sets = materialise(map_batches(few.join(members, "doc_id", "left_semi").select("doc_id", "text"), make, "id long, s binary"), "members")

    def meet(pdf):
        import pandas as pd

        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        ids = np.unique(pdf["id"].to_numpy(np.int64))
        if not len(a) or not len(b):
            return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
        x, y = ([np.frombuffer(s, _U) for s in side["s"]] for side in (a, b))
        size_x, size_y = np.array([len(s) for s in x])[:, None], np.array([len(s) for s in y])[None, :]
        both = _overlaps(x, y)
        i, j = np.nonzero((both > 0) & (100 * both >= percent * (size_x + size_y - both)))
        at_x, at_y = (np.searchsorted(ids, side["id"].to_numpy(np.int64)) for side in (a, b))
        root = ids[reach(len(ids), at_x[i], at_y[j])]
        return pd.DataFrame({"a": root[root != ids], "b": ids[root != ids]})

    met = asking.union(asked).join(sets, "id").groupBy("sig", "i", "j").applyInPandas(meet, "a long, b long")
    return met.distinct()


def similar(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text). Sets are the distinct k-word shingles, A-Z in
    lower case; two link when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable.
    A null or empty text has no shingles and links with nothing. Rows that share a doc_id count as one document in
    components. A null doc_id links with nothing and has a null component. Other columns are ignored."""
    sets = materialise(keyed(docs, k, percent), "sets")
    own = sets.filter(F.col("rep") == F.col("doc_id"))
    counts = own.filter(F.col("n").between(1, TOP)).groupBy("n").count().collect()
    x = boundary({r["n"]: r["count"] for r in counts}, percent)
    none = F.array().cast("array<long>")
    near = 100 * F.col("n") >= percent * (x + 1)
    keys: Column = F.when(F.col("n") <= x, F.concat(F.coalesce("subsets", none), F.when(near, F.col("lists")).otherwise(none))).otherwise(F.col("lists"))
    postings = own.select(F.col("doc_id").alias("id"), F.explode(keys).alias("sig"))
    lists = postings.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).filter("c > 1")
    lists = materialise(lists, "lists")
    members = materialise(_members(postings, lists), "members")
    limits = materialise(_limits(own, members), "limits")
    stuck = materialise(limits.filter("long > room").select("id").distinct(), "stuck")
    # Long lists often hold a passage that unrelated texts share; what only they could tell, rare shingles tell better.
    likely = materialise(_likely(lists, members, limits, own, percent), "likely")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(stuck).distinct()
    sketches = bloom.flagged(own.select("doc_id", "n", "sketch"), bloom.build(ends(likely), "doc_id"), "doc_id").filter("_maybe")
    sketches = materialise(sketches.drop("_maybe").distinct(), "sketches")
    likely = materialise(close(likely, sketches, percent), "likely")
    wanted = ends(likely)
    # Only texts of members are moved, and the few others that the filter lets pass.
    texts = bloom.flagged(docs.select("doc_id", "text"), bloom.build(wanted, "doc_id"), "doc_id").filter("_maybe").drop("_maybe")
    # Rows that share a doc_id and a text are one, else each of them would be compared with each of a partner's.
    again = materialise(sets.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "again")
    if not again.isEmpty():
        texts = texts.join(again, "doc_id", "left_anti").union(texts.join(again, "doc_id", "left_semi").distinct())
    texts = materialise(texts, "texts")
    rare = materialise(_rare_first(texts.join(stuck.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), k, percent), "rare")
    copies = sets.filter("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    leads = likely.union(close(rare.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), sketches, percent))
    pairs = materialise(leads.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = materialise(verified(pairs, texts, k, percent), "links")
    edges = copies.union(links)
    found = materialise(components(edges), "components")
    # What the leaders left apart: likely pairs and lists whose members are in several components.
    labels = rare.join(found, "id", "left").select("sig", "id", "n", F.coalesce("component", "id").alias("comp"))
    live = labels.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"))
    rows = materialise(labels.join(live.filter("lo < hi").select("sig", "members"), "sig"), "live")
    apart = likely
    for end in ("a", "b"):
        apart = apart.join(found.toDF(end, f"_{end}"), end, "left")
    apart = apart.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    asked = apart.union(_cross_short(rows.filter(F.col("members") <= SHORT), percent)).distinct()
    asked = materialise(close(asked.join(pairs, ["a", "b"], "left_anti"), sketches, percent), "pairs")
    more = verified(asked, texts, k, percent).union(_cross_long(rows.filter(F.col("members") > SHORT), texts, k, percent))
    more = materialise(more, "links")
    if not more.isEmpty():
        found = materialise(components(edges.union(more)), "components")
    known = found.withColumnRenamed("id", "doc_id")
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(known, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its group, with all their columns, whatever their names and types; of
    rows that share a doc_id, the least by all columns. Rows without a doc_id stay. Only rows that may go are moved."""
    columns = docs.columns
    docs = plain_names(docs)
    found = similar(docs, k, percent)
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.col("doc_id") == F.col("component_id")).alias("first"))
    ids = materialise(ids.filter("doc_id is not null and (n > 1 or not first)").select("doc_id", "first"), "groups")
    flagged = bloom.flagged(docs, bloom.build(ids, "doc_id"), "doc_id")
    maybe = flagged.filter("_maybe").drop("_maybe").join(ids, "doc_id", "left").filter(F.coalesce("first", F.lit(True)))
    # Maps have no order, nor what holds one; their JSON does.
    key = [F.to_json(F.struct(f.name)).alias(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields]
    maybe = maybe.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(*key)).alias("row")).select("row.*")
    return named(flagged.filter(~F.col("_maybe")).select(*docs.columns).unionByName(maybe), columns)
