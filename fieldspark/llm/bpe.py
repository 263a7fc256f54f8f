"""Byte pair encoding and decoding.

A word's symbols form a doubly linked list, and a priority queue holds the ranks of adjacent pairs. The best pair is
merged in place and its new neighbours are queued; entries whose pair is gone are skipped. Decoding concatenates
vocabulary strings, with a space between tokens, as a vocabulary without a decoder asks.

White space only separates, so each run of other characters is encoded by itself and remembered by the worker."""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldspark.llm.base import map_batches

#: Fixed by the vocabulary file: how a lower-cased run is split into words, and the mark of a word's last symbol.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END = "</w>"
#: str.split() takes these for white space, the vocabulary's pattern does not.
NOT_BLANK = re.compile("[\x1c-\x1f]")
BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def runs(text: str) -> list[str]:
    """The runs between white space."""
    return [x for x in BLANK.split(text) if x] if NOT_BLANK.search(text) else text.split()


class Memo(dict):
    """Values by key, made when first asked for; at most `limit` short keys are kept, the rest are made each time."""

    def __init__(self, make: Callable, limit: int = 300_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit and len(key) <= self.longest:
            self[key] = value
        return value


class Codec:
    """Encodes by its own merges, or with `library` by the model of the tokenizers library, which gives the same ids."""

    def __init__(self, path: str, library: bool = False, limit: int = 250_000):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.path = path
        self.special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        self.letters = byte_letters()
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.normal, self.splitter, self.model = whole.normalizer, whole.pre_tokenizer, whole.model
        self.word = self._library_word if library else self._word
        self.words = Memo(self.word, limit)
        self.ids = Memo(self.encode_run, limit)
        self.both = Memo(self._both, limit)

    # The tables are read when own merges or decoding first ask for them: with the library's model, encoding never does.
    @cached_property
    def merges(self) -> tuple[dict[str, int], dict[int, tuple[int, int]]]:
        """The vocabulary, and of each pair of ids its rank and what it merges into."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        base = len(vocab) + 1
        return vocab, {vocab[a] * base + vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}

    @property
    def vocab(self) -> dict[str, int]:
        return self.merges[0]

    @property
    def pairs(self) -> dict[int, tuple[int, int]]:
        return self.merges[1]

    @property
    def base(self) -> int:
        return len(self.vocab) + 1

    @cached_property
    def strings(self) -> dict[int, str]:
        return {i: s for s, i in [*self.vocab.items(), *self.special.items()]}

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first, leftmost first among equals."""
        n, get, base = len(symbols), self.pairs.get, self.base
        symbols = [*symbols]
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        queue = []
        for i in range(n - 1):
            if (found := get(symbols[i] * base + symbols[i + 1])) is not None:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, new = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = get(symbols[i] * base + symbols[j])
            if found is None or found[1] != new:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := get(new * base + symbols[k])) is not None:
                    heapq.heappush(queue, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := get(symbols[h] * base + new)) is not None:
                heapq.heappush(queue, (found[0], h, found[1]))
        return [s for s in symbols if s >= 0]

    def _word(self, letters: str) -> bytes:
        vocab = self.vocab
        ids = self.merged([*[vocab[c] for c in letters[:-1]], vocab[letters[-1] + END]])
        return struct.pack(f"<{len(ids)}I", *ids)

    def _library_word(self, letters: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def split(self, run: str) -> list[str]:
        """The words of a run, each byte as its letter."""
        if run.isascii() and run.isalpha():
            return [run.lower()]
        if max(run) < "\u0250":  # nothing to compose, and letters on which all versions of Unicode agree
            found = SPLIT.findall(run.lower())
            return found if run.isascii() and run.isprintable() else ["".join([self.letters[b] for b in w.encode()]) for w in found]
        run = self.normal.normalize_str(run.encode("utf-8", "replace").decode())
        return [w for w, _ in self.splitter.pre_tokenize_str(run)]

    def encode_run(self, run: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(run):
            return b"".join([self._piece(w, run) for w in self.split(run)])
        out = []
        for k, part in enumerate(self.cut.split(run)):
            if k % 2:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                out += [self._piece(w, run) for w in self.split(part)]
        return b"".join(out)

    def _piece(self, word: str, run: str) -> bytes:
        """The ids of a word of a run. A word of small letters is a run itself, and remembered as that only."""
        if not (word.isascii() and word.isalpha() and word.islower()) or self.cut is not None and self.cut.search(word):
            return self.words[word]
        return self.word(word) if word == run else self.ids[word]

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.ids.__getitem__, runs(text or "")))

    def decode(self, ids: bytes) -> str:
        return " ".join([self.strings[i] for (i,) in struct.iter_unpack("<I", ids)])

    def _both(self, run: str) -> tuple[bytes, str]:
        return (ids := self.encode_run(run)), self.decode(ids)

    def round_trip(self, text: str | None) -> tuple[bytes, str]:
        """Ids of a text and what they decode to, run by run: tokens of different runs are also a space apart."""
        found = [*map(self.both.__getitem__, runs(text or ""))]
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found])


_held: dict[tuple, Codec] = {}


def codec(path: str, library: bool = False, limit: int = 250_000) -> Codec:
    """One codec for each file in a worker process, kept from task to task."""
    key = path, library, limit
    if key not in _held:
        _held[key] = Codec(*key)
    return _held[key]


#: Rows of an output batch, and its bytes of text at most unless one row has more.
ROWS, BYTES = 512, 4 << 20


def slices(batch: pa.RecordBatch, text: str = "text"):
    """Parts of a batch whose texts are small together."""
    sizes = batch.column(text)
    start = held = 0
    for i in range(batch.num_rows):
        size = len(sizes[i].as_py() or "") if batch.nbytes > BYTES else 0
        if i > start and (i - start >= ROWS or held + size > BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """For each row of `docs` (doc_id, text): n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded text. A
    null or empty text, or one of white space only, has no tokens. Repeated rows give repeated rows; other columns are
    ignored. `path` is the vocabulary file, to be found at that place on every executor."""

    def make():
        own = codec(path)

        def step(batch):
            for part in slices(batch):
                pairs = [own.round_trip(t) for t in part.column("text").to_pylist()]
                ids = [p[0] for p in pairs]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([p[1] for p in pairs], pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

        return step

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids binary, decoded string")
