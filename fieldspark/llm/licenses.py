"""License scans: templates with optional and replaceable regions, compiled into token automata.

In a template, [[ ... ]] is optional and {{n}} stands for up to n words of any kind; all other words are mandatory and must
stand in the text exactly, in order and with nothing between. Case and punctuation don't matter, as words are compared."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldspark.llm.base import LOWER, map_batches
from fieldspark.llm.bpe import slices

#: Fixed by the contract: phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Labels and templates of public licenses and of the notices that name them.
TEMPLATES = {
    "mit-notice": "[[this {{4}} is]] [[released]] [[licensed]] [[distributed]] under [[the terms of]] the mit license",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to
        use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        [[including the next paragraph]] shall be included in all copies or substantial portions of the software""",
    "apache-2.0": "licensed under the apache license version 2 0 [[the license]]",
    "gpl-2.0": "licensed under the [[terms of the]] gnu general public license [[gpl]] version 2 [[or [[at your option]] any later version]]",
    "gpl-3.0": "licensed under the [[terms of the]] gnu general public license [[gpl]] version 3 [[or [[at your option]] any later version]]",
    "cc-by-4.0": "licensed under [[a]] [[creative commons]] cc by 4 0",
    "cc-by-nc-4.0": "licensed under [[a]] [[creative commons]] cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under [[a]] [[creative commons]] cc by sa 4 0",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and
        the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of
        conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        [[[[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission]]""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
}
_KEEP = set(b"0123456789" + LOWER.encode()) | set(range(128, 256))
#: A-Z in lower case, and a space for every other ASCII character that is no word's.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Automaton:
    """States are the template's words; `follow` says which states may come next, through optional regions."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.words: list[bytes | None] = []  # None takes any word
        self.mandatory: list[bool] = []
        self.skips: list[tuple[int, int]] = []  # an optional region from state to state
        depth: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
            if part == "[[":
                depth.append(len(self.words))
            elif part == "]]":
                self.skips.append((depth.pop(), len(self.words)))
            elif part.startswith("{{"):
                end = len(self.words) + int(part[2:-2])
                while len(self.words) < end:
                    self.skips.append((len(self.words), end))
                    self.words.append(None)
                    self.mandatory.append(False)
            else:
                self.words.append(part.encode())
                self.mandatory.append(not depth)
        self.end = len(self.words)
        self.total = sum(self.mandatory)
        # Mandatory words before each state.
        self.passed = [sum(self.mandatory[:i]) for i in range(self.end + 1)]
        self.follow = [self._closure(i) for i in range(self.end + 1)]
        self.first = {self.words[i] for i in self.follow[0] if i < self.end}

    def _closure(self, state: int) -> frozenset[int]:
        out, todo = {state}, [state]
        while todo:
            at = todo.pop()
            for low, high in self.skips:
                if low == at and high not in out:
                    out.add(high)
                    todo.append(high)
        return frozenset(out)

    def run(self, words: list[bytes], start: int) -> tuple[int | None, float]:
        """Where the longest acceptance that begins at `start` ends, and the share of mandatory words reached."""
        states, at, ended, reached = self.follow[0], start, None, 0
        while True:
            if self.end in states:
                ended = at
            reached = max(reached, *(self.passed[s] for s in states)) if states else reached
            if at == len(words) or not states:
                return ended, 1.0 if ended is not None else reached / self.total
            word, following = words[at], set()
            for s in states:
                if s < self.end and (self.words[s] is None or self.words[s] == word):
                    following |= self.follow[s + 1]
            states, at = following, at + 1


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases=PHRASES):
        self.automata = [Automaton(label, t) for label, t in templates.items()]
        self.phrases = [(p.encode().split(), label) for p, label in phrases]
        self.needed = {p[-1] for p, _ in self.phrases}

    def base(self, words: list[bytes]) -> list[tuple[str, int]]:
        """(label, start) of every place of a phrase."""
        out = []
        for phrase, label in self.phrases:
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(phrase)] == phrase:
                    out.append((label, at))
        return out

    def templates(self, words: list[bytes], present: set[bytes]) -> tuple[list[tuple[str, int, int]], float]:
        """(label, start, end) of accepted stretches, and the greatest share of a template's mandatory words reached. Of
        stretches of one label, one that begins inside another is left out."""
        out, best = [], 0.0
        for a in self.automata:
            if a.first.isdisjoint(present):
                continue
            inside = 0
            for at, word in enumerate(words):
                if at >= inside and word in a.first:
                    ended, share = a.run(words, at)
                    best = max(best, share)
                    if ended is not None:
                        out.append((a.label, at, ended))
                        inside = ended
        return sorted(out, key=lambda m: (m[1], m[0])), best


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_words; n_base, first_word and last_word of the base phrases' places (null
    without any); base_labels and labels (distinct, sorted, comma-joined; the latter with accepted templates'); score, the
    greatest share of a template's mandatory words in place, 1 when one is accepted; matches (label, start, end in words).
    A null or empty text has no words, empty labels and score 0. Repeated rows stay; other columns are ignored."""

    def make():
        scanner = Scanner(templates)

        def step(batch):
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = tokens(text)
                    present = set(words)
                    base = scanner.base(words) if present & scanner.needed else []
                    matches, score = scanner.templates(words, present)
                    places = [p for _, p in base]
                    own = sorted({label for label, _ in base})
                    rows.append(
                        {
                            "doc_id": doc_id, "n_words": len(words), "n_base": len(base),
                            "first_word": min(places, default=None), "last_word": max(places, default=None),
                            "base_labels": ",".join(own), "labels": ",".join(sorted({*own, *(m[0] for m in matches)})), "score": score,
                            "matches": [{"label": m[0], "start": m[1], "end": m[2]} for m in matches],
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return step

    match = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": pa.list_(match)}
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", *kinds]
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])
    return map_batches(
        docs.select("doc_id", "text"), make,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "matches array<struct<label: string, start: long, end: long>>",
    )
