"""Quality rules: each rule votes for a document (1), against it (-1) or abstains (0); expectation-maximisation
estimates how often each rule is right, and the posterior probability of quality decides.

All of it is DataFrame functions. The corpus enters the estimation only as counts of vote patterns, of which there
are at most 3 ** len(RULES)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.base import SPACE, ratio, words
from fieldspark.session import materialise

#: Words of a window that may not come twice.
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def repeated_words(ws: str, ordered: str) -> Column:
    """Words inside WINDOW-word windows found twice or more. `ordered` holds (hash, index) sorted, or null where all
    hashes differ; windows whose hashes agree are compared word by word."""

    def beside(e: Column, k: Column, of: Column, field: str) -> Column:
        same = lambda other: F.coalesce(F.get(of, other)[field] == e[field], F.lit(False))
        return same(k - 1) | same(k + 1)

    s = F.col(ordered)
    near = F.filter(s, lambda e, k: beside(e, k, s, "h"))
    texts = F.transform(near, lambda e: F.struct(F.array_join(F.slice(F.col(ws), e["i"] + 1, WINDOW), " ").alias("w"), e["i"].alias("i")))
    # One-element arrays bind a value, so that a lambda over it doesn't compute it for each element again.
    exact = F.transform(F.array(F.array_sort(texts)), lambda t: F.filter(t, lambda e, k: beside(e, k, t, "w")))[0]
    at = F.array_sort(F.transform(exact, lambda e: e["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        at, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"]
    )
    return F.when(s.isNull(), 0).otherwise(covered).cast("long")


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` and the measures of each whole text; a null or empty text has no words and all measures 0."""
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    d = d.select("*", words(F.col("_t")).alias("_ws"), lines.alias("_lines"))
    d = d.select("*", F.size("_ws").alias("_n"), F.transform("_ws", lambda w: F.xxhash64(w)).alias("_h1"))
    # The hash of a window from those of its halves: of two words, of four, of eight.
    step = 1
    while step < WINDOW:
        now, half = f"_h{2 * step}", f"_h{step}"
        d = d.select("*", F.zip_with(half, F.slice(half, step + 1, F.greatest("_n", F.lit(1))), lambda a, b: F.xxhash64(a, b)).alias(now))
        step *= 2
    d = d.select("*", F.slice(f"_h{WINDOW}", 1, F.greatest(F.col("_n") - (WINDOW - 1), F.lit(0))).alias("_h"))
    d = d.select("*", (F.size(F.array_distinct("_h")) < F.size("_h")).alias("_again"))
    d = d.select("*", F.when(F.col("_again"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    count = lambda chars: F.regexp_count("_t", F.lit(f"[{chars}]")).cast("long")
    return d.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        (F.length("_t") - count(SPACE)).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("_ws", "_s").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_h1")).cast("long").alias("n_distinct"),
        count("A-Z").alias("n_upper"),
        count("0-9!?").alias("n_marks"),
        F.regexp_count("_t", F.lit(r"[a-z][.?](\s|$)")).cast("long").alias("n_sentences"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes against a document where `bad` holds, else for it where `good` does, else abstains."""

    name: str
    bad: Column
    good: Column | None = None

    def vote(self) -> Column:
        against = F.when(self.bad, -1)
        return (against if self.good is None else against.when(self.good, 1)).otherwise(0)


def rules() -> list[Rule]:
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    symbols, capitals, marks = ratio(F.col("n_symbols"), n), ratio(F.col("n_upper"), chars), ratio(F.col("n_marks"), chars)
    repeats, again, ends = ratio(F.col("n_repeat_words"), n), ratio(F.col("n_dup_lines"), lines), ratio(F.col("n_sentences"), n)
    return [
        Rule("symbols", symbols >= 0.3),
        Rule("capitals", capitals >= 0.4),
        Rule("marks", marks >= 0.15),
        Rule("plain", (symbols >= 0.15) | (capitals >= 0.3), (symbols <= 0.05) & (capitals <= 0.15) & (marks <= 0.08)),
        Rule("repeats", repeats >= 0.2),
        Rule("lines", again >= 0.5),
        # The longer a text, the fewer of its words are new: compared with a power of the length.
        Rule("vocabulary", F.col("n_distinct") < 0.5 * F.pow(n.cast("double"), F.lit(0.6))),
        Rule("lengths", (chars < 2 * n) | (chars > 20 * n)),
        Rule("sentences", F.lit(False), (ends >= 0.01) & (ends <= 0.4) & (symbols <= 0.1)),
    ]


def log_odds(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass(frozen=True)
class Accuracies:
    """The share of good documents, and of each rule how often its votes for and against are right."""

    prior: float
    votes_for: tuple[float, ...]
    votes_against: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """By Bayes: a vote moves the log odds from the prior's to its own accuracy's, never the other way."""
        base = log_odds(self.prior)
        total = F.lit(base)
        for v, up, down in zip(votes, self.votes_for, self.votes_against, strict=True):
            total = total + F.when(v > 0, max(0.0, log_odds(up) - base)).when(v < 0, min(0.0, -log_odds(down) - base)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def estimate(voted: DataFrame, names: list[str], prior: float = 0.85, rounds: int = 20, tolerance: float = 1e-4) -> Accuracies:
    """Expectation-maximisation over the counts of vote patterns, until no estimate moves by `tolerance`. Accuracies
    start at 0.8 and stay from 0.55 to 0.995. Without rows the start values are returned."""
    patterns = materialise(voted.groupBy(*names).agg(F.count("*").alias("c")).coalesce(1), "patterns")
    votes = [F.col(name) for name in names]
    now = Accuracies(prior, (0.8,) * len(names), (0.8,) * len(names))
    for _ in range(rounds):
        good, bad = F.col("c") * F.col("p"), F.col("c") * (1 - F.col("p"))
        sums = [F.sum("c"), F.sum(good)]
        for v in votes:
            sums += [F.sum(F.when(v > 0, F.col("c"))), F.sum(F.when(v > 0, good)), F.sum(F.when(v < 0, F.col("c"))), F.sum(F.when(v < 0, bad))]
        scored = patterns.select("*", now.posterior(votes).alias("p"))
        row = [float(x or 0) for x in scored.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()]
        if not row[0]:
            break
        # Ten votes beforehand, eight of them right: a rule that never votes stays where it is.
        share = lambda i: min(0.995, max(0.55, (row[i + 1] + 8) / (row[i] + 10)))  # noqa: E731, B023
        new = Accuracies(
            min(0.99, max(0.5, row[1] / row[0])),
            tuple(share(2 + 4 * k) for k in range(len(names))),
            tuple(share(4 + 4 * k) for k in range(len(names))),
        )
        pairs = zip((now.prior, *now.votes_for, *now.votes_against), (new.prior, *new.votes_for, *new.votes_against), strict=True)
        moved, now = max(abs(x - y) for x, y in pairs), new
        if moved < tolerance:
            break
    return now


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of `docs` (doc_id, text): measures, each rule's vote, quality (the posterior), base_failed and
    kept. Repeated rows and ids give repeated rows; other columns are ignored. Null and empty texts fail."""
    listed = rules()
    names = [f"vote_{r.name}" for r in listed]
    m = measures(docs, "doc_id")
    m = m.select("*", base_failed().alias("base_failed")).select("*", *[r.vote().alias(n) for r, n in zip(listed, names, strict=True)])
    # The texts are read once; what follows needs a few numbers of each.
    m = materialise(m.drop("n_upper", "n_marks", "n_distinct", "n_lines", "n_sentences"), "measures")
    known = estimate(m.filter(~F.col("base_failed")), names)
    quality = known.posterior([F.col(n) for n in names])
    return m.select("*", quality.alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that quality_rules keeps, with all their columns: one vote per row, no join."""
    listed = rules()
    names = [f"vote_{r.name}" for r in listed]
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    m = measures(whole, "row").select("row", base_failed().alias("failed"), *[r.vote().alias(n) for r, n in zip(listed, names, strict=True)])
    # Filtered only once written: pushed below the measures, a filter would spell each of them out again and again.
    m = materialise(m, "votes").filter("not failed")
    return m.filter(estimate(m, names).posterior([F.col(n) for n in names]) >= threshold).select("row.*")
