"""Quality rules as a short-circuit cascade: cheap rules that reject much come first.

Each rule's cost and selectivity are measured on a bounded sample; rules are then ordered by
rejections per cost and become one CASE, in which a later rule is computed only for rows that
all earlier rules passed. A row is kept when no rule rejects it, so the order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityflux.llm.common import SPACE, let, words
from cityflux.plans.scratch import materialize

SYMBOLS = "#*$%&|<>"
# Rows looked at to order the rules.
SAMPLE_ROWS = 1_000

Features = dict[str, Callable[[], Column]]


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the features by name; those it calls are what it costs."""

    name: str
    rejects: Callable[[Features], Column]


# Words are counted in long: sizes times hundred must not overflow.
RULES = [
    Rule("few_words", lambda f: f["n_words"]() < 50),
    Rule("repeats", lambda f: f["n_repeat_words"]() * 100 > f["n_words"]() * 50),
    Rule("symbols", lambda f: f["n_symbols"]() * 10 > f["n_words"]() * 6),
    Rule("same_lines", lambda f: f["n_dup_lines"]() * 100 > f["n_lines"]() * 40),
    Rule("word_length", lambda f: ~f["word_chars"]().between(f["n_words"]() * 2, f["n_words"]() * 15)),
    Rule("letters", lambda f: f["n_letter_words"]() * 100 < f["n_words"]() * 30),
]


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the text.

    Windows are compared by 64-bit hashes, sorted with their places: no step looks at all pairs.
    """

    def count(s: Column) -> Column:
        def again(x: Column, j: Column) -> Column:
            return (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])

        places = F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(again(x, j), F.lit(False))), lambda x: x["i"]))
        fresh = let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))))
        return F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), count))


def features(text: Column, w: Column) -> Features:
    """Features of a text and its words ``w``; each is an expression built on call."""
    full = F.coalesce(text, F.lit(""))

    def lines() -> Column:
        return F.filter(F.split(full, "\n"), lambda x: F.length(F.regexp_replace(x, f"{SPACE}+", "")) > 0)

    return {
        "n_words": lambda: F.size(w).cast("long"),
        "word_chars": lambda: F.length(F.regexp_replace(full, f"{SPACE}+", "")).cast("long"),
        "n_symbols": lambda: F.length(F.regexp_replace(full, "[^" + SYMBOLS + "]+", "")).cast("long"),
        "n_lines": lambda: F.size(lines()).cast("long"),
        "n_dup_lines": lambda: let(lines(), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_repeat_words": lambda: _repeat_words(w),
        "n_letter_words": lambda: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long"),
    }


def cascade(rules: list[Rule], f: Features) -> Column:
    """Whether a row is kept; the first rule that rejects it ends its work."""
    verdict = F.when(rules[0].rejects(f), False)
    for rule in rules[1:]:
        verdict = verdict.when(rule.rejects(f), False)
    return verdict.otherwise(True)


def _alone(rule: Rule, text: Column) -> Column:
    return let(words(text), lambda w: rule.rejects(features(text, w)))


def ordered_rules(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """Rules by rejections per second on at most ``sample_rows`` documents; ties keep the given order.

    Every rule is timed alone on the same written sample, less the time of a job that only cuts words.
    """
    rows = docs.count()
    share = min(1.0, 2 * sample_rows / max(rows, 1))
    sample = materialize(docs.select("text").sample(share, seed).limit(sample_rows), "quality")
    text = F.col("text")

    def timed(column: Column) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(2):
            start = time.perf_counter()
            hits = sample.agg(F.sum(column.cast("int"))).first()[0] or 0
            best = min(best, time.perf_counter() - start)
        return best, hits

    floor, _ = timed(let(words(text), lambda w: F.size(w) >= 0))
    gain = {}
    for rule in rules:
        cost, hits = timed(_alone(rule, text))
        gain[rule.name] = hits / max(cost - floor, 1e-3)
    return sorted(rules, key=lambda r: -gain[r.name])


def keep_quality(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their columns as they are.

    A null or empty text has no words and is rejected. Repeated rows are judged alike. An empty table
    stays empty. Only ``text`` is read to judge; other columns, nulls in them included, pass through.
    """
    order = ordered_rules(docs, rules, sample_rows)
    text = F.col("text")
    return docs.filter(let(words(text), lambda w: cascade(order, features(text, w))))


def judge(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: its counts, the base verdict and the cascade's.

    Nulls, repeats and empty tables as in ``keep_quality``; other columns than doc_id and text are left out.
    """
    order = ordered_rules(docs, rules, sample_rows)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def counted_of(w: Column) -> Column:
        f = features(F.col("text"), w)
        return F.struct(*[f[c]().alias(c) for c in [*counts, "n_lines", "n_letter_words"]])

    counted = docs.select("doc_id", let(words(F.col("text")), counted_of).alias("_f")).select("doc_id", "_f.*")
    ready = {c: (lambda c=c: F.col(c)) for c in counted.columns if c != "doc_id"}
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    judged = counted.select("*", base.alias("base_failed"), cascade(order, ready).alias("_kept"))
    return judged.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & F.col("_kept")).alias("kept"))
