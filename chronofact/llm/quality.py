"""Quality rules as a learned decision list.

Statistics of every text are built-in expressions within its row, so nothing is shuffled for them. A decision list is
learned by sequential covering: labelled rows become a histogram over quantile bins of the statistics, rules are grown
condition by condition from two thirds of them by information gain, pruned on the rest, and taken off before the next
rule is sought. The list is emitted as one ordered CASE expression.

Learning reads the labelled documents only, `sample_rows` of them at most (a hash of their ids chooses where there are
more). What reaches the driver is the cut points and the cells that these rows fall into, so no more than `sample_rows`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.text import SPACES, let, named, words
from chronofact.session import stored

SYMBOLS = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are compared by 64-bit hashes; equal ones stand side
    by side after a sort, so long texts take n log n steps."""
    n = F.size(w)

    def covered(h: Column) -> Column:
        return let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: let(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]),
                        ),
                        lambda x: x["i"],
                    )
                ),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            ),
        )

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    any_twice = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)
    return F.when(n >= 4, let(windows, any_twice)).otherwise(0)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long); zeros for null."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    return docs.withColumn("_s", let(words(F.col(text), SPACES), of)).select("*", *[F.col(f"_s.{c}") for c in COUNTS]).drop("_s")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))



def features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "chars_per_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeats_per_word": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > cut, or feature <= cut
    cut: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.cut if self.above else value <= self.cut


@dataclass(frozen=True)
class Rule:
    """Documents that meet every condition are rejected."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one CASE expression: false at the first rule that holds, else true."""
    out = F
    for r in rules:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """FOIL's information gain of narrowing (bad0, good0) to (bad, good)."""
    if not bad or not bad0:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def _covers(conditions: list[tuple[int, bool, int]], bins: tuple[int, ...]) -> bool:
    return all((bins[f] > cut) == above for f, above, cut in conditions)


def cover(cells: list[tuple[tuple[int, ...], bool, int, int]], n_cuts: list[int], precision: float, most_rules: int, most_conditions: int) -> list[tuple[list[tuple[int, bool, int]], int, int]]:
    """Sequential covering over cells (bins, whether for growing, bad, good); a bin b of a feature means that b of its
    cuts lie below the value. Returns lists of (feature, above, cut number) with what they cover."""
    rules = []
    left = cells
    while len(rules) < most_rules:
        grown: list[tuple[int, bool, int]] = []
        inside = [c for c in left if c[1]]
        while len(grown) < most_conditions:
            bad0, good0 = sum(c[2] for c in inside), sum(c[3] for c in inside)
            best = (0.0, None)
            for f, n in enumerate(n_cuts):
                bad, good = [0] * (n + 1), [0] * (n + 1)
                for bins, _, x, y in inside:
                    bad[bins[f]] += x
                    good[bins[f]] += y
                below_bad = below_good = 0
                for cut in range(n):
                    below_bad += bad[cut]
                    below_good += good[cut]
                    for above, x, y in ((False, below_bad, below_good), (True, bad0 - below_bad, good0 - below_good)):
                        if (g := _gain(x, y, bad0, good0)) > best[0] + 1e-9:
                            best = (g, (f, above, cut))
            if best[1] is None:
                break
            grown.append(best[1])
            inside = [c for c in inside if _covers([best[1]], c[0])]
            if not sum(c[3] for c in inside):
                break
        if not grown:
            break

        def worth(conditions: list, rows: list) -> float:
            bad = sum(c[2] for c in rows if _covers(conditions, c[0]))
            good = sum(c[3] for c in rows if _covers(conditions, c[0]))
            return (bad - good) / (bad + good) if bad + good else -1.0

        held = [c for c in left if not c[1]]
        while len(grown) > 1 and worth(grown[:-1], held) >= worth(grown, held):
            grown = grown[:-1]
        hit = [c for c in left if _covers(grown, c[0])]
        bad, good = sum(c[2] for c in hit), sum(c[3] for c in hit)
        if bad < precision * (bad + good) or bad < 3:
            break
        rules.append((grown, bad, good))
        left = [c for c in left if not _covers(grown, c[0])]
    return rules


def _between(values: list[float]) -> list[float]:
    """Midpoints: a cut between two groups stands as far from the one as from the other."""
    return [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]


#: Labelled rows that a list is learned from at most.
SAMPLE_ROWS = 100_000


def learn(stats: DataFrame, labels: DataFrame, n_cuts: int = 24, precision: float = 0.9, most_rules: int = 8, most_conditions: int = 3, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules for rejecting documents, from labels.quality (1 good, 0 bad; others and null are left out).

    n_cuts: cut points for each statistic, at its quantiles among the bad and among the good. precision: the least share
    of bad rows in what a rule covers. Rows that base_failed() rejects teach nothing. No labelled rows: no rules.
    """
    spark = stats.sparkSession
    marked = named(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), "quality").distinct()
    share = min(1.0, sample_rows / max(1, marked.count()))
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))  # sample_rows
    values = features()
    rows = stats.where(~base_failed()).join(marked, F.col("doc_id") == F.col("_id"))
    rows = stored(spark, rows.select("doc_id", "quality", *[v.alias(k) for k, v in values.items()]), "quality-labelled")
    steps = [(i + 0.5) / n_cuts for i in range(n_cuts)]
    found = rows.groupBy("quality").agg(*[F.percentile_approx(k, steps, 2000).alias(k) for k in values]).collect()
    cuts = {k: _between(sorted({x for r in found for x in r[k] or ()})) for k in values}
    if not any(cuts.values()):
        return []
    below = lambda k: F.size(F.filter(F.array(*[F.lit(c) for c in cuts[k]]), lambda c: c < F.col(k)))
    bins = [below(k).alias(f"b{i}") for i, k in enumerate(values)]
    grow = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow")
    cells = rows.groupBy(grow, *bins).agg(F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good"))
    names = list(values)
    cells = [(tuple(r[f"b{i}"] for i in range(len(names))), r["grow"], r["bad"], r["good"]) for r in cells.collect()]
    cells.sort()
    out = cover(cells, [len(cuts[k]) for k in names], precision, most_rules, most_conditions)
    return [Rule(tuple(Condition(names[f], above, float(cuts[names[f]][cut])) for f, above, cut in r), bad, good) for r, bad, good in out]


def judge(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, **learning) -> DataFrame:
    """docs (or its columns `carry`, doc_id among them) with the counts of statistics(), base_failed and kept.

    A row for each row of docs. Null, empty and blank texts have no words, so base_failed holds and they aren't kept.
    Labels that name no document, and documents without labels, are fine; no labels at all: kept is not base_failed.
    Repeated labels count once; a document labelled both ways counts as both. Columns of docs that clash with the new
    ones are replaced. The counts are computed once and stored in the shared folder; the list is learned from them.
    """
    fresh = docs.drop(*COUNTS, "base_failed", "kept", "_s")
    stats = stored(docs.sparkSession, statistics(fresh).select(*(carry or fresh.columns), *COUNTS), "quality")
    rules = learn(stats.select("doc_id", *COUNTS), labels, **learning)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
