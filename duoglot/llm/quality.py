"""Quality rules as a learned decision list, in DataFrame expressions only.

Sequential covering: a rule is a conjunction of thresholds on text statistics that
marks poor texts. A rule is grown on two thirds of the labelled rows by information gain, pruned
on the last third, and the rows that it covers are set aside before the next one is grown. The
learner sees counts of labelled rows by binned statistics; the list comes out as one ordered
``CASE WHEN`` over the statistics of a text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
SHARES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share",
          "mean_chars")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda uses it often."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more: equal windows are neighbours
    once sorted by hash; then every marked window adds the words that the one before lacks."""
    last = F.size(words) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("at")))

    def marked(found: Column) -> Column:
        twice = F.filter(found, lambda x, i: F.coalesce(F.get(found, i - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(found, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(twice["at"])

    def covered(at: Column) -> Column:
        added = F.transform(at, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(at, i - 1), F.lit(-3))))
        return F.aggregate(added, F.lit(0).cast("long"), lambda total, n: total + n)

    return F.when(last < 0, F.lit(0).cast("long")).otherwise(
        _let(_let(F.sort_array(windows), marked), covered))


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    by_word = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated_words(w).alias("n_repeat_words")))
    by_line = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        by_word.alias("words"), by_line.alias("lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"))


def measured(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with one more column ``quality_stats``: counts, shares and
    ``base_failed`` (too few words, or more than half of them in repeated windows)."""
    raw = documents.withColumn("_raw", statistics(F.col(text_col)))
    n, chars = F.col("_raw.words.n_words"), F.col("_raw.words.word_chars")
    repeat, dup = F.col("_raw.words.n_repeat_words"), F.col("_raw.lines.n_dup_lines")
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    stats = F.struct(
        n.alias("n_words"), chars.alias("word_chars"), F.col("_raw.n_symbols").alias("n_symbols"),
        dup.alias("n_dup_lines"), repeat.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * repeat > MAX_REPEATED * n)).alias("base_failed"),
        per(F.col("_raw.n_symbols"), chars).alias("symbol_share"),
        per(dup, F.col("_raw.lines.n_lines")).alias("dup_line_share"),
        per(repeat, n).alias("repeat_share"), per(F.col("_raw.n_upper"), chars).alias("upper_share"),
        per(F.col("_raw.n_marks"), n).alias("mark_share"), per(chars, n).alias("mean_chars"))
    return raw.withColumn("quality_stats", stats).drop("_raw")


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    cut: float


Rule = tuple[Test, ...]


def labelled_cells(documents: DataFrame, labels: DataFrame, max_labels: int, bins: int,
                   id_col: str = "doc_id") -> tuple[dict[str, list[float]], list]:
    """Cut points of each share, and counts of labelled rows by bins, fold and label.

    At most ``max_labels`` labelled rows take part, those of the smallest hash of the id; so
    cut points and cells are bounded. Rows without id or label and rows that fail the base
    rules do not take part; of several labels of one id the lowest counts.
    """
    sample = (labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("_quality"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_labels))
    rows = documents.select(F.col(id_col).alias("_id"), F.col("text").alias("_text")).join(
        F.broadcast(sample), "_id")
    fold = (F.pmod(F.xxhash64(F.lit("fold"), F.col("_id")), F.lit(3)) == 0).alias("prune")
    known = (measured(rows, "_text").where(~F.col("quality_stats.base_failed"))
             .select("quality_stats", (F.col("_quality") == 0).alias("poor"), fold)
             .select(*[F.col(f"quality_stats.{name}").alias(name) for name in SHARES], "poor", "prune"))
    # One pass: at most max_labels rows of eight numbers, then everything is on this table.
    known = known.checkpoint()
    points = [i / bins for i in range(1, bins)]
    quantiles = known.select(*[F.percentile(name, F.array(*map(F.lit, points))).alias(name)
                               for name in SHARES]).first()
    cuts = {}
    for name in SHARES:  # half-way between neighbours, so that no rule sits on an observed value
        values = sorted(set(quantiles[name] or []))
        cuts[name] = [(low + high) / 2 for low, high in zip(values, values[1:])]
    binned = [sum(((F.col(name) > cut).cast("int") for cut in cuts[name]), F.lit(0)).alias(name)
              for name in SHARES]
    cells = (known.select(*binned, "poor", "prune").groupBy(*SHARES, "poor", "prune")
             .agg(F.count("*").alias("n")).collect())
    return cuts, sorted(cells)


def learn(cuts: dict[str, list[float]], cells: list, max_rules: int = 12, max_tests: int = 4,
          min_rows: int = 5, min_precision: float = 0.95) -> list[Rule]:
    """An ordered list of rules for poor texts. Bin ``b`` of a share holds the values above
    its first ``b`` cut points and not above the next one."""
    tests = [(name, above, at) for name in SHARES for at in range(len(cuts[name]))
             for above in (True, False)]

    def holds(test: tuple, cell) -> bool:
        name, above, at = test
        return (cell[name] > at) == above

    def covered(tests_: list, rows: list) -> list:
        return [c for c in rows if all(holds(t, c) for t in tests_)]

    def weigh(rows: list) -> tuple[int, int]:
        return (sum(c["n"] for c in rows if c["poor"]), sum(c["n"] for c in rows if not c["poor"]))

    left, rules = list(cells), []
    while len(rules) < max_rules:
        grow = [c for c in left if not c["prune"]]
        check = [c for c in left if c["prune"]]
        chosen, rows = [], grow
        while len(chosen) < max_tests:
            poor, good = weigh(rows)
            if not poor or not good:
                break
            before = math.log2(poor / (poor + good))
            best, best_gain = None, 0.0
            for test in tests:
                p, g = weigh([c for c in rows if holds(test, c)])
                gain = p * (math.log2(p / (p + g)) - before) if p else 0.0
                if gain > best_gain + 1e-9:
                    best, best_gain = test, gain
            if best is None:
                break
            chosen.append(best)
            rows = [c for c in rows if holds(best, c)]
        # Prune: drop last tests while that does not lower (poor - good) / (poor + good).
        def value(tests_: list) -> float:
            p, g = weigh(covered(tests_, check))
            return (p - g) / (p + g) if p + g else -1.0
        while len(chosen) > 1 and value(chosen[:-1]) >= value(chosen):
            chosen.pop()
        poor, good = weigh(covered(chosen, left))
        if not chosen or poor < min_rows or poor < min_precision * (poor + good):
            break
        rules.append(tuple(Test(name, above, cuts[name][at]) for name, above, at in chosen))
        left = [c for c in left if not all(holds(t, c) for t in chosen)]
    return rules


def verdict(rules: list[Rule], stats: str = "quality_stats") -> Column:
    """True for kept: the base rules first, then the list in its order."""
    case = F.when(F.col(f"{stats}.base_failed"), F.lit(False))
    for rule in rules:
        condition = F.lit(True)
        for test in rule:
            value = F.col(f"{stats}.{test.name}")
            condition = condition & (value > test.cut if test.above else value <= test.cut)
        case = case.when(condition, F.lit(False))
    return case.otherwise(F.lit(True))


def quality_rules(documents: DataFrame, labels: DataFrame, max_labels: int = 20_000,
                  bins: int = 100) -> list[Rule]:
    """Rules learned from ``labels`` (``doc_id, quality``; 0 is poor) of ``documents``.
    Without usable labels the list is empty and only the base rules hold."""
    return learn(*labelled_cells(documents, labels, max_labels, bins))


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept)``, one row per row of ``documents``; null texts count as empty and fail."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return (measured(documents.select("doc_id", "text"))
            .select("doc_id", *[F.col(f"quality_stats.{name}").alias(name) for name in names],
                    verdict(rules).alias("kept")))


def keep(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The kept rows with all their columns."""
    rows = documents.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    return measured(rows, "_text").where(verdict(rules)).select("_row.*")
