"""Quality rules whose thresholds are chosen with a guarantee on false rejections.

Each rule rejects a document when a statistic passes a cutoff. Cutoffs are tested on the
labelled good documents of each stratum (language): a cutoff is admissible when the exact
binomial test rejects the hypothesis that more than its share of ``ALPHA`` of good documents
fall to it. The error probability ``DELTA`` is divided by the number of tests (Bonferroni
over strata, rules and cutoffs), and ``ALPHA`` by the number of rules, so with probability
``1 - DELTA`` the rules together reject at most ``ALPHA`` of the good documents of every
stratum. Of the admissible cutoffs of a rule the one that rejects most is used; a rule
without one is not applied in that stratum.

Everything is DataFrame expressions; documents are read once and never exploded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from repostrata.llm.common import WORD
from repostrata.session import pinned

ALPHA = 0.05
DELTA = 0.05
#: Statistic as SQL over the base columns, whether large values are bad, cutoffs from strict to lenient.
RULES: dict[str, tuple[str, bool, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", True, (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)),
    "repeats": ("n_repeat_words / n_words", True, (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)),
    "lines": ("1e2 * n_dup_lines / n_words", True, (0.2, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0)),
    "short_words": ("word_chars / n_words", False, (4.5, 4.2, 4.0, 3.7, 3.4, 3.0, 2.5, 2.0)),
    "long_words": ("word_chars / n_words", True, (5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 10.0, 12.0)),
}
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found at least twice in the array ``words``.

    Windows are sorted with their positions, so equal ones become neighbours; the positions
    of repeated ones are sorted again, and each covers three words less its overlap with the next.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.struct(
            F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("w"),
            i.alias("i"),
        ),
    )

    def positions(ordered: Column) -> Column:
        count = F.size(ordered)

        def twice(item: Column, at: Column) -> Column:
            before = (at > 0) & (F.get(ordered, at - 1)["w"] == item["w"])
            return before | ((at < count - 1) & (F.get(ordered, at + 1)["w"] == item["w"]))

        return F.array_sort(F.transform(F.filter(ordered, twice), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")
            ),
            lambda acc: acc["n"],
        )

    ordered = F.array_sort(windows)
    held = F.transform(F.array(ordered), positions)
    total = F.get(F.transform(held, covered), F.lit(0))
    return F.when(F.size(words) >= 3, total).otherwise(F.lit(0).cast("long"))


def base_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, …)``: the base statistics of every row; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    chars = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    known = docs.select("doc_id", "lang", text.alias("text"), words.alias("words"))
    return known.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _rejects(rule: str, cutoff: float) -> Column:
    statistic, large, _ = RULES[rule]
    value = F.when(F.col("n_words") > 0, F.expr(statistic)).otherwise(0.0)
    return value > cutoff if large else value < cutoff


def _log_gamma(x: Column) -> Column:
    """Stirling's series at ``x + 8``, taken back by the recurrence; ``x`` at least 1."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    back = F.ln(x)
    for k in range(1, 8):
        back = back + F.ln(x + k)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Probability of at most ``k`` successes in ``n`` trials of chance ``p``, as a column.

    1 where ``k`` is not below the expectation. Otherwise terms are added downwards from
    ``k``; they fall at least geometrically, and beyond 40 standard deviations vanish.
    """
    top = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0)
    top = F.exp(top + k * math.log(p) + (n - k) * math.log1p(-p))
    reach = F.least(k, F.ceil(40 * F.sqrt(n)) + 10).cast("int")
    steps = F.when(reach > 0, F.sequence(F.lit(0), reach - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, j: F.struct(
            (acc["term"] * (k - j) / (n - k + j + 1.0) * ((1 - p) / p)).alias("term"),
            (acc["sum"] + acc["term"] * (k - j) / (n - k + j + 1.0) * ((1 - p) / p)).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(top * total)


def thresholds(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(stratum, <rule>…)``: the chosen cutoff of each rule per stratum, null where none is admissible.

    ``good`` has the base statistics and ``stratum`` of the labelled good documents that pass
    the base rules. One row per stratum that has any.
    """
    cells = [(rule, i, c) for rule, (_, _, cuts) in RULES.items() for i, c in enumerate(cuts)]
    counted = good.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(_rejects(rule, cut)).alias(f"{rule}_{i}") for rule, i, cut in cells],
    )
    counted = pinned(counted)
    tests = counted.count() * len(cells) or 1
    share = alpha / len(RULES)

    def chosen(rule: str) -> Column:
        # Cutoffs go from strict to lenient: the first admissible one rejects most.
        tests_ = [
            F.when(binomial_tail(F.col(f"{rule}_{i}"), F.col("n"), share) <= delta / tests, F.lit(cut))
            for r, i, cut in cells
            if r == rule
        ]
        return F.coalesce(*tests_).alias(rule)

    return counted.select("stratum", *[chosen(rule) for rule in RULES])


def verdicts(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Base statistics with ``base_failed`` and ``kept`` for every row of ``stats``.

    Rows of ``labels(doc_id, quality)`` with quality 1 are the good documents; null ids and
    qualities are left out, a document labelled twice counts if any label is 1. The stratum of
    a null language is the empty string. Without labels only the base rules reject. Repeated
    rows get equal verdicts and count once for the thresholds.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
    staged = stats.withColumn("stratum", F.coalesce("lang", F.lit(""))).withColumn("base_failed", base_failed())
    passed = staged.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("good_id"), "left_semi")
    # Equal rows are one trial: the binomial bound counts on independent ones.
    passed = passed.distinct()
    cutoffs = thresholds(passed, alpha, delta)
    strata = staged.join(cutoffs.withColumnRenamed("stratum", "stratum_"), F.col("stratum") == F.col("stratum_"), "left")
    fails = F.lit(False)
    for rule, (statistic, large, _) in RULES.items():
        value = F.when(F.col("n_words") > 0, F.expr(statistic))
        broken = value > F.col(rule) if large else value < F.col(rule)
        fails = fails | F.coalesce(broken, F.lit(False))
    return strata.select("doc_id", *_BASE, "base_failed", (~F.col("base_failed") & ~fails).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``verdicts`` over whole ``documents``; their statistics are computed once and written."""
    return verdicts(pinned(base_statistics(docs)), labels, alpha, delta)
