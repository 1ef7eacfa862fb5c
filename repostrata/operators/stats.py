"""Summaries, rank statistics and correlation of metric columns.

Ranks and quantiles come from the histogram of distinct values and its running sum
(``prefix.running``), so ties of any size are one row and no task sees all values.
Several columns share one pass: they are turned into rows ``(column, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from repostrata.functions.distributions import correlation_p_value, inverse_normal, shapiro_result
from repostrata.operators.prefix import running
from repostrata.operators.skew import join_lookup

SKETCH = 1000  # size parameter of the quantile sketches
MOST_VALUES = 5000
_CHUNK = 4096
_QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _melted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return doubles.unpivot([], [F.col(f"`{c}`") for c in cols], "column", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def value_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values per column with their count ``n`` and last sorted position ``upto``."""
    return _ranks(_melted(df, cols))


def _ranks(melted: DataFrame) -> DataFrame:
    histogram = melted.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return running(histogram, ["column"], ["value"], sums={"upto": "n"})


def average_rank(df: DataFrame, col: str) -> DataFrame:
    """Each distinct value of ``col`` with its average rank."""
    return value_ranks(df, [col]).select(
        "value", "n", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank")
    )


def _quantiles(ranks: DataFrame, sizes: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per column. ``sizes`` has one row per column."""
    placed = ranks.join(F.broadcast(sizes.select("column", "count")), "column")
    first = F.col("upto") - F.col("n") + 1

    def value_at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position <= F.col("upto")), F.col("value")))

    parts = []
    for name, p in probabilities.items():
        at = F.lit(p) * (F.col("count") - 1) + 1
        parts += [value_at(F.floor(at)).alias(f"{name}_lo"), value_at(F.ceil(at)).alias(f"{name}_hi")]
    found = placed.groupBy("column", "count").agg(*parts)

    def between(name: str, p: float) -> Column:
        at = F.lit(p) * (F.col("count") - 1) + 1
        return F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (at - F.floor(at))

    return found.select("column", *[between(n, p).alias(n) for n, p in probabilities.items()])


def quantiles(df: DataFrame, cols: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """Exact, interpolated quantiles per column under the given names."""
    ranks = value_ranks(df, cols)
    return _quantiles(ranks, ranks.groupBy("column").agg(F.sum("n").alias("count")), probabilities)


def describe(df: DataFrame, cols: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum per column.

    Quartiles are exact and interpolated. With ``accuracy`` they are approximate (rank
    error ``1/accuracy``) and the whole summary is one pass without ranking the values.
    """
    basic = [
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    names = ["column", "count", "mean", "std", "min", *_QUARTILES, "max"]
    grouped = _melted(df, cols).groupBy("column")
    if accuracy is not None:
        quartiles = F.approx_percentile("value", list(_QUARTILES.values()), accuracy).alias("q")
        split = {name: F.col("q")[i] for i, name in enumerate(_QUARTILES)}
        return grouped.agg(*basic, quartiles).withColumns(split).select(*names)
    ranks = value_ranks(df, cols)
    summary = _summary(ranks)
    return summary.join(_quantiles(ranks, summary, _QUARTILES), "column").select(*names)


def summaries(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = SKETCH) -> DataFrame:
    """What ``merged`` needs of a batch of rows: one row per column, and per value of ``by``.

    Count, mean and squared deviations, minimum, maximum, and a quantile sketch of bounded size.
    They can be stored, and those of any batches added up, without the rows.
    """
    by = list(by)
    doubles = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    melted = doubles.unpivot(by, [F.col(f"`{c}`") for c in cols], "column", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    n = F.count("value")
    return melted.groupBy(*by, "column").agg(
        n.alias("n"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * n).alias("spread"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"),
    )


def merged(parts: DataFrame, k: int = SKETCH) -> DataFrame:
    """``describe`` of all rows behind some ``summaries``, from those alone.

    Quartiles are values of the rows whose rank is off by at most ``2.296 / k ** 0.9723`` of
    the count with a probability of 0.99 (0.28 % for 1,000), however many parts there are.
    """
    n, mean = F.col("n"), F.col("mean")
    total = parts.groupBy("column").agg(
        F.sum(n).alias("count"),
        (F.sum(n * mean) / F.sum(n)).alias("centre"),
        F.sum(F.col("spread") + n * mean * mean).alias("squares"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
    )
    spread = F.greatest(F.col("squares") - F.col("count") * F.col("centre") * F.col("centre"), F.lit(0.0))
    quartiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in _QUARTILES.items()]
    return total.select(
        "column", "count", F.col("centre").alias("mean"), F.sqrt(F.try_divide(spread, F.col("count") - 1)).alias("std"),
        "min", *quartiles, "max",
    )


def _summary(ranks: DataFrame) -> DataFrame:
    """The basic summary per column from its histogram, the deviation around the mean."""
    n, value = F.col("n"), F.col("value")
    means = ranks.groupBy("column").agg(
        F.sum("n").alias("count"),
        (F.sum(value * n) / F.sum("n")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    # One row per column: the broadcast side is as long as the column list.
    around = ranks.join(F.broadcast(means), "column").groupBy("column", "count", "mean", "min", "max")
    spread = around.agg(F.sum(n * F.pow(value - F.col("mean"), F.lit(2))).alias("spread"))
    return spread.withColumn("std", F.sqrt(F.try_divide("spread", F.col("count") - 1)))


def boxplot(df: DataFrame, cols: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (last values within ``reach`` times the quartile range) and
    the number of outliers per column."""
    ranks = value_ranks(df, cols)
    sizes = ranks.groupBy("column").agg(F.sum("n").alias("count"))
    boxes = _quantiles(ranks, sizes, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("value").between(F.col("q1") - reach * iqr, F.col("q3") + reach * iqr)
    # One row per column: the broadcast side is as long as the column list.
    return (
        ranks.join(F.broadcast(boxes), "column")
        .groupBy("column", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        )
    )


def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both metrics are present, as doubles ``x`` and ``y``."""
    both = df.select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
    return both.where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    )


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(n, coefficient, p_value)``."""
    return _with_p(pairs(df, x, y).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("coefficient")))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties: ``(n, coefficient, p_value)``.

    Equal pairs are counted first. Each pair then looks up the ranks of its two values;
    a value with very many partners is split over salted pieces.
    """
    both = pairs(df, x, y)
    return _spearman(both, value_ranks(both, ["x", "y"]))


def _spearman(both: DataFrame, ranks: DataFrame) -> DataFrame:
    counted = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    ranked = counted
    for name in ("x", "y"):
        own = ranks.where(F.col("column") == name).select(
            F.col("value").alias(name), (F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{name}"), F.col("n").alias(f"n{name}")
        )
        ranked = join_lookup(ranked, own, [name], f"n{name}")
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = ranked.agg(
        F.sum("w").alias("n"),
        F.sum(w * rx * ry).alias("xy"),
        F.sum(w * rx * rx).alias("xx"),
        F.sum(w * ry * ry).alias("yy"),
    )
    # Average ranks always have the mean (n + 1) / 2.
    centre = F.col("n") * F.pow((F.col("n") + 1) / 2, F.lit(2))
    spread = F.sqrt((F.col("xx") - centre) * (F.col("yy") - centre))
    return _with_p(sums.select("n", F.try_divide(F.col("xy") - centre, spread).alias("coefficient")))


def _with_p(one_row: DataFrame) -> DataFrame:
    return one_row.withColumn("p_value", correlation_p_value("coefficient", F.col("n").cast("double")))


def shapiro(df: DataFrame, cols: Sequence[str], sample_by: Sequence[str] = (), most: int = MOST_VALUES) -> DataFrame:
    """Shapiro-Wilk test per column: ``(column, n, statistic, p_value)``.

    The p-value is an approximation made for up to 5,000 values. By default all rows count.
    With ``sample_by``, columns that name a row, the test takes the ``most`` values of each
    column whose rows have the smallest hashes of those (see ``smallest``): a sample that
    does not depend on the order of rows, and for which the p-value holds. A tied value covers
    a range of positions, which is cut into chunks so that no task adds up the normal scores
    of a large tie alone.
    """
    return _shapiro(_ranks(smallest(df, cols, sample_by, most)) if sample_by else value_ranks(df, cols))


def smallest(df: DataFrame, cols: Sequence[str], by: Sequence[str], most: int) -> DataFrame:
    """``(column, value)``: of each column the ``most`` values whose rows hash smallest.

    The hash is that of the texts of ``by`` with a bar between; ties go to the smaller value.
    Every task keeps ``most`` rows of a column at a time, so nothing large is sorted.
    """
    named = F.md5(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in by]))
    out = None
    for c in cols:
        rows = df.select(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value"), named.alias("hash"))
        kept = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).orderBy("hash", "value").limit(most)
        out = kept if out is None else out.unionByName(kept)
    return out.select("column", "value")


def _shapiro(ranks: DataFrame) -> DataFrame:
    sizes = _summary(ranks).select("column", F.col("count").alias("size"), "spread")
    placed = ranks.join(F.broadcast(sizes), "column").withColumn("first", F.col("upto") - F.col("n") + 1)
    chunked = placed.withColumn("from", F.explode(F.sequence("first", "upto", F.lit(_CHUNK)))).withColumn(
        "to", F.least(F.col("from") + _CHUNK - 1, "upto")
    ).repartition("column", "from")
    positions = chunked.select("column", "value", "size", F.explode(F.sequence("from", "to")).alias("position"))
    score = inverse_normal((F.col("position") - 0.375) / (F.col("size") + 0.25))
    weighted = (
        positions.select("column", "value", score.alias("score"))
        .groupBy("column")
        .agg(F.sum(F.col("score") * F.col("score")).alias("squares"), F.sum(F.col("value") * F.col("score")).alias("weighted"))
    )

    def value_at(position: Column) -> Column:
        return F.max(F.when((F.col("first") <= position) & (position <= F.col("upto")), F.col("value")))

    size = F.col("size")
    ends = placed.groupBy("column", "size", "spread").agg(
        (value_at(size) - value_at(F.lit(1))).alias("outer_gap"),
        (value_at(size - 1) - value_at(F.lit(2))).alias("second_gap"),
    )
    return (
        ends.join(weighted, "column")
        .withColumn("r", shapiro_result("size", "squares", "weighted", "spread", "outer_gap", "second_gap"))
        .select("column", F.col("size").alias("n"), "r.statistic", "r.p_value")
    )


def strength(coefficient: Column) -> Column:
    """Word for the size of a correlation."""
    size = F.abs(coefficient)
    return F.when(size > 0.7, "strong").when(size > 0.3, "moderate").when(size > 0.1, "weak").otherwise("no")


def direction(coefficient: Column) -> Column:
    return F.when(coefficient > 0, "positive").when(coefficient < 0, "negative").otherwise("none")


def correlate(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """One row on the correlation of two metrics: method, size, coefficient, p-value and their
    reading as strength, direction and significance.

    Pearson when both metrics pass the normality test at ``alpha``, else Spearman. Values are
    ranked once, when this is called; only the two p-values of the test come to the driver.
    """
    both = pairs(df, x, y)
    ranks = value_ranks(both, ["x", "y"])
    normality = [row.p_value for row in _shapiro(ranks).collect()]
    normal = len(normality) == 2 and all(p is not None and p > alpha for p in normality)
    result = pearson(df, x, y) if normal else _spearman(both, ranks)
    r = F.col("coefficient")
    return result.select(
        F.lit("Pearson" if normal else "Spearman").alias("method"),
        "n",
        "coefficient",
        "p_value",
        strength(r).alias("strength"),
        direction(r).alias("direction"),
        F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("significant"),
    )
