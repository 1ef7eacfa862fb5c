"""Commit totals and per-file change metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repostrata.operators.prefix import running


def in_window(since, to, column: str = "committer_date") -> Column:
    """Dated from ``since`` to ``to``, both included; ``None`` leaves a side open."""
    inside = F.lit(True)
    if since is not None:
        inside = inside & (F.col(column) >= F.lit(since))
    if to is not None:
        inside = inside & (F.col(column) <= F.lit(to))
    return inside


def within(df: DataFrame, since, to, column: str = "committer_date") -> DataFrame:
    """Rows dated from ``since`` to ``to``."""
    return df.where(in_window(since, to, column))


def attach_commits(commits: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """File changes with ``columns`` of their commit."""
    missing = [c for c in columns if c not in changes.columns]
    if not missing:
        return changes
    return changes.join(commits.select("repo", "commit_hash", *missing), ["repo", "commit_hash"])


def commit_files(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Every commit with its file changes; a commit without changes keeps one row of NULLs.

    An inner join, whose hot commits adaptive execution can split, and the commits without
    changes on their own.
    """
    keys = ["repo", "commit_hash"]
    extra = [c for c in changes.columns if c not in commits.columns]
    filled = commits.join(changes.select(*keys, *extra), keys)
    return filled.unionByName(commits.join(changes.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def repo_totals(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits, files and lines per repository, and their averages per commit.

    Each side is aggregated on its own before the join, so no commit is multiplied by
    its files.
    """
    per_repo = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("total_commits"))
    lines = changes.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files_modified"),
        F.sum("added_lines").alias("lines_added"),
        F.sum("deleted_lines").alias("lines_deleted"),
    )
    counted = per_repo.join(lines, "repo", "left").fillna(
        0, ["files_modified", "lines_added", "lines_deleted"]
    )
    return counted.withColumns(per_commit_averages())


def per_commit_averages() -> dict[str, Column]:
    """Averages per commit from the total columns."""
    return {
        f"average_{name}_per_commit": F.try_divide(F.col(name), F.col("total_commits"))
        for name in ("lines_added", "lines_deleted", "files_modified")
    }


def author_first_seen(commits: DataFrame) -> DataFrame:
    """Distinct author names per repository with the position of their first commit."""
    return commits.groupBy("repo", "author_name").agg(F.min("seq").alias("first_seq"))


def developers(commits: DataFrame) -> DataFrame:
    """One row per developer: ``(repo, position, author_name)`` in first-seen order.

    Runs a job when it is called, see ``running``.
    """
    return running(
        author_first_seen(commits), ["repo"], ["first_seq", "author_name"], number="position"
    ).select("repo", "position", "author_name")


def developer_counts(commits: DataFrame) -> DataFrame:
    """Number of named developers per repository."""
    named = author_first_seen(commits).where(F.col("author_name").isNotNull())
    return named.groupBy("repo").agg(F.count(F.lit(1)).alias("developer_count"))


NAMES_PER_PART = 10_000


def developer_lists(commits: DataFrame, size: int = NAMES_PER_PART) -> DataFrame:
    """All developer names per repository as lists: ``(repo, part, developers)``.

    Part k holds the names at positions ``k * size + 1`` to ``(k + 1) * size`` in first-seen
    order, so no cell and no group grows with a repository.
    """
    named = developers(commits.where(F.col("author_name").isNotNull()))
    part = F.floor((F.col("position") - 1) / size).alias("part")
    lists = named.groupBy("repo", part).agg(F.array_sort(F.collect_list(F.struct("position", "author_name"))).alias("l"))
    return lists.select("repo", "part", F.col("l.author_name").alias("developers"))


def _dmm_mean(column: str, include_zero: bool) -> Column:
    # The published number leaves out zeros as well as missing values.
    return F.avg(F.col(column) if include_zero else F.nullif(F.col(column), F.lit(0.0)))


def dmm_aggregates(include_zero: bool = False) -> list[Column]:
    """Aggregates of the three maintainability values of a commit."""
    return [
        _dmm_mean("dmm_unit_size", include_zero).alias("average_dmm_method_lines_of_code"),
        _dmm_mean("dmm_unit_complexity", include_zero).alias("average_dmm_method_cyclomatic_complexity"),
        _dmm_mean("dmm_unit_interfacing", include_zero).alias("average_dmm_method_number_of_parameters"),
    ]


def dmm_means(commits: DataFrame, include_zero: bool = False) -> DataFrame:
    """Mean maintainability values per repository; NULL where no commit has one."""
    return commits.groupBy("repo").agg(*dmm_aggregates(include_zero))


def churn_of(mode: str = "difference") -> Column:
    """Churn of one modification: added minus deleted lines, or their ``sum``."""
    if mode == "difference":
        return F.col("added_lines") - F.col("deleted_lines")
    if mode == "sum":
        return F.col("added_lines") + F.col("deleted_lines")
    raise ValueError("mode is 'difference' or 'sum'")


def file_lines(changes: DataFrame) -> DataFrame:
    """Lines added, removed and added on average per file."""
    return changes.groupBy("repo", "path").agg(
        F.sum("added_lines").alias("added"),
        F.sum("deleted_lines").alias("removed"),
        F.avg("added_lines").alias("avg_added"),
    )


def file_churn(changes: DataFrame, mode: str = "difference") -> DataFrame:
    """Total, highest and average churn per file over its modifications."""
    churn = churn_of(mode)
    return changes.groupBy("repo", "path").agg(
        F.sum(churn).alias("churn_total"),
        F.max(churn).alias("churn_max"),
        F.avg(churn).alias("churn_avg"),
    )


def change_set(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Most and average files committed together; a commit without files counts as zero."""
    per_commit = changes.groupBy("repo", "commit_hash").agg(F.count(F.lit(1)).alias("files"))
    in_repo = per_commit.groupBy("repo").agg(
        F.max("files").alias("change_set_max"), F.sum("files").alias("files")
    )
    counts = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"))
    return counts.join(in_repo, "repo", "left").select(
        "repo",
        F.coalesce("change_set_max", F.lit(0)).alias("change_set_max"),
        F.try_divide(F.coalesce("files", F.lit(0)), "commits").alias("change_set_avg"),
    )
