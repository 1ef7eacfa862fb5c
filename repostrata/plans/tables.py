"""The five output tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from repostrata.functions import filters
from repostrata.functions.documents import ordered
from repostrata.functions.keys import clean_url, repo_name
from repostrata.operators import complexity, diffs, history, lint, metadata, ownership, renames as moves, stars, testcode


def git_table(
    commits: DataFrame,
    changes: DataFrame,
    repos: DataFrame | None = None,
    patches: DataFrame | None = None,
    renames: DataFrame | None = None,
    since=None,
    to=None,
    author: str = "author_email",
    minor: float = 0.05,
    churn_mode: str = "difference",
) -> DataFrame:
    """One row of process metrics per repository.

    ``since`` and ``to`` bound the per-file metrics, not the commit totals. ``changes`` may
    already carry the commit's columns; otherwise they are joined on. ``patches`` gives
    the hunks, ``renames`` maps changes to the final name of their file. The names of the
    developers are rows of their own, see ``history.developers``.

    All per-file metrics come from one aggregate per (repository, file, author), all
    per-commit ones from one per (repository, commit).
    """
    dated = ["committer_date"] if since is not None or to is not None else []
    inside = history.in_window(since, to)
    attached = history.attach_commits(
        commits, changes, [author, *dated, *(["seq"] if renames is not None else [])]
    )
    window = attached.where(inside)
    if renames is not None:
        window = moves.apply_renames(window, renames)

    base = ownership.author_file_base(window, author, churn_mode)
    per_file = ownership.file_metrics(base, minor).groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.avg("added").alias("average_lines_added_to_files"),
        F.avg("removed").alias("average_lines_deleted_from_files"),
        F.avg("avg_added").alias("average_avg_lines_added_to_files"),
        F.avg("experience").alias("average_contributor_experience"),
        F.avg("contributors").alias("average_contributors"),
        F.avg("minor_contributors").alias("average_minor_contributors"),
        F.avg("churn_total").alias("average_code_churn_total"),
        F.avg("churn_max").alias("average_code_churn_max"),
        F.avg("churn_avg").alias("average_code_churn_avg"),
    )
    # The shares of a commit sum to one, so the file complexities of a repository sum to
    # its commit entropies: the mean over files needs no join of changes with commits.
    per_commit = complexity.commit_entropy(attached, carry=dated).groupBy("repo").agg(
        F.sum("files").alias("files_modified"),
        F.sum("added").alias("lines_added"),
        F.sum("deleted").alias("lines_deleted"),
        F.max(F.when(inside, F.col("files"))).alias("change_set_max"),
        F.sum(F.when(inside, F.col("files"))).alias("files_in_window"),
        F.sum(F.when(inside, F.col("entropy"))).alias("entropy"),
    )
    joined = commits.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.count_if(inside).alias("commits_in_window"),
        *history.dmm_aggregates(),
    )
    sides = [per_commit, per_file, history.developer_counts(commits)]
    if repos is not None:
        sides.append(_urls(repos))
    if patches is not None:
        sides.append(_hunks(history.attach_commits(commits, patches, dated).where(inside)))
    for side in sides:
        joined = joined.join(side, "repo", "left")
    absent = {"repo_url": "string"} if repos is None else {}
    absent |= {"average_hunks": "double"} if patches is None else {}
    counted = [
        "files_modified", "lines_added", "lines_deleted", "change_set_max", "files_in_window", "developer_count",
    ]
    return ordered(
        joined.fillna(0, counted)
        .withColumns(
            {
                **history.per_commit_averages(),
                "average_history_complexity": F.try_divide("entropy", "files"),
                "change_set_avg": F.try_divide("files_in_window", "commits_in_window"),
                **{name: F.lit(None).cast(kind) for name, kind in absent.items()},
            }
        )
        .drop("files", "files_in_window", "entropy", "commits_in_window"),
        ["repo"],
    )


def _urls(repos: DataFrame) -> DataFrame:
    url = clean_url(F.col("repo_url"))
    return repos.select(repo_name(url).alias("repo"), url.alias("repo_url")).groupBy("repo").agg(
        F.max("repo_url").alias("repo_url")
    )


def _hunks(patches: DataFrame) -> DataFrame:
    return diffs.hunk_means(diffs.file_hunks(diffs.diff_stats(patches)))


def test_table(sources: DataFrame, strict: bool = True, depth: str = "root") -> DataFrame:
    """One row per commit with Python files."""
    analysed = filters.python_sources(sources, depth=depth)
    return testcode.test_table(testcode.classify(analysed, strict))


def lint_rows(stats: DataFrame, messages: DataFrame, message_ids: DataFrame) -> DataFrame:
    """Rows ``(repo, commit_hash, committer_date, key, value)``: statistics, message counts by
    id and mean complexity of every commit, whatever the number of keys."""
    by = ("repo", "commit_hash", "committer_date")
    complexity_rows = lint.mccabe(messages, by).select(
        *by, F.lit("avg_mccabe_complexity").alias("key"), F.col("avg_mccabe_complexity").alias("value")
    )
    return lint.table_keys(lint.with_ids(stats, message_ids)).unionByName(complexity_rows)


def lint_table(stats: DataFrame, messages: DataFrame, message_ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per commit, a column for each of ``keys`` and every fixed column."""
    return lint.lint_wide(lint_rows(stats, messages, message_ids), keys)


def stargazers_table(events: DataFrame, repos: Sequence[str]) -> DataFrame:
    """One row per date, one running star count per repository."""
    return stars.growth_wide(events, repos)


def metadata_table(docs: DataFrame) -> DataFrame:
    """One row per repository."""
    return metadata.metadata_table(docs)
