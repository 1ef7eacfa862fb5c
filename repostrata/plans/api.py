"""Choose analyses, run them over canonical tables and write their tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from repostrata.functions.filters import python_sources
from repostrata.operators import history, testcode
from repostrata.operators.stars import growth_long
from repostrata.plans import tables as plans
from repostrata.session import pinned
from repostrata.sources.rawstore import RawStore
from repostrata.sources.writers import FORMATS, write_outputs

ANALYSES = ("git", "lint", "test", "stars", "metadata")


def analyze(
    tables: dict[str, DataFrame],
    which: Iterable[str] = ANALYSES,
    star_repos: Sequence[str] | None = None,
    lint_keys: Sequence[str] | None = None,
    test_options: dict | None = None,
    **git_options,
) -> dict[str, DataFrame]:
    """Result tables of the chosen analyses.

    ``tables`` holds the canonical tables by name (and ``message_ids`` for lint). The git
    analysis also gives ``git_developers``, one row per developer; ``git_options`` are those
    of ``git_table``. Lint and stars come in rows; ``lint_keys`` and ``star_repos`` add the
    wide tables with a column for each of them. ``test_options`` are ``strict`` and ``depth``.
    """
    chosen = list(which)
    unknown = set(chosen) - set(ANALYSES)
    if unknown or not chosen:
        raise ValueError(f"choose among {ANALYSES}")
    results: dict[str, DataFrame] = {}
    for name in chosen:
        if name == "git":
            results["git"] = plans.git_table(
                tables["commits"], tables["file_changes"], tables.get("repos"), tables.get("patches"),
                tables.get("rename_edges"), **git_options,
            )
            results["git_developers"] = history.developers(tables["commits"])
        elif name == "lint":
            facts = (tables["lint_stats"], tables["lint_messages"], tables["message_ids"])
            results["lint_rows"] = plans.lint_rows(*facts)
            if lint_keys is not None:
                results["lint"] = plans.lint_table(*facts, lint_keys)
        elif name == "test":
            results["test"] = plans.test_table(tables["source_files"], **(test_options or {}))
        elif name == "stars":
            results["star_growth"] = growth_long(tables["star_events"])
            if star_repos is not None:
                results["stargazers"] = plans.stargazers_table(tables["star_events"], star_repos)
        else:
            results["metadata"] = plans.metadata_table(tables["repo_metadata"])
    return results


def store_raw(
    tables: dict[str, DataFrame], results: dict[str, DataFrame], store: RawStore, run_ts: str, which: Iterable[str]
) -> None:
    """Append what the chosen analyses are made of, and the git results, to a raw store."""
    for name in which:
        if name == "git":
            store.append_git(results["git"], run_ts)
        elif name == "lint":
            store.append_lints(tables["lint_messages"], pinned(tables["lint_stats"]), run_ts)
        elif name == "test":
            files = pinned(testcode.classify(python_sources(tables["source_files"])))
            commits = results["test"].select("repo", "commit_hash", "date", "test_to_code_ratio")
            store.append_tests(files, commits, run_ts)
        elif name == "stars":
            store.append_stargazers(tables["star_events"], run_ts)
        else:
            store.append_metadata(tables["repo_metadata"], run_ts)


def run(
    tables: dict[str, DataFrame],
    path: str,
    run_ts: str,
    which: Iterable[str] = ANALYSES,
    formats: Sequence[str] = ("csv",),
    **options,
) -> dict[str, str]:
    """Analyse and write the results in every format: csv, json, parquet or raw.

    Tables go below ``path/run_ts``. The raw store at ``path/raw`` takes the facts behind
    them as one more run, see ``RawStore``. ``options`` are those of ``analyze``. Returns the
    folders that were written.
    """
    unknown = set(formats) - {*FORMATS, "raw"}
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    chosen = list(which)
    results = analyze(tables, chosen, **options)
    written = write_outputs(results, path, run_ts, [f for f in formats if f != "raw"])
    if "raw" in formats:
        written["raw"] = f"{path.rstrip('/')}/raw"
        store = RawStore(next(iter(tables.values())).sparkSession, written["raw"])
        store_raw(tables, results, store, run_ts, chosen)
    return written
