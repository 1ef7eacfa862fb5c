import math
import random

import pytest
from pyspark.sql import functions as F

from repostrata.operators import complexity, diffs, history, ownership, renames
from repostrata.plans import tables

COMMITS = "repo string, commit_hash string, seq long, author_name string, author_email string, committer_date string"
DMM = "repo string, dmm_unit_size double, dmm_unit_complexity double, dmm_unit_interfacing double"
CHANGES = "repo string, commit_hash string, path string, added_lines long, deleted_lines long"


@pytest.fixture
def commits(spark):
    data = [
        ("r", "c1", 1, "Ann", "a@x", "2020-01-01"), ("r", "c2", 2, "Bob", "b@x", "2020-02-01"),
        ("r", "c3", 3, "Ann", "a@x", "2020-03-01"), ("s", "d1", 1, "Cy", "c@x", "2020-01-01"),
    ]
    df = spark.createDataFrame(data, COMMITS).withColumn("committer_date", F.to_timestamp("committer_date"))
    return df.withColumns({c: F.lit(None).cast("double") for c in DMM.replace(" double", "").split(", ")[1:]})


@pytest.fixture
def changes(spark):
    data = [("r", "c1", "a", 10, 0), ("r", "c1", "b", 10, 0), ("r", "c2", "a", 4, 6)]
    return spark.createDataFrame(data, CHANGES)


def test_totals_and_commit_without_files(commits, changes, rows):
    got = rows(history.repo_totals(commits, changes), "repo", "total_commits", "files_modified", "lines_added",
               "lines_deleted", "average_lines_added_per_commit")
    assert got == [("r", 3, 3, 24, 6, 8.0), ("s", 1, 0, 0, 0, 0.0)]
    joined = history.commit_files(commits, changes).where("path is null")
    assert rows(joined, "commit_hash") == [("c3",), ("d1",)]


def test_developers(commits, rows):
    assert rows(history.developers(commits)) == [("r", 1, "Ann"), ("r", 2, "Bob"), ("s", 1, "Cy")]
    lists = history.developer_lists(commits)
    assert rows(lists) == [("r", 0, ["Ann", "Bob"]), ("s", 0, ["Cy"])]
    assert rows(history.developer_lists(commits, size=1)) == [("r", 0, ["Ann"]), ("r", 1, ["Bob"]), ("s", 0, ["Cy"])]
    assert rows(history.developer_counts(commits)) == [("r", 2), ("s", 1)]


def test_dmm_leaves_out_zero_and_missing(spark, rows):
    data = [("r", v, 0.0, None) for v in (0.0, None, 0.5, 1.0)]
    df = spark.createDataFrame(data, DMM)
    assert rows(history.dmm_means(df)) == [("r", 0.75, None, None)]
    assert rows(history.dmm_means(df, include_zero=True)) == [("r", 0.5, 0.0, None)]


def test_lines_churn_and_change_set(commits, changes, rows):
    assert rows(history.file_lines(changes)) == [("r", "a", 14, 6, 7.0), ("r", "b", 10, 0, 10.0)]
    assert rows(history.file_churn(changes)) == [("r", "a", 8, 10, 4.0), ("r", "b", 10, 10, 10.0)]
    assert rows(history.file_churn(changes, "sum")) == [("r", "a", 20, 10, 10.0), ("r", "b", 10, 10, 10.0)]
    assert rows(history.change_set(commits, changes)) == [("r", 2, 1.0), ("s", 0, 0.0)]
    with pytest.raises(ValueError):
        history.file_churn(changes, "other")


def test_ownership_golden(spark, rows):
    data = [("r", "f", "X", 97, 0), ("r", "f", "Y", 1, 2), ("r", "z", "X", 0, 0)]
    df = spark.createDataFrame(data, "repo string, path string, author_email string, added_lines long, deleted_lines long")
    assert rows(ownership.file_ownership(df)) == [("r", "f", 97.0, 2, 1), ("r", "z", None, 1, 0)]


def test_ownership_of_a_file_with_many_authors(spark, rows):
    """More authors than can hold a major share, compared with the plain definition."""
    rng = random.Random(3)
    data = [("r", f"f{rng.randrange(3)}", f"a{rng.randrange(300)}", rng.randrange(30), rng.randrange(3)) for _ in range(3000)]
    data += [("r", "f0", f"big{i}", 900, 0) for i in range(5)]
    df = spark.createDataFrame(data, "repo string, path string, author_email string, added_lines long, deleted_lines long")
    want = []
    for path in ("f0", "f1", "f2"):
        lines = {}
        for _, p, author, added, deleted in data:
            if p == path:
                lines[author] = lines.get(author, 0) + added + deleted
        total = sum(lines.values())
        want.append(("r", path, max(lines.values()) / total * 100, len(lines), sum(n / total < 0.05 for n in lines.values())))
    assert rows(ownership.file_ownership(df)) == want


def test_history_complexity_golden(changes, rows):
    assert rows(complexity.commit_entropy(changes), "commit_hash", "entropy") == [("c1", 1.0), ("c2", 0.0)]
    files = complexity.history_complexity(changes)
    assert rows(files) == [("r", "a", 0.5), ("r", "b", 0.5)]
    assert rows(complexity.complexity_means(files)) == [("r", 0.5)]


def test_entropy_matches_definition(spark):
    rng = random.Random(1)
    data = [("r", "c", f"f{i}", rng.randrange(50), rng.randrange(50)) for i in range(40)] + [("r", "c", "none", 0, 0)]
    total = sum(a + d for *_, a, d in data)
    want = -sum((a + d) / total * math.log2((a + d) / total) for *_, a, d in data if a + d)
    got = complexity.commit_entropy(spark.createDataFrame(data, CHANGES)).first()
    assert got.entropy == pytest.approx(want, abs=1e-12) and got.files == 41


PATCH = "@@ -1 +1 @@\n-a\n+b\n ctx\n+c\n+d\n ctx2\n-e"


@pytest.mark.parametrize(
    "patch,want",
    [
        (PATCH, (3, 2, 3)),
        ("--- a/f\n+++ b/f\n" + PATCH, (3, 2, 3)),
        ("@@ @@\n" + "+x\n" * 50_000 + " c\n" + "-y\n" * 50_000, (50_000, 50_000, 2)),
        ("@@ @@\n+\n-\n \n+", (2, 1, 2)),
        ("", (0, 0, 0)),
    ],
)
def test_diff_stats(spark, rows, patch, want):
    df = spark.createDataFrame([(patch,)], "patch string")
    assert rows(diffs.diff_stats(df)) == [want]


def test_median_hunks(spark, rows):
    df = spark.createDataFrame([("r", "f", 1), ("r", "f", 4), ("r", "g", 3)], "repo string, path string, hunks long")
    files = diffs.file_hunks(df)
    assert rows(files) == [("r", "f", 2.5), ("r", "g", 3.0)]
    assert rows(diffs.hunk_means(files)) == [("r", 2.75)]


EDGES = "repo string, old_path string, new_path string, seq long"


def follow(edges, repo, path, seq):
    """Final name of a path by walking one rename at a time."""
    while True:
        later = [e for e in edges if e[0] == repo and e[1] == path and e[3] > seq]
        if not later:
            return path
        _, _, path, seq = min(later, key=lambda e: e[3])


def test_rename_chain_and_reused_names(spark, rows):
    edges = [("r", "a", "b", 1), ("r", "b", "c", 2), ("r", "c", "a", 3), ("r", "a", "d", 9), ("s", "a", "x", 1)]
    got = rows(renames.canonical_paths(spark.createDataFrame(edges, EDGES)), "repo", "old_path", "seq", "final_path")
    assert got == [("r", "a", 1, "d"), ("r", "a", 9, "d"), ("r", "b", 2, "d"), ("r", "c", 3, "d"), ("s", "a", 1, "x")]


def test_renames_match_brute_force(spark, rows):
    rng = random.Random(5)
    edges = {}
    for _ in range(400):
        repo, old, seq = rng.choice("rrs"), f"p{rng.randrange(12)}", rng.randrange(300)
        edges[repo, old, seq] = (repo, old, f"p{rng.randrange(12)}", seq)
    edges = list(edges.values())
    df = spark.createDataFrame(edges, EDGES)
    got = rows(renames.canonical_paths(df), "repo", "old_path", "seq", "final_path")
    assert got == sorted(((r, o, s, follow(edges, r, n, s)) for r, o, n, s in edges), key=repr)

    points = [(rng.choice("rs"), f"p{rng.randrange(14)}", rng.randrange(300), i) for i in range(300)]
    changes = spark.createDataFrame(points, "repo string, path string, seq long, id long")
    moved = rows(renames.apply_renames(changes, df), "id", "path")
    assert moved == sorted(((i, follow(edges, r, p, s)) for r, p, s, i in points), key=repr)


def test_git_table_columns_window_and_hunks(spark, commits, changes):
    patches = spark.createDataFrame([("r", "c1", "a", PATCH), ("r", "c2", "a", "@@ @@\n+x")], "repo string, commit_hash string, path string, patch string")
    repos = spark.createDataFrame([("https://h/o/r.git/",)], "repo_url string")
    table = tables.git_table(commits, changes, repos, patches)
    assert table.columns == [
        "repo", "average_avg_lines_added_to_files", "average_code_churn_avg", "average_code_churn_max",
        "average_code_churn_total", "average_contributor_experience", "average_contributors",
        "average_dmm_method_cyclomatic_complexity", "average_dmm_method_lines_of_code",
        "average_dmm_method_number_of_parameters", "average_files_modified_per_commit",
        "average_history_complexity", "average_hunks", "average_lines_added_per_commit",
        "average_lines_added_to_files", "average_lines_deleted_from_files", "average_lines_deleted_per_commit",
        "average_minor_contributors", "change_set_avg", "change_set_max", "developer_count",
        "files_modified", "lines_added", "lines_deleted", "repo_url", "total_commits",
    ]
    r = table.where("repo = 'r'").first()
    assert (r.average_hunks, r.repo_url, r.average_history_complexity) == (2.0, "https://h/o/r.git", 0.5)
    assert (r.average_contributors, r.developer_count, r.change_set_avg) == (1.5, 2, 1.0)
    s = table.where("repo = 's'").first()
    assert (s.lines_added, s.change_set_max, s.average_contributors) == (0, 0, None)

    early = tables.git_table(commits, changes, to="2020-01-15").where("repo = 'r'").first()
    assert (early.files_modified, early.total_commits) == (3, 3)
    assert (early.average_lines_added_to_files, early.change_set_avg, early.average_contributors) == (10.0, 2.0, 1.0)


def test_git_table_follows_renames(spark, commits, changes):
    edges = spark.createDataFrame([("r", "b", "a", 2)], EDGES)
    r = tables.git_table(commits, changes, renames=edges).where("repo = 'r'").first()
    assert r.average_lines_added_to_files == 24.0


def test_tied_renames_keep_the_number_of_changes(spark, commits, changes, rows):
    """Of two renames of a path in one commit the smaller target counts."""
    edges = spark.createDataFrame([("r", "b", "d", 2), ("r", "b", "c", 2), ("r", "c", "e", 3), ("r", "c", "e", 3)], EDGES)
    attached = history.attach_commits(commits, changes, ["seq"])
    moved = renames.apply_renames(attached, edges)
    assert moved.count() == attached.count()
    assert {r.path for r in moved.collect()} <= {"a", "b", "c", "e"}
