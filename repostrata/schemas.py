"""Fixed schemas of the canonical input tables.

Dynamic keys (lint statistics, language names) are rows, never columns, so every
table here has one schema for all repositories. Written as DDL, which readers take as is.
"""

REPOS = "repo_url STRING"

# seq is the position of a commit in traversal order of its repository.
COMMITS = (
    "repo STRING, commit_hash STRING, seq BIGINT, author_name STRING, author_email STRING,"
    " committer_date TIMESTAMP, dmm_unit_size DOUBLE, dmm_unit_complexity DOUBLE,"
    " dmm_unit_interfacing DOUBLE"
)

# One row per modified file of a commit; each row counts as one modification.
FILE_CHANGES = (
    "repo STRING, commit_hash STRING, path STRING, old_path STRING, change_type STRING,"
    " added_lines BIGINT, deleted_lines BIGINT, patch STRING"
)

SOURCE_FILES = (
    "repo STRING, commit_hash STRING, committer_date TIMESTAMP, path STRING, content STRING"
)

LINT_MESSAGES = (
    "repo STRING, commit_hash STRING, committer_date TIMESTAMP, module STRING, category STRING,"
    " msg_id STRING, symbol STRING, msg STRING, confidence STRING, path STRING"
)

# Long form of the linter statistics: one row per (commit, dotted key).
LINT_STATS = (
    "repo STRING, commit_hash STRING, committer_date TIMESTAMP, key STRING, value DOUBLE"
)

STAR_EVENTS = "repo STRING, starred_at TIMESTAMP, user_login STRING"

# doc is JSON text at rest; readers turn it into VARIANT.
REPO_METADATA = "repo STRING, doc STRING"

CANONICAL = {
    "repos": REPOS,
    "commits": COMMITS,
    "file_changes": FILE_CHANGES,
    "source_files": SOURCE_FILES,
    "lint_messages": LINT_MESSAGES,
    "lint_stats": LINT_STATS,
    "star_events": STAR_EVENTS,
    "repo_metadata": REPO_METADATA,
}
