"""Readers for the canonical tables and for documents written by earlier runs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from repostrata.functions.documents import flatten_document, utc_timestamp
from repostrata.functions.filters import IGNORED_DIRECTORIES, IGNORED_PREFIXES
from repostrata.functions.keys import clean_url
from repostrata.operators.buckets import BucketTable
from repostrata.schemas import CANONICAL
from repostrata.sources.keyed_json import BLOCK, read_members
from repostrata.sources.tree import SourceTree, with_content

# Field names of stored star documents.
STAR_EDGES = (
    "data STRUCT<repository: STRUCT<stargazers: STRUCT<edges:"
    " ARRAY<STRUCT<cursor: STRING, starredAt: STRING, node: STRUCT<login: STRING>>>>>>"
)


def read_canonical(spark: SparkSession, name: str, path: str, source: str = "parquet") -> DataFrame:
    """A canonical table in its fixed schema."""
    return spark.read.format(source).schema(CANONICAL[name]).load(path)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """Repository URLs, one per line; blank lines are dropped."""
    return spark.read.text(path).select(clean_url(F.col("value")).alias("repo_url")).where(F.col("repo_url") != "")


def read_source_tree(
    spark: SparkSession,
    root: str,
    commit_hash: str,
    committer_date: str,
    deny: Sequence[str] = IGNORED_DIRECTORIES,
    prefixes: Sequence[str] = IGNORED_PREFIXES,
    depth: str = "root",
) -> DataFrame:
    """Analysed Python files below ``root/<repo>/`` as ``source_files`` of one commit.

    Left out directories (see ``python_sources``) are never listed or opened. Folders are
    listed in tasks; the files found are dealt out anew, so that reading them is balanced
    whatever the shape of the tree. Files that are not UTF-8 have NULL content. ``root`` is a
    local folder or a store that Arrow can read.
    """
    spark.dataSource.register(SourceTree)
    tasks = spark.sparkContext.defaultParallelism
    found = (
        spark.read.format(SourceTree.name())
        .options(deny=json.dumps(list(deny)), prefixes="".join(prefixes), depth=depth, partitions=4 * tasks)
        .load(root.rstrip("/"))
    )
    dealt = found.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "repo", "path")
    return with_content(dealt, root).select(
        "repo",
        F.lit(commit_hash).alias("commit_hash"),
        F.lit(committer_date).cast("timestamp").alias("committer_date"),
        "path",
        F.try_validate_utf8(F.col("content").cast("string")).alias("content"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"repo": ..., "doc": {...}}`` as ``(repo, doc VARIANT)``, plain or stored in buckets."""
    stored = BucketTable(spark, path).read()
    if stored is not None:
        return stored
    return spark.read.schema("repo STRING, doc VARIANT").json(path)


def read_keyed_json(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """One object ``{repo: document}`` of any layout as ``(repo, doc VARIANT)``.

    The file is cut into blocks of ``block`` bytes wherever that falls; see ``read_members``.
    """
    return read_members(spark, path, block).select(F.col("key").alias("repo"), "doc")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table written by ``write_csv``; ``nan`` is a missing value. Text may hold line breaks."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="nan", multiLine=True, quote='"', escape='"')


def star_events_of(docs: DataFrame) -> DataFrame:
    """Star events of stargazer documents ``(repo, doc)``; incomplete edges are dropped."""
    text = F.col("doc") if dict(docs.dtypes)["doc"] == "string" else F.to_json("doc")
    edges = docs.select("repo", F.explode(F.from_json(text, STAR_EDGES)["data"]["repository"]["stargazers"]["edges"]).alias("edge"))
    return edges.select(
        "repo", utc_timestamp(F.col("edge.starredAt")).alias("starred_at"), F.col("edge.node.login").alias("user_login")
    ).where(F.col("user_login").isNotNull() & F.col("starred_at").isNotNull())


def lint_stats_of(docs: DataFrame) -> DataFrame:
    """Numeric statistics of lint documents ``(repo, doc {commit: {date, stats, ...}})``."""
    commits = docs.lateralJoin(
        docs.sparkSession.tvf.variant_explode(F.col("doc").outer()).toDF("pos", "commit_hash", "commit")
    ).select(
        "repo",
        "commit_hash",
        utc_timestamp(F.try_variant_get("commit", "$.date", "string")).alias("committer_date"),
        F.try_variant_get("commit", "$.stats", "variant").alias("doc"),
    )
    flat = flatten_document(commits)
    return flat.select(
        "repo", "commit_hash", "committer_date", F.concat(F.lit("stats."), "key").alias("key"),
        F.try_variant_get("value", "$", "double").alias("value"),
    ).where(F.col("value").isNotNull())
