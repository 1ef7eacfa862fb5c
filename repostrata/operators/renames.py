"""File identity through renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repostrata.operators.prefix import running
from repostrata.session import pinned


def _next_rename(points: DataFrame, edges: DataFrame) -> DataFrame:
    """For each point ``(repo, path, seq, ...)`` the earliest later rename of its path.

    Points and renames are merged in descending ``seq``; the latest rename already seen
    is then the answer. At equal ``seq`` a point sorts first, so only strictly later
    renames match. No pair of rows is ever formed.
    """
    rest = [c for c in points.columns if c not in ("repo", "path", "seq")]
    target = F.struct(F.col("seq"), F.col("old_path").alias("path"), F.col("new_path"))
    merged = points.select(
        "repo", "path", (-F.col("seq")).alias("back"), F.lit(0).alias("kind"),
        F.lit(None).cast(edges.select(target.alias("t")).schema["t"].dataType).alias("rename"), *rest,
    ).unionByName(
        edges.select(
            "repo", F.col("old_path").alias("path"), (-F.col("seq")).alias("back"),
            F.lit(1).alias("kind"), target.alias("rename"),
            *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in rest],
        )
    )
    found = running(merged, ["repo", "path"], ["back", "kind"], lasts={"next": "rename"})
    return found.where(F.col("kind") == 0).select(
        "repo", "path", (-F.col("back")).alias("seq"), *rest, "next"
    )


def unique_edges(edges: DataFrame) -> DataFrame:
    """One rename per (repo, old path, commit): the one to the smallest new path."""
    return edges.groupBy("repo", "old_path", "seq").agg(F.min("new_path").alias("new_path"))


def canonical_paths(edges: DataFrame) -> DataFrame:
    """Final path of every rename ``(repo, old_path, new_path, seq)``, one per path and commit.

    A chain follows later renames only, so it ends. Pointer jumping doubles the reach of
    each round: a chain of length L takes log2(L) joins, run when this is called. Only
    renames that have a successor are joined.
    """
    edges = pinned(unique_edges(edges))
    ends = edges.select("repo", F.col("new_path").alias("path"), "seq", F.col("old_path").alias("start"))
    hops = pinned(
        _next_rename(ends, edges).select(
            "repo",
            F.col("start").alias("old_path"),
            "seq",
            F.col("path").alias("final_path"),
            F.col("next.seq").alias("next_seq"),
            F.col("next.path").alias("next_path"),
        )
    )
    while not (going := hops.where(F.col("next_seq").isNotNull())).isEmpty():
        ahead = hops.select(
            "repo",
            F.col("old_path").alias("next_path"),
            F.col("seq").alias("next_seq"),
            F.col("final_path").alias("a_final"),
            F.col("next_seq").alias("a_next_seq"),
            F.col("next_path").alias("a_next_path"),
        )
        moved = going.join(ahead, ["repo", "next_path", "next_seq"]).select(
            "repo",
            "old_path",
            "seq",
            F.col("a_final").alias("final_path"),
            F.col("a_next_seq").alias("next_seq"),
            F.col("a_next_path").alias("next_path"),
        )
        hops = pinned(hops.where(F.col("next_seq").isNull()).unionByName(moved))
    return hops.select("repo", "old_path", "seq", "final_path")


def apply_renames(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """File changes (with ``seq`` of their commit) under the final name of their file.

    One row out for each row in. Few paths are ever renamed: only their changes look for
    the next rename, all others pass by.
    """
    edges = pinned(unique_edges(edges))
    paths = edges.select("repo", F.col("old_path").alias("path")).distinct()
    finals = canonical_paths(edges).select(
        "repo", F.col("old_path").alias("next_path"), F.col("seq").alias("next_seq"), "final_path"
    )
    renamed = changes.join(paths, ["repo", "path"], "left_semi")
    following = _next_rename(renamed, edges).select(
        "*", F.col("next.path").alias("next_path"), F.col("next.seq").alias("next_seq")
    )
    last = following.where(F.col("next_seq").isNull())
    moved = following.where(F.col("next_seq").isNotNull()).join(finals, ["repo", "next_path", "next_seq"])
    return (
        changes.join(paths, ["repo", "path"], "left_anti")
        .unionByName(last.select(*changes.columns))
        .unionByName(moved.withColumn("path", F.col("final_path")).select(*changes.columns))
    )
