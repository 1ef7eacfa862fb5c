"""Writers for result tables and documents."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T

from repostrata.operators.buckets import TARGET, BucketTable
from repostrata.operators.upsert import keep_last, merge, upsert_table

FORMATS = ("csv", "json", "parquet")


def run_name(moment: datetime) -> str:
    """Folder name of a run, to the minute."""
    return moment.strftime("%Y-%m-%d_%H-%M")


def encoded(df: DataFrame) -> DataFrame:
    """Lists, structs, maps and variants as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    return df.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "overwrite") -> None:
    """CSV with a header; missing values are ``nan``, quotes in text are doubled.

    A text may hold line breaks, so a file cannot be split when read: files are cut instead.
    """
    ordered = encoded(df).orderBy(*order) if order else encoded(df)
    ordered.write.mode(mode).option("maxRecordsPerFile", 1_000_000).csv(
        path, header=True, nullValue="nan", emptyValue="", quote='"', escape='"'
    )


def write_documents(df: DataFrame, path: str, key: str = "repo", mode: str = "overwrite") -> None:
    """JSON lines ``{"repo": ..., "doc": {...}}``, one document per row."""
    rest = [F.col(f"`{c}`").alias(c) for c in df.columns if c != key]
    df.select(F.col(key), F.struct(*rest).alias("doc")).write.mode(mode).option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ssXXX"
    ).json(path)


def update_documents(docs: DataFrame, path: str, key: str = "repo", buckets: int = 4, target: int = TARGET) -> None:
    """Put ``(repo, doc VARIANT)`` rows into a stored folder of JSON lines.

    A new document replaces the old one of its repository as a whole. Only the buckets of the
    new keys are rewritten; ``read_documents`` reads such a folder. Of several new documents
    of one key one stays, the last by its text.
    """
    table = BucketTable(docs.sparkSession, path, (key,), "json", buckets, target)
    new = keep_last(docs.select(key, "doc", F.to_json("doc").alias("__text")), [key], ["__text"]).drop("__text")
    table.commit(new, lambda old, rows: merge(old, rows, [key]))


def write_outputs(
    tables: dict[str, DataFrame], path: str, run_ts: str, formats: Sequence[str] = ("csv",)
) -> dict[str, str]:
    """Write every table in every format below ``path/run_ts``; returns the folders."""
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    written = {}
    for name, df in tables.items():
        order = [c for c in ("repo", "date") if c in df.columns]
        for kind in formats:
            target = written[f"{name}.{kind}"] = f"{path.rstrip('/')}/{run_ts}/{name}.{kind}"
            if kind == "csv":
                write_csv(df, target, order)
            elif kind == "json" and "repo" in df.columns:
                write_documents(df, target)
            elif kind == "json":
                df.write.mode("overwrite").json(target)
            else:
                df.write.mode("overwrite").parquet(target)
    return written


# What makes a row of each result table of ``analyze`` unique.
RESULT_KEYS = {
    "git": ("repo",),
    "git_developers": ("repo", "position"),
    "lint_rows": ("repo", "commit_hash", "key"),
    "lint": ("repo", "commit_hash"),
    "test": ("repo", "commit_hash"),
    "star_growth": ("repo", "date"),
    "metadata": ("repo",),
}


def upsert_outputs(tables: dict[str, DataFrame], path: str, buckets: int = 4) -> dict[str, str]:
    """Merge every result of ``analyze`` into its stored table below ``path``; returns the folders.

    A repeated run replaces the rows with its keys and leaves all others; see ``upsert_table``.
    The wide star table, whose columns are repositories, is kept as ``star_growth`` rows only.
    """
    written = {}
    for name, keys in RESULT_KEYS.items():
        if name in tables:
            written[name] = f"{path.rstrip('/')}/{name}"
            upsert_table(tables[name], written[name], keys, buckets=buckets)
    return written
