"""Nested documents to flat keys and columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def nested_fields(schema: T.StructType, parent: Sequence[str] = ()) -> Iterator[tuple[str, ...]]:
    """Paths of the leaves of a schema; arrays and maps count as leaves."""
    for field in schema.fields:
        path = (*parent, field.name)
        if isinstance(field.dataType, T.StructType):
            yield from nested_fields(field.dataType, path)
        else:
            yield path


def field_at(path: Sequence[str]) -> Column:
    column = F.col(f"`{path[0]}`")
    for name in path[1:]:
        column = column.getField(name)
    return column


def flatten_columns(df: DataFrame) -> DataFrame:
    """One column per leaf of the schema, named by its dotted path."""
    return df.select(*[field_at(p).alias(".".join(p)) for p in nested_fields(df.schema)])


def flatten_document(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows ``(..., key, value)`` for the leaves of a VARIANT document of any depth.

    Lists stay whole, empty objects vanish, nulls stay. One aggregate finds the greatest
    depth when this is called; the plan then opens that many levels.
    """
    keep = [c for c in docs.columns if c != doc]
    deepest = docs.agg(F.max(_depth(doc))).head()[0] or 0
    level = docs.select(*keep, F.lit(None).cast("string").alias("key"), F.col(doc).alias("value"))
    for _ in range(deepest):
        level = _open_objects(level, keep)
    return level


def _depth(doc: str) -> Column:
    """How deep the brackets of a variant's schema nest; at least the depth of its objects."""
    brackets = F.regexp_replace(F.regexp_replace(F.schema_of_variant(doc), "`(?:[^`]|``)*`", ""), "[^<>]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def walk(acc: Column, bracket: Column) -> Column:
        now = acc["now"] + F.when(bracket == "<", 1).when(bracket == ">", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, walk, lambda acc: acc["most"])


def _is_object(value: str) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT<"))


def _open_objects(level: DataFrame, keep: list[str]) -> DataFrame:
    spark = level.sparkSession
    closed = F.when(_is_object("value"), F.col("value"))
    opened = level.withColumn("closed", closed).lateralJoin(
        spark.tvf.variant_explode_outer(F.col("closed").outer()).toDF("pos", "inner_key", "inner_value")
    )
    path = F.when(F.col("key").isNull(), F.col("inner_key")).otherwise(
        F.concat("key", F.lit("."), "inner_key")
    )
    return opened.where(F.col("closed").isNull() | F.col("inner_key").isNotNull()).select(
        *keep,
        F.when(F.col("closed").isNull(), F.col("key")).otherwise(path).alias("key"),
        F.when(F.col("closed").isNull(), F.col("value")).otherwise(F.col("inner_value")).alias("value"),
    )


def empty_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become NULL in every string column."""
    return df.select(
        *[
            F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def ordered(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """``first`` in that order, then the other columns sorted by code point."""
    missing = [c for c in first if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rest = sorted(c for c in df.columns if c not in first)
    return df.select(*[F.col(f"`{c}`") for c in (*first, *rest)])


def column_names(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values of ``column`` for use as column names: those of a short list."""
    return sorted(row[0] for row in df.select(column).distinct().collect())


def utc_timestamp(column: Column) -> Column:
    """Timestamp of a text; NULL where it cannot be read."""
    return F.try_to_timestamp(column)
