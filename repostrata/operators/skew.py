"""Joins of many rows with one row per key, where a key may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def join_lookup(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], fan_in: str, chunk: int = 1_000_000
) -> DataFrame:
    """Inner join of ``facts`` with ``lookup``, which has one row per key.

    ``fan_in`` names the lookup column that counts the facts of the key. Every key with more
    than ``chunk`` facts is split into salted pieces of about that many. There are at most
    ``facts / chunk`` such keys; whether their list is broadcast is left to adaptive
    execution, which knows its size. Facts should differ within a key: a piece is chosen by
    a hash of the whole row.
    """
    keys = list(keys)
    pieces = F.ceil(F.col(fan_in) / chunk)
    hot = lookup.where(F.col(fan_in) > chunk).select(*keys, pieces.alias("__pieces"))
    salt = F.pmod(F.xxhash64(*facts.columns), F.coalesce("__pieces", F.lit(1)))
    salted = facts.join(hot, keys, "left").withColumn("__salt", salt).drop("__pieces")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(pieces, F.lit(1)) - 1))
    return salted.join(lookup.withColumn("__salt", copies), [*keys, "__salt"]).drop("__salt")
