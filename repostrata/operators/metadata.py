"""Repository metadata documents and language shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from repostrata.functions.documents import empty_to_null, flatten_columns, ordered, utc_timestamp
from repostrata.functions.keys import kb_to_mb, repo_name

_TEXT, _COUNT, _FLAG = T.StringType(), T.LongType(), T.BooleanType()


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Fields of a metadata document.
DOCUMENT = _record(
    createdAt=_TEXT,
    pushedAt=_TEXT,
    updatedAt=_TEXT,
    archivedAt=_TEXT,
    description=_TEXT,
    forkCount=_COUNT,
    stargazerCount=_COUNT,
    hasDiscussionsEnabled=_FLAG,
    hasIssuesEnabled=_FLAG,
    hasProjectsEnabled=_FLAG,
    hasSponsorshipsEnabled=_FLAG,
    fundingLinks=T.ArrayType(_record(platform=_TEXT)),
    hasWikiEnabled=_FLAG,
    homepageUrl=_TEXT,
    isArchived=_FLAG,
    isEmpty=_FLAG,
    isFork=_FLAG,
    isInOrganization=_FLAG,
    isLocked=_FLAG,
    isMirror=_FLAG,
    isPrivate=_FLAG,
    isTemplate=_FLAG,
    licenseInfo=_record(name=_TEXT, body=_TEXT, description=_TEXT),
    lockReason=_TEXT,
    visibility=_TEXT,
    url=_TEXT,
    owner=_record(login=_TEXT),
    resourcePath=_TEXT,
    diskUsage=_COUNT,
    languages=_record(
        totalSize=_COUNT, edges=T.ArrayType(_record(size=_COUNT, node=_record(name=_TEXT)))
    ),
    primaryLanguage=_record(name=_TEXT),
)
# Fields read as timestamps.
DATE_FIELDS = ("createdAt", "pushedAt", "updatedAt", "archivedAt")


def share_percent(size: Column, total: Column) -> Column:
    """Percent of ``total``, one decimal, half-even."""
    return F.bround(size.cast("double") / total * 100, 1)


def language_list(edges: Column, total: Column) -> Column:
    """``(name, percent)`` pairs; empty when the total is 0 or missing."""
    pairs = F.transform(
        edges,
        lambda e: F.struct(
            e.getField("node").getField("name").alias("name"),
            share_percent(e.getField("size"), total).alias("percent"),
        ),
    )
    return F.when((total > 0) & edges.isNotNull(), pairs).otherwise(F.array().cast("array<struct<name:string,percent:double>>"))


def metadata_table(docs: DataFrame) -> DataFrame:
    """One row per repository: the flattened document with typed dates, sizes in MB and
    language shares. ``doc`` is VARIANT or JSON text."""
    text = F.col("doc") if isinstance(docs.schema["doc"].dataType, T.StringType) else F.to_json("doc")
    parsed = docs.select(F.col("repo").alias("key"), F.from_json(text, DOCUMENT).alias("d"))
    shares = language_list(F.col("d.languages.edges"), F.col("d.languages.totalSize"))
    flat = flatten_columns(
        parsed.select(
            F.coalesce(repo_name(F.col("d.resourcePath")), F.col("key")).alias("repo"),
            *[F.col(f"d.{f.name}").alias(f.name) for f in DOCUMENT.fields if f.name != "languages"],
            shares.alias("languages"),
        )
    )
    typed = flat.withColumns(
        {**{c: utc_timestamp(F.col(c)) for c in DATE_FIELDS}, "diskUsage": kb_to_mb(F.col("diskUsage"))}
    )
    return ordered(empty_to_null(typed), ["repo"])


def language_shares(sizes: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` languages of each repository by size, with their percent of all bytes.

    ``sizes`` holds ``(repo, language, size)``; equal sizes rank by name.
    """
    totals = sizes.groupBy("repo").agg(F.sum("size").alias("total_size"))
    largest = Window.partitionBy("repo").orderBy(F.desc("size"), "language")
    ranked = sizes.withColumn("place", F.row_number().over(largest)).where(F.col("place") <= top)
    return (
        ranked.join(totals, "repo")
        .where(F.col("total_size") > 0)
        .select(
            "repo",
            F.col("place").cast("bigint").alias("place"),
            "language",
            "size",
            share_percent(F.col("size"), F.col("total_size")).alias("percent"),
        )
    )
