"""Registered queries: each operator over the whole test tables.

Outputs hold numbers and text only: lists are joined, dates are formatted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repostrata.functions import filters, keys
from repostrata.functions.documents import column_names, flatten_document
from repostrata.operators import (
    complexity, diffs, history, lint, metadata, ownership, renames, stars, stats, testcode, upsert,
)
from repostrata.plans import tables
from repostrata.plans.api import analyze, run
from repostrata.session import file_system, pinned, scratch_path, tune
from repostrata.sources import readers, writers
from repostrata.sources.adapters import TestTables
from repostrata.sources.rawstore import RawStore, stargazer_documents, stat_lists
from repostrata.streaming.refresh import growth_stream, upsert_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(build: Callable[[TestTables], DataFrame]) -> Callable[[TestTables], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return build(TestTables(tune(spark), folder))

    QUERIES[build.__name__] = query
    return build


SPREAD = 8  # bytes that shuffles of all lint messages move per stored byte of the tables, at most


def spread(t: TestTables) -> TestTables:
    """Let the number of shuffle partitions grow with the tables, so that a task's share of them does not."""
    files, place = file_system(t.spark, t.folder)
    tune(t.spark, SPREAD * files.getContentSummary(place).getLength())
    return t


def text_of(column: str) -> Column:
    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss").alias(column)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Floating sums depend on row order in the last digits."""
    return df.select(
        *[
            F.round(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


# -- names, sizes, paths ------------------------------------------------------------


@registered
def url_keys(t: TestTables) -> DataFrame:
    url = keys.clean_url(F.col("url"))
    return t.raw("pages").select(
        "page_id",
        url.alias("clean"),
        keys.repo_name(url).alias("name"),
        keys.repo_name(F.concat(url, F.lit(".github.git/")), legacy=True).alias("legacy_name"),
        keys.repo_owner(url).alias("owner"),
        keys.repo_path(url, "/srv/repos").alias("repo_path"),
        keys.relative_path(F.concat(F.lit("/srv/repos/"), url), "/srv/repos").alias("relative"),
    )


@registered
def url_list(t: TestTables) -> DataFrame:
    """URLs written one per line with stray blanks, slashes and empty lines, read back."""
    path = scratch_path(t.spark, "urls")
    t.raw("pages").select(F.concat(F.lit("  "), "url", F.lit("/ \n"))).write.text(path)
    return readers.read_urls(t.spark, path)


@registered
def size_format(t: TestTables) -> DataFrame:
    kb = F.floor(F.col("o_totalprice") * 10)
    return t.raw("orders").select(
        "o_orderkey", kb.alias("kb"), keys.kb_to_mb(kb).alias("mb"),
        keys.size_text(kb).alias("text"), keys.size_text(F.col("o_custkey")).alias("small_text"),
    )


@registered
def path_filters(t: TestTables) -> DataFrame:
    path = F.col("path")
    flags = {
        "is_python": filters.is_python(path),
        "denied_root": filters.in_denied_directory(path),
        "denied_any": filters.in_denied_directory(path, depth="any"),
        "prefixed": filters.in_prefixed_directory(path),
        "lint_ignored": filters.lint_ignored(path),
    }
    return t.source_files().select("path", *[f.cast("bigint").alias(n) for n, f in flags.items()])


@registered
def python_sources(t: TestTables) -> DataFrame:
    return filters.python_sources(t.source_files()).groupBy("repo").agg(F.count(F.lit(1)).alias("files"))


# -- history ------------------------------------------------------------------------


@registered
def commit_files(t: TestTables) -> DataFrame:
    changes = t.file_changes().select("repo", "commit_hash", "path", "added_lines")
    return history.commit_files(t.commits(), changes).groupBy("repo").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("path").isNull()).alias("commits_without_files")
    )


@registered
def repo_totals(t: TestTables) -> DataFrame:
    return history.repo_totals(t.commits(), t.file_changes())


@registered
def developers(t: TestTables) -> DataFrame:
    return history.developers(t.commits())


@registered
def developer_lists(t: TestTables) -> DataFrame:
    """All names, in lists of seven."""
    return history.developer_lists(t.commits(), size=7).withColumn("developers", F.array_join("developers", "|"))


@registered
def dmm_means(t: TestTables) -> DataFrame:
    return history.dmm_means(t.commits())


@registered
def dmm_means_with_zero(t: TestTables) -> DataFrame:
    return history.dmm_means(t.commits(), include_zero=True)


@registered
def file_lines(t: TestTables) -> DataFrame:
    return history.file_lines(t.file_changes())


@registered
def file_churn(t: TestTables) -> DataFrame:
    return history.file_churn(t.file_changes())


@registered
def file_churn_sum(t: TestTables) -> DataFrame:
    return history.file_churn(t.file_changes(), mode="sum")


@registered
def change_set(t: TestTables) -> DataFrame:
    return history.change_set(t.commits(), t.file_changes())


@registered
def ownership_per_file(t: TestTables) -> DataFrame:
    return ownership.file_ownership(t.file_changes(), author="author_id")


@registered
def ownership_means(t: TestTables) -> DataFrame:
    return rounded(ownership.ownership_means(ownership.file_ownership(t.file_changes(), author="author_id", minor=0.01)))


@registered
def patch_stats(t: TestTables) -> DataFrame:
    return diffs.diff_stats(t.patches()).drop("repo")


@registered
def hunks_from_patch(t: TestTables) -> DataFrame:
    return diffs.file_hunks(diffs.diff_stats(t.patches()))


@registered
def hunk_means(t: TestTables) -> DataFrame:
    return rounded(diffs.hunk_means(diffs.file_hunks(diffs.diff_stats(t.patches()))))


@registered
def commit_entropy(t: TestTables) -> DataFrame:
    return rounded(complexity.commit_entropy(t.file_changes()))


@registered
def history_complexity(t: TestTables) -> DataFrame:
    return rounded(complexity.history_complexity(t.file_changes()))


@registered
def rename_identity(t: TestTables) -> DataFrame:
    return renames.canonical_paths(t.rename_edges())


@registered
def churn_with_tied_renames(t: TestTables) -> DataFrame:
    """As below, when every rename is recorded a second time with another, larger target."""
    edges = t.rename_edges()
    tied = edges.unionByName(edges.withColumn("new_path", F.col("new_path") + 100))
    return history.file_churn(renames.apply_renames(t.moved_changes(), tied))


@registered
def churn_across_renames(t: TestTables) -> DataFrame:
    return history.file_churn(renames.apply_renames(t.moved_changes(), t.rename_edges()))


@registered
def git_table(t: TestTables) -> DataFrame:
    return rounded(
        tables.git_table(t.commits(), t.file_changes(), t.repos(), t.nation_patches(), author="author_id")
    )


@registered
def git_table_window(t: TestTables) -> DataFrame:
    table = tables.git_table(
        t.commits(), t.file_changes(), since="1996-01-01", to="2000-06-30", author="author_id", churn_mode="sum"
    )
    return rounded(table.drop("average_hunks", "repo_url"))


# -- lint ---------------------------------------------------------------------------


@registered
def lint_rollup(t: TestTables) -> DataFrame:
    return lint.message_counts(spread(t).lint_messages())


@registered
def mccabe(t: TestTables) -> DataFrame:
    return lint.mccabe(spread(t).lint_messages())


@registered
def lint_long(t: TestTables) -> DataFrame:
    named = lint.with_ids(spread(t).lint_stats(), t.message_ids())
    return lint.table_keys(named).groupBy("repo", "key").agg(F.sum("value").alias("value"))


@registered
def lint_unknown_symbols(t: TestTables) -> DataFrame:
    return lint.unknown_symbols(t.lint_stats(), t.message_ids())


@registered
def lint_wide(t: TestTables) -> DataFrame:
    # The columns are known beforehand: one per message id of the linter.
    ids = spread(t).message_ids().select(F.concat("msg_id", F.lit("."), "symbol").alias("key"))
    names = column_names(ids, "key")
    table = tables.lint_table(t.lint_stats(), t.lint_messages(), t.message_ids(), [*names, "node_count.function"])
    plain = {c: c.replace(".", "_").replace("-", "_") for c in table.columns}
    return table.select(
        *[text_of("date") if c == "date" else F.col(f"`{c}`").alias(name) for c, name in plain.items()]
    )


# -- test code ----------------------------------------------------------------------


@registered
def test_statements(t: TestTables) -> DataFrame:
    found = testcode.classify(filters.python_sources(t.source_files()))
    lists = ("imports", "unittest_classes", "pytest_functions")
    return found.select(
        "repo", "commit_hash", "path", F.col("parsed").cast("bigint").alias("parsed"),
        *[F.array_join(c, ",").alias(c) for c in lists], "production_statements", "test_statements",
    )


@registered
def test_ratio(t: TestTables) -> DataFrame:
    found = testcode.commit_statements(testcode.classify(filters.python_sources(t.source_files())))
    return found.drop("committer_date")


@registered
def test_table(t: TestTables) -> DataFrame:
    return tables.test_table(t.source_files()).select(
        "repo", "commit_hash", text_of("date"), "test_classes",
        F.array_join("test_frameworks", ",").alias("test_frameworks"), "test_functions", "test_to_code_ratio",
    )


@registered
def unparsable_sources(t: TestTables) -> DataFrame:
    return testcode.unparsable(testcode.classify(t.document_sources())).select("repo", "commit_hash", "path")


# -- stars --------------------------------------------------------------------------


@registered
def star_numbers(t: TestTables) -> DataFrame:
    return stars.star_numbers(t.star_events()).select("repo", text_of("starred_at"), "user_login", "star_number")


@registered
def star_documents(t: TestTables) -> DataFrame:
    """Stars written as documents in parts of 500 edges, read back as events."""
    documents = stargazer_documents(t.star_events().withColumn("user_login", F.col("user_login").cast("string")), 500)
    events = readers.star_events_of(documents.withColumnRenamed("data", "doc"))
    return events.select("repo", text_of("starred_at"), F.col("user_login").cast("bigint").alias("user_login"))


@registered
def stars_long(t: TestTables) -> DataFrame:
    return stars.growth_long(t.star_events()).select("repo", text_of("date"), "stargazers_count")


@registered
def stars_wide(t: TestTables) -> DataFrame:
    names = t.event_types()
    return tables.stargazers_table(t.star_events(), names).select(text_of("date"), *names)


@registered
def stars_grid(t: TestTables) -> DataFrame:
    return stars.growth_grid(t.star_events(), t.event_types()).select("repo", text_of("date"), "stargazers_count")


# -- metadata -----------------------------------------------------------------------


@registered
def metadata_table(t: TestTables) -> DataFrame:
    table = metadata.metadata_table(t.repo_metadata())
    return table.select(
        "repo", text_of("createdAt"), "description", "diskUsage", "stargazerCount", "forkCount",
        F.to_json("languages").alias("languages"), F.col("`licenseInfo.name`").alias("license_name"), "resourcePath",
    )


@registered
def metadata_flat(t: TestTables) -> DataFrame:
    docs = t.repo_metadata().withColumn("doc", F.parse_json("doc"))
    return flatten_document(docs).select("repo", "key", F.to_json("value").alias("value"))


@registered
def language_shares(t: TestTables) -> DataFrame:
    return metadata.language_shares(t.language_bytes(), top=3)


# -- upserts ------------------------------------------------------------------------


@registered
def upsert_last(t: TestTables) -> DataFrame:
    return upsert.keep_last(t.updates(), ["repo", "day"], ["batch"]).select("repo", text_of("day"), "batch", "value")


@registered
def upsert_merge(t: TestTables) -> DataFrame:
    """Existing rows without the value column, then the same keys with it."""
    merged = upsert.merge(t.updates().drop("value"), t.updates(), ["repo", "day"], ["batch"])
    return merged.select("repo", text_of("day"), "batch", "value")


@registered
def upsert_table(t: TestTables) -> DataFrame:
    """Two upserts of the same rows into one stored table."""
    path = scratch_path(t.spark, "upsert")
    for _ in range(2):
        upsert.upsert_table(t.updates(), path, ["repo", "day"], ["batch"], buckets=8)
    return upsert.read_table(t.spark, path).select("repo", text_of("day"), "batch", "value")


@registered
def stream_upsert(t: TestTables) -> DataFrame:
    path = scratch_path(t.spark, "stream")
    arriving = (
        t.spark.readStream.schema(t.raw("events").schema)
        .parquet(f"{t.folder}/events*.parquet")
        .selectExpr("user_id as repo", "cast(ts as date) as day", "event_id as batch", "value")
    )
    upsert_stream(arriving, path, f"{path}-progress", ["repo", "day"], ["batch"], buckets=8).awaitTermination()
    return upsert.read_table(t.spark, path).select("repo", text_of("day"), "batch", "value")


@registered
def stars_stream(t: TestTables) -> DataFrame:
    """Star growth kept up to date over four files, each with stars of all days."""
    source, path = scratch_path(t.spark, "stars"), scratch_path(t.spark, "growth")
    events = pinned(t.raw("events").withColumn("file", F.col("event_id") % 4))
    for file in range(4):
        events.where(F.col("file") == file).drop("file").coalesce(1).write.mode("append").parquet(source)
    arriving = (
        t.spark.readStream.schema(events.drop("file").schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(source)
        .selectExpr("event_type as repo", "cast(date_trunc('hour', ts) as timestamp) as starred_at", "user_id as user_login")
    )
    growth_stream(arriving, path, f"{path}-progress").awaitTermination()
    return upsert.read_table(t.spark, path).select("repo", text_of("date"), "stargazers_count")


def _results(t: TestTables) -> dict[str, DataFrame]:
    facts = {
        "commits": t.commits(), "file_changes": t.file_changes(), "lint_stats": t.lint_stats(),
        "lint_messages": t.lint_messages(), "message_ids": t.message_ids(), "star_events": t.star_events(),
    }
    return analyze(facts, ["git", "lint", "stars"], author="author_id")


@registered
def analyze_all(t: TestTables) -> DataFrame:
    """Rows of each result table of several analyses, and the sum of what they count."""
    counted = {
        "git": F.col("total_commits"), "git_developers": F.col("position"), "star_growth": F.col("stargazers_count"),
        "lint_rows": F.when(F.col("key") != "avg_mccabe_complexity", F.col("value")),
    }
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.sum(counted[name].cast("double")).alias("total"))
        .select(F.lit(name).alias("result"), "rows", "total")
        for name, df in _results(t).items()
    ]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found


@registered
def outputs_upsert(t: TestTables) -> DataFrame:
    """Star growth stored twice, the second time with one more than counted, and read back."""
    path = scratch_path(t.spark, "outputs")
    growth = stars.growth_long(t.star_events())
    writers.upsert_outputs({"star_growth": growth}, path, buckets=4)
    later = growth.where("repo <> 'click'").withColumn("stargazers_count", F.col("stargazers_count") + 1)
    written = writers.upsert_outputs({"star_growth": later}, path, buckets=4)
    return upsert.read_table(t.spark, written["star_growth"]).select("repo", text_of("date"), "stargazers_count")


@registered
def new_repositories(t: TestTables) -> DataFrame:
    incoming = t.raw("orders").select(F.col("o_orderkey").alias("repo"))
    existing = t.raw("customer").select(F.col("c_custkey").alias("repo"))
    return upsert.new_keys(incoming, existing, "repo")


# -- sinks --------------------------------------------------------------------------


@registered
def csv_round_trip(t: TestTables) -> DataFrame:
    """Numbers, missing values, and texts with line breaks, commas, quotes and a list."""
    path = scratch_path(t.spark, "csv")
    table = history.file_lines(t.file_changes()).withColumns(
        {
            "none": F.nullif(F.col("path"), F.lit(0)),
            "note": F.concat(F.col("repo"), F.lit(':\n"line, two"\\'), F.col("path")),
            "list": F.array("repo", F.concat(F.lit('a "b", '), "path")),
        }
    )
    writers.write_csv(table, path, ["repo", "path"])
    schema = "repo STRING, path BIGINT, added BIGINT, removed BIGINT, avg_added DOUBLE, none BIGINT, note STRING, list STRING"
    return readers.read_csv(t.spark, path, schema)


@registered
def json_round_trip(t: TestTables) -> DataFrame:
    """Upsert documents by repository, write them as JSON lines, read and flatten them."""
    path = scratch_path(t.spark, "json")
    old = t.repo_metadata().withColumn("doc", F.lit("{}"))
    docs = upsert.merge(old, t.repo_metadata(), ["repo"])
    writers.write_documents(docs.select("repo", F.from_json("doc", metadata.DOCUMENT).alias("meta")), path)
    flat = flatten_document(readers.read_documents(t.spark, path))
    return flat.where(F.col("key") == "meta.diskUsage").select(
        "repo", F.try_variant_get("value", "$", "bigint").alias("disk_usage")
    )


RUN = "2024-01-01_00-00"


def _stored(t: TestTables, max_rows: int = 10_000) -> RawStore:
    return RawStore(t.spark, scratch_path(t.spark, "raw"), max_rows)


@registered
def keyed_json(t: TestTables) -> DataFrame:
    """Documents in one object per file, compact or spread over lines, cut into blocks of 700 bytes."""
    path = scratch_path(t.spark, "keyed")
    member = F.concat(F.to_json(F.array("repo")), F.lit(" :"), F.regexp_replace("doc", ",", ",\n  "))
    key = F.regexp_replace(member, r"^\[(.*?)\] :", "$1 :")
    objects = t.repo_metadata().select((F.xxhash64("repo") % 5).alias("part"), key.alias("member")).groupBy("part")
    whole = F.concat(F.lit("{\n"), F.array_join(F.collect_list("member"), ","), F.lit("}"))
    objects.agg(whole.alias("value")).select("value").repartition(3).write.option("lineSep", "\n\n").text(path)
    for_each = readers.read_keyed_json(t.spark, path, 700)
    value = lambda name, kind: F.try_variant_get("doc", f"$.{name}", kind)
    return for_each.select("repo", value("diskUsage", "bigint").alias("disk_usage"), value("resourcePath", "string").alias("path"))


@registered
def raw_store(t: TestTables) -> DataFrame:
    """Lint commits of a run, read back: messages in the totals of each commit."""
    store = _stored(spread(t))
    store.append_lints(t.lint_messages(), stat_lists(t.lint_stats()), RUN)
    totals = store.lint_counts(RUN, modules_only=True).groupBy("repo", "commit_hash").agg(F.sum("messages").alias("messages"))
    return totals.withColumnsRenamed({"repo": "repository_name", "commit_hash": "hash"})


@registered
def raw_lint_totals(t: TestTables) -> DataFrame:
    """Totals of commits whose entries are cut into parts of about three."""
    store = _stored(spread(t), max_rows=3)
    store.append_lints(t.lint_messages(), stat_lists(t.lint_stats()), RUN)
    return store.lint_counts(RUN).drop("run_ts")


@registered
def raw_lint_messages(t: TestTables) -> DataFrame:
    """Messages of two runs, the older one read back."""
    store, stats = _stored(spread(t)), stat_lists(t.lint_stats())
    for name, messages in ((RUN, t.lint_messages()), ("2024-01-01_00-01", t.lint_messages().where("msg_id = 'R2'"))):
        store.append_lints(messages, stats, name)
    found = store.lint_messages(RUN)
    return found.select("repo", "commit_hash", text_of("committer_date"), "module", "category", "msg_id", "symbol", "msg", "path")


@registered
def raw_classified_files(t: TestTables) -> DataFrame:
    """Statements per file after a run with raw output, read back."""
    path = scratch_path(t.spark, "run")
    written = run({"source_files": t.source_files()}, path, RUN, ["test"], ["raw"])
    files = RawStore(t.spark, written["raw"]).classified_files("latest")
    lists = ("imports", "unittest_classes", "pytest_functions")
    return files.select(
        "repo", "commit_hash", "path", *[F.array_join(c, ",").alias(c) for c in lists], "production_statements", "test_statements"
    )


@registered
def raw_git_table(t: TestTables) -> DataFrame:
    """The git table after a run with raw output, read back."""
    facts = {"commits": t.commits(), "file_changes": t.file_changes()}
    written = run(facts, scratch_path(t.spark, "run"), RUN, ["git"], ["raw"], author="author_id")
    kinds = {"total_commits": "bigint", "developer_count": "bigint", "lines_added": "bigint", "change_set_max": "bigint",
             "average_history_complexity": "double", "average_contributor_experience": "double"}
    rows = RawStore(t.spark, written["raw"]).git_rows(", ".join(f"{n} {k}" for n, k in kinds.items()), "latest")
    return rounded(rows.drop("run_ts"))


@registered
def raw_star_events(t: TestTables) -> DataFrame:
    """Star events after a run with raw output, read back."""
    events = t.star_events().withColumn("user_login", F.col("user_login").cast("string"))
    written = run({"star_events": events}, scratch_path(t.spark, "run"), RUN, ["stars"], ["raw"])
    found = RawStore(t.spark, written["raw"]).star_events(RUN)
    return found.select("repo", text_of("starred_at"), F.col("user_login").cast("bigint").alias("user_login"))


@registered
def document_updates(t: TestTables) -> DataFrame:
    """A document per order in a store of eight buckets; one in a hundred is replaced, a few are new."""
    path = scratch_path(t.spark, "documents")
    orders = t.raw("orders").withColumn("repo", F.col("o_orderkey").cast("string"))
    first = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status")))
    second = F.to_json(F.struct(F.lit("changed").alias("status"), F.struct(F.col("o_orderkey").alias("key")).alias("more")))
    changed = orders.where("o_orderkey % 100 = 7").unionByName(
        orders.where("o_orderkey % 1000 = 1").withColumn("repo", F.concat(F.lit("new"), "repo"))
    )
    for rows, text in ((orders, first), (changed, second)):
        writers.update_documents(rows.select("repo", F.parse_json(text).alias("doc")), path, buckets=8)
    value = lambda name, kind: F.try_variant_get("doc", f"$.{name}", kind)
    return readers.read_documents(t.spark, path).select(
        "repo", value("status", "string").alias("status"), value("customer", "bigint").alias("customer"),
        value("more.key", "bigint").alias("key"),
    )


@registered
def stream_replay(t: TestTables) -> DataFrame:
    """Four files in four micro-batches, of which the second is replayed after the last.

    Nothing but the batch ranks rows: each file has one row per key, and the last file wins.
    """
    source, path = scratch_path(t.spark, "arriving"), scratch_path(t.spark, "replayed")
    events = t.raw("events").withColumn("file", F.col("event_id") % 4)
    rows = events.groupBy("file", F.col("user_id").alias("repo"), F.col("ts").cast("date").alias("day")).agg(
        F.max("event_id").alias("batch"), F.max_by("value", "event_id").alias("value")
    )
    rows = pinned(rows)
    for file in range(4):
        rows.where(F.col("file") == file).drop("file").coalesce(1).write.mode("append").parquet(source)
    arriving = t.spark.readStream.schema(rows.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(source)
    checkpoint = f"{path}-progress"
    upsert_stream(arriving, path, checkpoint, ["repo", "day"], []).awaitTermination()
    upsert.upsert_table(rows.where("file = 1").drop("file"), path, ["repo", "day"], batch=(checkpoint, 1))
    return upsert.read_table(t.spark, path).select("repo", text_of("day"), "batch", "value")


@registered
def growing_table(t: TestTables) -> DataFrame:
    """Rows upserted in three lots into a table whose buckets split past 8 KB."""
    path = scratch_path(t.spark, "growing")
    for lot in range(3):
        upsert.upsert_table(
            t.updates().where(F.col("batch") % 3 == lot), path, ["repo", "day"], ["batch"], buckets=1, target=8192
        )
    return upsert.read_table(t.spark, path).select("repo", text_of("day"), "batch", "value")


# -- statistics ---------------------------------------------------------------------

_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@registered
def describe_metric(t: TestTables) -> DataFrame:
    return rounded(stats.describe(t.raw("lineitem"), _METRICS), 6)


@registered
def boxplot_stats(t: TestTables) -> DataFrame:
    return rounded(stats.boxplot(t.raw("lineitem"), _METRICS), 6)


@registered
def average_rank(t: TestTables) -> DataFrame:
    return stats.average_rank(t.raw("lineitem"), "l_quantity")


def _sizes_and_stars(t: TestTables) -> DataFrame:
    sizes = t.language_bytes().groupBy("repo").agg(F.sum("size").alias("size"))
    return sizes.join(metadata.metadata_table(t.repo_metadata()), "repo").select("repo", "size", "stargazerCount")


@registered
def git_meta_join(t: TestTables) -> DataFrame:
    return _sizes_and_stars(t)


@registered
def first_rows(t: TestTables) -> DataFrame:
    """The first five rows in order, as a preview."""
    return _sizes_and_stars(t).orderBy("repo").limit(5)


@registered
def pearson(t: TestTables) -> DataFrame:
    return rounded(stats.pearson(t.raw("lineitem"), "l_quantity", "l_extendedprice").drop("p_value"))


@registered
def spearman(t: TestTables) -> DataFrame:
    return rounded(stats.spearman(t.raw("lineitem"), "l_quantity", "l_extendedprice").drop("p_value"))


@registered
def correlation_words(t: TestTables) -> DataFrame:
    """Strength and direction of a rank correlation in words."""
    found = stats.spearman(t.raw("lineitem"), "l_quantity", "l_discount").select("n", "coefficient")
    words = {"strength": stats.strength(F.col("coefficient")), "direction": stats.direction(F.col("coefficient"))}
    return rounded(found.withColumns(words))


@registered
def normality(t: TestTables) -> DataFrame:
    return rounded(stats.shapiro(t.raw("lineitem"), ["l_quantity", "l_extendedprice"]).drop("p_value"), 6)


@registered
def normality_p_values(t: TestTables) -> DataFrame:
    """P-values of smaller groups of rows: order prices, one column per order status."""
    prices = [F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).alias(f"price_{s}") for s in ("F", "O", "P")]
    return rounded(stats.shapiro(t.raw("orders").select(*prices), ["price_F", "price_O", "price_P"]), 6)


@registered
def normality_sampled(t: TestTables) -> DataFrame:
    """The test on the 5,000 line items with the smallest hashes, for which the p-value is made."""
    found = stats.shapiro(t.raw("lineitem"), ["l_quantity", "l_extendedprice"], ["l_orderkey", "l_linenumber"])
    return rounded(found.drop("p_value"), 6)


@registered
def correlation_report(t: TestTables) -> DataFrame:
    found = stats.correlate(t.raw("orders"), "o_totalprice", "o_custkey")
    return rounded(found.drop("p_value", "significant"), 6)


@registered
def describe_approximately(t: TestTables) -> DataFrame:
    """Whether each approximate quartile lies between exact ones half a per cent of the rows away."""
    rows = t.raw("lineitem")
    rough = stats.describe(rows, _METRICS, accuracy=1000)
    exact = {}
    for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        exact[f"{name}_low"], exact[f"{name}_high"] = p - 0.005, p + 0.005
    bounds = stats.quantiles(rows, _METRICS, exact)
    joined = rough.join(bounds, "column")
    inside = [F.col(q).between(F.col(f"{q}_low"), F.col(f"{q}_high")).alias(f"{q}_close") for q in ("p25", "p50", "p75")]
    return joined.select("column", "count", *inside)


@registered
def describe_batches(t: TestTables) -> DataFrame:
    """Summaries of three batches, stored and merged; whether each quartile is close as above."""
    path = scratch_path(t.spark, "summaries")
    stats.summaries(t.raw("lineitem"), _METRICS, ["l_returnflag"]).write.parquet(path)
    whole = stats.merged(t.spark.read.parquet(path))
    exact = {}
    for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        exact[f"{name}_low"], exact[f"{name}_high"] = p - 0.005, p + 0.005
    joined = whole.join(stats.quantiles(t.raw("lineitem"), _METRICS, exact), "column")
    inside = [F.col(q).between(F.col(f"{q}_low"), F.col(f"{q}_high")).alias(f"{q}_close") for q in ("p25", "p50", "p75")]
    numbers = [F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")]
    return joined.select("column", "count", *numbers, *inside)
