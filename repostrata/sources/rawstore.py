"""Raw results of runs as eight parquet tables that only grow.

A run is keyed by ``run_ts`` and a commit by ``(run_ts, repository_name, hash)``, so a
re-run never attaches to the rows of an older one. Documents that list many entries are
cut into parts of bounded size; the parts of a key together hold every entry. Totals are kept
apart from the entries and always count the whole commit, however its entries are cut.

What was stored can be read back in the shape it was appended in: of all runs, of one run, or
of the newest run of each repository.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repostrata.functions.documents import utc_timestamp
from repostrata.operators.upsert import new_keys
from repostrata.session import pinned, shuffles_dropped, stored
from repostrata.sources.readers import STAR_EDGES

TABLES = ("repositories", "metadata", "stargazers", "tests", "test_commits", "lints", "lint_commits", "gits")


def in_parts(
    rows: DataFrame, keys: Sequence[str], max_rows: int = 10_000, counted: DataFrame | None = None
) -> DataFrame:
    """Number the parts of each key so that a part holds at most about ``max_rows`` rows,
    and bring each part together; grouping by keys and part then needs no shuffle.

    Rows must be distinct: a row's part is a hash of the row. ``counted`` may be a cheaper
    frame with at least as many rows per key, to count instead of ``rows``.
    """
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    # Most keys fit in one part. The list of those that do not is fixed first, so its
    # size is known when the join is planned: short lists are broadcast, and for a long
    # one both sides are plain shuffles that adaptive execution can split.
    long = pinned(
        (rows if counted is None else counted)
        .groupBy(*keys)
        .agg(F.ceil(F.count(F.lit(1)) / max_rows).alias("__parts"))
        .where(F.col("__parts") > 1)
    )
    part = F.pmod(F.xxhash64(*rest), F.coalesce("__parts", F.lit(1).cast("bigint")))
    return rows.join(long, keys, "left").withColumn("part", part).drop("__parts").repartition(*keys, "part")


def stargazer_documents(events: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Star edges per repository as JSON documents in parts."""
    edges = events.select("repo", "starred_at", "user_login").distinct()
    edge = F.struct(F.col("starred_at").alias("starredAt"), F.struct(F.col("user_login").alias("login")).alias("node"))
    stargazers = F.struct(F.struct(F.collect_list(edge).alias("edges")).alias("stargazers")).alias("repository")
    return (
        in_parts(edges, ["repo"], max_rows)
        .groupBy("repo", "part")
        .agg(F.to_json(F.struct(F.struct(stargazers).alias("data"))).alias("data"))
    )


def test_documents(classified: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Statement counts per file of each commit as JSON documents in parts."""
    keys = ["repo", "commit_hash"]
    result = ["imports", "unittest_classes", "pytest_functions", "production_statements", "test_statements"]
    files = classified.where(F.col("parsed")).select(*keys, "path", *result)
    entry = F.struct("path", F.struct(*result))
    return (
        in_parts(files, keys, max_rows)
        .groupBy(*keys, "part")
        .agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("files"))
    )


_HASHES = 4_096  # that a shuffle partition counts rows by, when keys of many rows are looked for
_NEAR = 10_000  # rows of a partition that a list of statistics is made of, at most
_FOUND = ["symbol", "msg", "confidence", "path"]
_PLACE = ["module", "category", "msg_id"]
# Shapes of the stored documents.
_ENTRIES = (
    "map<string, map<string, map<string, array<struct<symbol: string, msg: string, confidence: string, path: string,"
    " occurrences: bigint>>>>>"
)
_TOTALS = (
    "map<string, struct<total_messages: bigint, categories: map<string, struct<total: bigint, message_ids: map<string, bigint>>>>>"
)
_MODULE_TOTALS = "map<string, struct<total_messages: bigint>>"
_FILES = (
    "map<string, struct<imports: array<string>, unittest_classes: array<string>, pytest_functions: array<string>,"
    " production_statements: bigint, test_statements: bigint>>"
)


def _named(messages: DataFrame) -> DataFrame:
    """A missing module, category or id becomes an empty text, since keys of a document cannot be missing."""
    return messages.withColumns({c: F.coalesce(c, F.lit("")) for c in _PLACE})


def distinct_messages(messages: DataFrame) -> DataFrame:
    """Equal messages of a commit as one row with their number of ``occurrences``, which may be counted in part.

    A missing module, category or id becomes an empty text.
    """
    number = F.sum("occurrences") if "occurrences" in messages.columns else F.count(F.lit(1))
    return _named(messages).groupBy("repo", "commit_hash", *_PLACE, *_FOUND).agg(number.alias("occurrences"))


def stat_lists(stats: DataFrame) -> DataFrame:
    """``(repo, commit_hash, committer_date, rows, stat)``: statistics of commits in lists, written once.

    Rows of a commit that lie near each other in a partition, within ``_NEAR`` rows, become one list:
    far fewer rows to shuffle, none of unbounded size, and no shuffle where the statistics of a
    commit are in one partition.
    """
    keys = ["commit_hash", "repo"]
    near = (F.monotonically_increasing_id() / _NEAR).cast("bigint")
    lists = stats.withColumn("__near", near).sortWithinPartitions(*keys, "__near").groupBy(*keys, "__near").agg(
        F.max("committer_date").alias("committer_date"),
        F.count(F.lit(1)).alias("rows"),
        F.collect_list(F.struct("key", "value")).alias("stat"),
    )
    with shuffles_dropped(stats.sparkSession):
        return stored(lists.select("repo", "commit_hash", "committer_date", "rows", "stat"), "zstd")[0]


def crowded_keys(counts: DataFrame, most: int) -> DataFrame | None:
    """Keys, each once, whose ``rows`` add up to more than ``most``; None if there are none.

    All are added up by a hash, so that what is shuffled is bounded by the hashes; only keys under
    a hash of more than ``most`` rows are then added up by themselves.
    """
    keys = [c for c in counts.columns if c != "rows"]
    hashes = _HASHES * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = counts.withColumn("__hash", F.pmod(F.xxhash64(*keys), F.lit(hashes)))

    def many(*by: str, of: DataFrame) -> DataFrame:
        added = of.groupBy(*by).agg(F.sum("rows").alias("rows"))
        return pinned(added.where(F.col("rows") > most).select(*by))

    full = many("__hash", of=hashed)
    if full.isEmpty():
        return None
    found = many(*keys, of=hashed.join(full, "__hash", "left_semi"))
    return None if found.isEmpty() else found


def _of_keys(rows: DataFrame, listed: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows joined with a list of keys, of which missing ones are equal."""
    named = listed.withColumnsRenamed({c: f"__{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return rows.join(named, same, how).drop(*[f"__{c}" for c in keys])


def lint_documents(messages: DataFrame, stats: DataFrame, max_rows: int = 10_000, max_list: int = 10_000) -> DataFrame:
    """``(repo, commit_hash, part, stats, messages, totals, date)``: the JSON documents of each commit.

    Messages have a number of ``occurrences``; that of equal ones is added up. They are nested by
    module, category and id; totals count them at the same levels. A module is never cut in the
    totals, so every total is that of the commit. All rows of a commit are brought together once,
    as one list that is then cut into parts of ``max_rows``; only commits of more than ``max_list``
    rows, or than ``max_rows`` if that is more, are dealt to their parts before.
    """
    keys = ["commit_hash", "repo"]
    stats = stats if "stat" in stats.columns else stat_lists(stats)
    counts = stats.select(*keys, "rows").unionAll(messages.select(*keys, F.lit(1).alias("rows")))
    most = max(max_rows, max_list)
    crowded = crowded_keys(counts, most)
    if crowded is None:
        return _whole_commits(messages, stats, max_rows, most)
    few = [_of_keys(rows, crowded, keys, "left_anti") for rows in (messages, stats)]
    many = [_of_keys(rows, crowded, keys, "left_semi") for rows in (messages, stats)]
    return _whole_commits(*few, max_rows, most).unionByName(_dealt_commits(*many, max_rows))


def _lists(sides: Sequence[DataFrame], by: Sequence[str], *ordered: str) -> DataFrame:
    """Rows of all sides, brought together once: their statistics and those of ``ordered`` in lists by the columns of ``by``."""
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side, allowMissingColumns=True)
    return rows.repartition(*by).sortWithinPartitions(*by).groupBy(*by).agg(
        F.max("date").alias("date"),
        F.flatten(F.collect_list("stat")).alias("stat"),
        *[F.sort_array(F.collect_list(name)).alias(name) for name in ordered],
    )


def _message() -> Column:
    """A message as its list holds it, in the order in which it is nested."""
    return F.struct(*_PLACE, F.struct(*_FOUND).alias("found"), "occurrences").alias("message")


def _documents(rows: DataFrame, stat: Column, message: Column, totals: Column, counted: Column) -> DataFrame:
    """JSON texts of the lists, NULL for an empty one; ``totals`` are pairs made of ``counted``."""
    made = {
        "stats": (stat, F.map_from_entries(stat)),
        "messages": (message, _entries(message)),
        "totals": (counted, F.map_from_entries(totals)),
    }
    texts = [F.when(F.size(of) > 0, F.to_json(nested)).alias(name) for name, (of, nested) in made.items()]
    return rows.select("repo", "commit_hash", F.col("part").cast("bigint").alias("part"), *texts, "date")


def _whole_commits(messages: DataFrame, stats: DataFrame, max_rows: int, most: int) -> DataFrame:
    """Documents of commits whose rows, at most ``most``, fit in one list, which is cut into parts."""
    keys = ["commit_hash", "repo"]
    sides = [
        stats.select(*keys, F.col("committer_date").alias("date"), "stat"),
        messages.select(*keys, _message()),
    ]
    listed = _lists(sides, keys, "message")
    if most <= max_rows:
        stat, message = F.col("stat"), F.col("message")
        return _documents(listed.withColumn("part", F.lit(0)), stat, message, _totals(message), message)
    # Equal messages are counted before a list is cut, so that they stay in one part.
    fits = F.size("message") <= max_rows
    listed = listed.withColumn("message", F.when(fits, F.col("message")).otherwise(_merged(F.col("message"))))
    listed = listed.withColumn("modules", _totals(F.col("message")))
    longest = F.greatest(F.size("stat"), F.size("message"), F.lit(1))
    cut = listed.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(longest / max_rows).cast("int") - 1)))
    own = lambda name: F.slice(name, F.col("part") * max_rows + 1, F.lit(max_rows))
    return _documents(cut, own("stat"), own("message"), own("modules"), own("modules"))


def _dealt_commits(messages: DataFrame, stats: DataFrame, max_rows: int) -> DataFrame:
    """Documents of commits of many rows, which are dealt to parts by a hash; totals by their module."""
    keys = ["commit_hash", "repo"]
    distinct = pinned(distinct_messages(messages))
    one, zero = F.lit(1), F.lit(0)
    each = stats.select(*keys, "committer_date", F.explode("stat").alias("stat"))
    sizes = each.select(*keys, one.alias("s"), zero.alias("m"), F.col("committer_date").alias("date"))
    sizes = sizes.unionByName(distinct.select(*keys, zero.alias("s"), one.alias("m")), allowMissingColumns=True)
    parts = lambda rows: F.greatest(F.ceil(F.sum(rows) / max_rows), one)
    long = pinned(
        sizes.groupBy(*keys).agg(parts("s").alias("stat_parts"), parts("m").alias("message_parts"), F.max("date").alias("date"))
    )

    def placed(rows: DataFrame, number: str, by: Sequence[str], entry: Column) -> DataFrame:
        """Rows with their part: a hash of them."""
        part = F.pmod(F.xxhash64(*by), F.col(number).cast("bigint")).alias("part")
        return _of_keys(rows, long, keys, "inner").select(*keys, part, "date", entry)

    counts = distinct.groupBy(*keys, *_PLACE).agg(F.sum("occurrences").alias("occurrences"))
    sides = [
        placed(each, "stat_parts", ["stat"], F.array("stat").alias("stat")),
        placed(distinct, "message_parts", [*_PLACE, *_FOUND], _message()),
        placed(counts, "message_parts", ["module"], F.struct(*_PLACE, "occurrences").alias("counted")),
    ]
    listed = _lists(sides, [*keys, "part"], "message", "counted")
    return _documents(listed, F.col("stat"), F.col("message"), _totals(F.col("counted")), F.col("counted"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stretches(rows: Column, key: str, body: Callable[[Column], Column]) -> Column:
    """Pairs of each ``key`` with ``body`` of its rows, in time linear in the sorted rows.

    ``rows`` should be a name or a bound value: it is named several times.
    """
    size = F.size(rows)
    first = lambda i: (i == 1) | (F.get(rows, i - 1)[key] != F.get(rows, i - 2)[key])
    alike = (size > 0) & (F.get(rows, F.lit(0))[key] == F.get(rows, size - 1)[key])
    several = F.when(size > 0, F.filter(F.sequence(F.lit(1), size), first)).otherwise(F.array().cast("array<int>"))
    starts = F.when(alike, F.array(F.lit(1))).otherwise(several)

    def stretch(at: Column, s: Column, j: Column) -> Column:
        length = F.coalesce(F.get(at, j + 1), size + 1) - s
        own = F.when(length == size, rows).otherwise(F.slice(rows, s, length))
        return _bound(own, lambda own: F.struct(F.get(own, F.lit(0))[key].alias("key"), body(own).alias("value")))

    return _bound(starts, lambda at: F.transform(at, lambda s, j: stretch(at, s, j)))


def _one_or(rows: Column, only: Callable[[Column, Column], Column], several: Column) -> Column:
    """``only`` of the row and its occurrences where there is one, as in many commits and modules."""
    row = F.get(rows, F.lit(0))
    return F.when(F.size(rows) == 1, only(row, row["occurrences"])).otherwise(several)


def _total(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0).cast("bigint"), lambda n, x: n + x["occurrences"])


def _entries(rows: Column) -> Column:
    """Messages by module, category and id, equal ones as one entry."""
    alone = lambda x, n: F.array(F.struct(*[x["found"][c].alias(c) for c in _FOUND], n.alias("occurrences")))
    of_category = lambda x, n: F.create_map(x["category"], F.create_map(x["msg_id"], alone(x, n)))
    only = lambda x, n: F.create_map(x["module"], of_category(x, n))

    def found(same: Column) -> Column:
        entry = lambda x: F.struct(*[x["key"][c].alias(c) for c in _FOUND], x["value"].alias("occurrences"))
        return F.transform(_stretches(same, "found", _total), entry)

    by_id = lambda own: F.map_from_entries(_stretches(own, "msg_id", found))
    of_several = lambda own: F.map_from_entries(_stretches(own, "category", by_id))
    by_category = lambda own: _one_or(own, of_category, of_several(own))
    several = _bound(rows, lambda rows: F.map_from_entries(_stretches(rows, "module", by_category)))
    return _one_or(rows, only, several)


def _totals(rows: Column) -> Column:
    """Modules with counts of messages by module, category and id."""
    of_category = lambda x, n: F.struct(n.alias("total"), F.create_map(x["msg_id"], n).alias("message_ids"))
    by_category_of = lambda x, n: F.create_map(x["category"], of_category(x, n)).alias("categories")
    of_module = lambda x, n: F.struct(n.alias("total_messages"), by_category_of(x, n))
    only = lambda x, n: F.array(F.struct(x["module"].alias("key"), of_module(x, n).alias("value")))
    ids = lambda own: F.map_from_entries(_stretches(own, "msg_id", _total))
    category = lambda own: F.struct(_total(own).alias("total"), ids(own).alias("message_ids"))
    categories = lambda own: F.map_from_entries(_stretches(own, "category", category))
    of_several = lambda own: F.struct(_total(own).alias("total_messages"), categories(own).alias("categories"))
    module = lambda own: _one_or(own, of_module, of_several(own))
    return _one_or(rows, only, _bound(rows, lambda rows: _stretches(rows, "module", module)))


def _merged(rows: Column) -> Column:
    """Equal messages of the sorted rows as one with their number of occurrences."""
    kept = (*_PLACE, "found")
    whole = lambda x: F.struct(*[x[c].alias(c) for c in kept])
    at = F.transform(rows, lambda x: F.struct(whole(x).alias("at"), x["occurrences"].alias("occurrences")))
    counted = lambda x: F.struct(*[x["key"][c].alias(c) for c in kept], x["value"].alias("occurrences"))
    return _bound(at, lambda named: F.transform(_stretches(named, "at", _total), counted))


def row_documents(table: DataFrame, key: str = "repo") -> DataFrame:
    """Each row of a table as one JSON document."""
    rest = [F.col(f"`{c}`").alias(c) for c in table.columns if c != key]
    return table.select(key, F.to_json(F.struct(*rest)).alias("data"))


class RawStore:
    """Appends results to the eight tables below ``path`` and reads them back.

    ``max_rows`` bounds the entries of a document. Readers take a ``run``: None for all runs,
    a run's name, or ``"latest"`` for the newest run of each repository.
    """

    def __init__(self, spark: SparkSession, path: str, max_rows: int = 10_000):
        self.spark = spark
        self.path = path.rstrip("/")
        self.max_rows = max_rows

    def read(self, table: str, run: str | None = None) -> DataFrame | None:
        """Rows of a table, or None before the first append."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        rows = rows.withColumn("run_ts", F.col("run_ts").cast("string")) if "run_ts" in rows.columns else rows
        if run == "latest":
            newest = rows.groupBy("repository_name").agg(F.max("run_ts").alias("run_ts"))
            return rows.join(newest, ["repository_name", "run_ts"])
        return rows if run is None else rows.where(F.col("run_ts") == run)

    def _stored(self, table: str, run: str | None) -> DataFrame:
        """Rows under the names that results have."""
        rows = self.read(table, run)
        if rows is None:
            raise ValueError(f"nothing was stored in {table}")
        return rows.withColumnsRenamed({"repository_name": "repo", "hash": "commit_hash"})

    def _append(self, table: str, rows: DataFrame, run_ts: str) -> None:
        """The rows of a run; a retried run replaces what it wrote before."""
        named = rows.withColumnsRenamed({"repo": "repository_name", "commit_hash": "hash"}).withColumn("run_ts", F.lit(run_ts))
        writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_ts")
        with shuffles_dropped(self.spark):
            writer.option("compression", "zstd").parquet(f"{self.path}/{table}")

    def add_repositories(self, repos: DataFrame) -> None:
        """Insert the repositories that are not there yet."""
        names = repos.select(F.col("repo").alias("repo_name")).distinct()
        existing = self.read("repositories")
        fresh = names if existing is None else new_keys(names, existing, "repo_name")
        fresh.write.mode("append").parquet(f"{self.path}/repositories")

    def append_metadata(self, docs: DataFrame, run_ts: str) -> None:
        self.add_repositories(docs)
        text = F.col("doc") if dict(docs.dtypes)["doc"] == "string" else F.to_json("doc")
        self._append("metadata", docs.select("repo", text.alias("data")), run_ts)

    def append_stargazers(self, events: DataFrame, run_ts: str) -> None:
        self.add_repositories(events)
        self._append("stargazers", stargazer_documents(events, self.max_rows), run_ts)

    def append_git(self, table: DataFrame, run_ts: str) -> None:
        self.add_repositories(table)
        self._append("gits", row_documents(table), run_ts)

    def append_tests(self, classified: DataFrame, commits: DataFrame, run_ts: str) -> None:
        """``commits`` has ``repo, commit_hash, date, test_to_code_ratio``."""
        self.add_repositories(commits)
        self._append("tests", commits.select("repo").distinct(), run_ts)
        documents = test_documents(classified, self.max_rows)
        facts = commits.select("repo", "commit_hash", "date", "test_to_code_ratio")
        self._append("test_commits", facts.join(documents, ["repo", "commit_hash"], "left"), run_ts)

    def append_lints(self, messages: DataFrame, stats: DataFrame, run_ts: str) -> None:
        """``stats`` may be the lists that ``stat_lists`` makes of them."""
        with shuffles_dropped(self.spark):
            stats = stats if "stat" in stats.columns else stat_lists(stats)
            self.add_repositories(stats)
            self._append("lints", stats.select("repo").distinct(), run_ts)
            each = _named(messages).withColumn("occurrences", F.lit(1).cast("bigint"))
            self._append("lint_commits", lint_documents(each, stats, self.max_rows), run_ts)

    def commits_of(self, kind: str) -> DataFrame:
        """Commit rows of ``test`` or ``lint`` with the parent row of their own run."""
        parents = self.read(f"{kind}s").select("run_ts", "repository_name")
        return self.read(f"{kind}_commits").join(parents, ["run_ts", "repository_name"])

    def documents(self, run: str | None = None) -> DataFrame:
        """Metadata documents: ``(run_ts, repo, doc VARIANT)``."""
        return self._stored("metadata", run).select("run_ts", "repo", F.parse_json("data").alias("doc"))

    def star_events(self, run: str | None = None) -> DataFrame:
        """Star events ``(run_ts, repo, starred_at, user_login)``, each once."""
        rows = self._stored("stargazers", run)
        edge = F.explode(F.from_json("data", STAR_EDGES)["data"]["repository"]["stargazers"]["edges"])
        return rows.select("run_ts", "repo", edge.alias("e")).select(
            "run_ts", "repo", utc_timestamp(F.col("e.starredAt")).alias("starred_at"), F.col("e.node.login").alias("user_login")
        )

    def git_rows(self, schema: str, run: str | None = None) -> DataFrame:
        """Rows of the git table, whose other columns ``schema`` names with their types."""
        rows = self._stored("gits", run)
        return rows.select("run_ts", "repo", F.from_json("data", schema).alias("d")).select("run_ts", "repo", "d.*")

    def classified_files(self, run: str | None = None) -> DataFrame:
        """Statement counts and names per file of each commit, as classified."""
        rows = self._stored("test_commits", run).where(F.col("files").isNotNull())
        listed = rows.select("run_ts", "repo", "commit_hash", F.explode(F.from_json("files", _FILES)).alias("path", "f"))
        return listed.select("run_ts", "repo", "commit_hash", "path", "f.*", F.lit(True).alias("parsed"))

    def lint_messages(self, run: str | None = None) -> DataFrame:
        """Messages as they were appended, one row per occurrence.

        The documents' four levels (module, category, id, entry) are unnested within the row;
        nothing is shuffled, whatever parts a commit was cut into.
        """
        own = ["run_ts", "repo", "commit_hash", F.col("date").alias("committer_date")]
        rows = self._stored("lint_commits", run).where(F.col("messages").isNotNull())
        found = rows.select(*own, F.from_json("messages", _ENTRIES).alias("at"))
        keys = ["run_ts", "repo", "commit_hash", "committer_date"]
        for depth, name in enumerate(_PLACE):
            found = found.select(*keys, *_PLACE[:depth], F.explode("at").alias(name, "at"))
        found = found.select(*keys, *_PLACE, F.explode("at").alias("at"))
        each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "at.occurrences")))
        return each.select(*keys, *_PLACE, *[f"at.{c}" for c in _FOUND])

    def lint_counts(self, run: str | None = None, modules_only: bool = False) -> DataFrame:
        """Stored totals ``(run_ts, repo, commit_hash, module, category, msg_id, level, messages)``.

        ``level`` is 0 for a message id, 1 for a category and 3 for a module, as in
        ``message_counts``. With ``modules_only`` those of level 3, without reading the others.
        """
        keys = ["run_ts", "repo", "commit_hash"]
        rows = self._stored("lint_commits", run).where(F.col("totals").isNotNull())
        # One reading of a document gives the rows of all levels.
        none = F.lit(None).cast("string")

        def row(level: int, category: Column, msg_id: Column, messages: Column) -> Column:
            own = (("category", category), ("msg_id", msg_id), ("level", F.lit(level).cast("bigint")), ("messages", messages))
            return F.struct(*[value.alias(name) for name, value in own])

        def of_category(c: Column) -> Column:
            ids = F.transform(F.map_entries(c.value.message_ids), lambda i: row(0, c.key, i.key, i.value))
            return F.concat(F.array(row(1, c.key, none, c.value.total)), ids)

        kind = _MODULE_TOTALS if modules_only else _TOTALS
        modules = rows.select(*keys, F.explode(F.from_json("totals", kind)).alias("module", "m"))
        if modules_only:
            return modules.select(*keys, "module", row(3, none, none, F.col("m.total_messages")).alias("r")).select(*keys, "module", "r.*")
        categories = F.flatten(F.transform(F.map_entries("m.categories"), of_category))
        found = F.concat(F.array(row(3, none, none, F.col("m.total_messages"))), categories)
        return modules.select(*keys, "module", F.inline(found))

    def lint_stats(self, run: str | None = None) -> DataFrame:
        """Statistics of each commit in rows: ``(run_ts, repo, commit_hash, committer_date, key, value)``."""
        rows = self._stored("lint_commits", run).where(F.col("stats").isNotNull())
        entry = F.explode(F.from_json("stats", "map<string, double>")).alias("key", "value")
        return rows.select("run_ts", "repo", "commit_hash", F.col("date").alias("committer_date"), entry)
