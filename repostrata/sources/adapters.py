"""Canonical tables seen through the star-schema test tables.

The test tables hold no repositories, so every canonical table is a projection of them.
Keys keep their native types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from repostrata.functions.documents import column_names


class TestTables:
    """Canonical tables over the parquet files of one folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def commits(self) -> DataFrame:
        joined = (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        )
        return joined.selectExpr(
            "n_name as repo",
            "o_orderkey as commit_hash",
            "o_orderkey as seq",
            "c_name as author_name",
            "c_custkey as author_id",
            "cast(o_orderdate as timestamp) as committer_date",
            "case when o_orderkey % 7 = 0 then null else (o_orderkey % 5) / 4.0D end as dmm_unit_size",
            "case when o_orderkey % 11 = 0 then null else (o_orderkey % 3) / 2.0D end as dmm_unit_complexity",
            "case when o_orderkey % 13 = 0 then null else (o_orderkey % 9) / 8.0D end as dmm_unit_interfacing",
        )

    def repos(self) -> DataFrame:
        return self.raw("nation").selectExpr("concat('https://git.example/acme/', n_name, '.git') as repo_url")

    def file_changes(self) -> DataFrame:
        """With the columns of the commit attached."""
        lines = self.raw("lineitem").selectExpr(
            "l_orderkey as commit_hash",
            "l_partkey % 40 as path",
            "cast(l_quantity as bigint) as added_lines",
            "cast(l_linenumber as bigint) as deleted_lines",
        )
        commits = self.commits().select("repo", "commit_hash", "seq", "author_name", "author_id", "committer_date")
        return lines.join(commits, "commit_hash")

    def star_events(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_type as repo", "cast(date_trunc('hour', ts) as timestamp) as starred_at", "user_id as user_login"
        )

    def event_types(self) -> list[str]:
        """Names of the starred repositories, for the wide table."""
        return column_names(self.raw("events"), "event_type")

    def lint_messages(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "cast(l_suppkey % 10 as string) as repo",
            "l_orderkey as commit_hash",
            "cast(date '2020-01-01' + cast(l_orderkey % 365 as int) as timestamp) as committer_date",
            "concat('m', cast(l_partkey % 50 as string)) as module",
            "case l_returnflag when 'A' then 'convention' when 'N' then 'warning' else 'refactor' end as category",
            "concat('R', cast(l_linenumber as string)) as msg_id",
            "case when l_linenumber = 1 then 'too-complex' else concat('sym', cast(l_linenumber as string)) end as symbol",
            "case when l_linenumber = 1 then concat('f is too complex. The McCabe rating is ',"
            " cast(cast(l_quantity as int) as string)) else 'msg' end as msg",
            "'HIGH' as confidence",
            "concat('src/m', cast(l_partkey % 50 as string), '.py') as path",
        )

    def lint_stats(self) -> DataFrame:
        """Statistics under the linter's dotted keys, some of which the table leaves out.

        The messages are brought together by commit, not the several keys of each. As these take
        more room than what is shuffled, the partitions are not merged by its size.
        """
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = self.lint_messages().repartition(partitions, "commit_hash", "repo").selectExpr(
            "repo", "commit_hash", "committer_date",
            "explode(array(concat('stats.by_msg.', symbol), concat('stats.', category),"
            " concat('stats.by_module.', module, '.total'), 'stats.statement', 'stats.node_count.function')) as key",
        )
        return keyed.groupBy("repo", "commit_hash", "committer_date", "key").agg(
            F.count(F.lit(1)).cast("double").alias("value")
        )

    def message_ids(self) -> DataFrame:
        """Ids of the symbols in use; the symbol of line number 7 has none."""
        return self.raw("lineitem").selectExpr(
            "case when l_linenumber = 1 then 'too-complex' else concat('sym', cast(l_linenumber as string)) end as symbol",
            "case when l_linenumber = 7 then null else concat('R', cast(l_linenumber as string)) end as msg_id",
        ).where("msg_id is not null").distinct()

    def source_files(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_brand as repo",
            "p_partkey % 20 as commit_hash",
            "cast(date '2020-01-01' + cast(p_partkey % 20 as int) as timestamp) as committer_date",
            "concat(case p_partkey % 5 when 0 then 'src/a' when 1 then 'VENV/b' when 2 then 'src/.hid/c'"
            " when 3 then 'lib2/d' else 'src/venv/e' end,"
            " cast(p_partkey as string), case when p_partkey % 6 = 0 then '.txt' else '.py' end) as path",
            "case p_partkey % 4"
            " when 0 then concat('import unittest', chr(10), 'class T(unittest.TestCase):', chr(10),"
            " '    def test_a(self):', chr(10), '        x = f(1)', chr(10))"
            " when 1 then concat('import os', chr(10), 'def run():', chr(10), '    y = 1', chr(10),"
            " '    return g(y)', chr(10))"
            " when 2 then concat('import pytest', chr(10), 'import os', chr(10), 'def test_b():', chr(10),"
            " '    assert h()', chr(10))"
            " else concat('def broken(:', chr(10)) end as content",
        )

    def document_sources(self) -> DataFrame:
        """Prose in place of source text."""
        return self.raw("documents").selectExpr(
            "source as repo", "doc_id as commit_hash", "timestamp '2020-01-01 00:00:00' as committer_date",
            "concat('src/d', cast(doc_id as string), '.py') as path", "text as content",
        )

    def patches(self) -> DataFrame:
        """Diff text per file change: two blocks for an even part key, else one."""
        return self.raw("lineitem").selectExpr(
            "cast(l_suppkey % 10 as string) as repo",
            "l_orderkey as commit_hash",
            "l_partkey as path",
            "l_linenumber as line_no",
            "concat('@@ -1 +1 @@', chr(10), repeat(concat('+x', chr(10)), cast(l_quantity as int)),"
            " case when l_partkey % 2 = 0 then concat(' c', chr(10)) else '' end,"
            " repeat(concat('-y', chr(10)), l_linenumber)) as patch",
        )

    def nation_patches(self) -> DataFrame:
        """The same diff texts under the repositories and paths of ``file_changes``."""
        texts = self.patches().select("commit_hash", (F.col("path") % 40).alias("path"), "patch")
        return texts.join(self.commits().select("repo", "commit_hash"), "commit_hash")

    def rename_edges(self) -> DataFrame:
        """Sixteen renames per repository that go twice through eight names."""
        return self.raw("part").selectExpr(
            "cast(floor(p_partkey / 16) as bigint) as repo",
            "p_partkey % 8 as old_path",
            "(p_partkey + 1) % 8 as new_path",
            "p_partkey as seq",
        )

    def language_bytes(self) -> DataFrame:
        joined = self.raw("lineitem").join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return (
            joined.selectExpr("s_name as repo", "concat(l_returnflag, l_linestatus) as language", "l_quantity")
            .groupBy("repo", "language")
            .agg(F.sum("l_quantity").cast("bigint").alias("size"))
        )

    def repo_metadata(self) -> DataFrame:
        """Documents with unreadable dates, empty descriptions and null licences."""
        return self.raw("supplier").selectExpr(
            "s_name as repo",
            """concat('{"createdAt":"', case when s_suppkey % 5 = 0 then 'bad' else '2020-01-01T00:00:00Z' end,
               '","diskUsage":', cast(s_suppkey * 10 as string),
               ',"description":"', case when s_suppkey % 4 = 0 then '' else s_name end,
               '","licenseInfo":', case when s_suppkey % 3 = 0 then 'null' else '{"name":"MIT"}' end,
               ',"languages":{"totalSize":', cast(s_suppkey % 7 as string),
               ',"edges":[{"size":', cast(s_suppkey % 3 as string), ',"node":{"name":"Python"}}]}',
               ',"empty":{}',
               ',"resourcePath":"/acme/', s_name, '"',
               ',"stargazerCount":', cast(s_suppkey % 17 as string), '}') as doc""",
        )

    def moved_changes(self) -> DataFrame:
        """File changes that fall between the renames of ``rename_edges``."""
        return self.raw("lineitem").selectExpr(
            "cast(floor(l_partkey / 16) as bigint) as repo",
            "l_partkey % 8 as path",
            "cast(floor(l_partkey / 16) * 16 + l_linenumber * 2 as bigint) as seq",
            "cast(l_quantity as bigint) as added_lines",
            "cast(l_linenumber as bigint) as deleted_lines",
        )

    def updates(self) -> DataFrame:
        return self.raw("events").selectExpr("user_id as repo", "cast(ts as date) as day", "event_id as batch", "value")
