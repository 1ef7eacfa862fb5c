import csv
import json
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from repostrata.session import discard, pinned, shared_dir, tune
from repostrata.sources import keyed_json, readers, writers
from repostrata.sources.rawstore import RawStore, in_parts


def test_url_list(spark, tmp_path, rows):
    (tmp_path / "urls.txt").write_text("https://h/u/repo1\n\n  https://h/u/repo2/  \n")
    assert rows(readers.read_urls(spark, str(tmp_path / "urls.txt"))) == [("https://h/u/repo1",), ("https://h/u/repo2",)]


def test_source_tree(spark, tmp_path, rows):
    for name, text in {"r1/a.py": b"x = 1\n", "r1/sub/b.py": b"\xff\xfe", "r2/c.txt": b"no"}.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text)
    found = readers.read_source_tree(spark, str(tmp_path), "c1", "2020-01-01")
    assert rows(found, "repo", "commit_hash", "path", "content") == [
        ("r1", "c1", "a.py", "x = 1\n"), ("r1", "c1", "sub/b.py", None),
    ]


def test_left_out_folders_are_never_opened(spark, tmp_path, rows, monkeypatch):
    """Same rows as the path filters on the full list, and no call names a left out folder."""
    from repostrata.functions.filters import python_sources
    from repostrata.sources import tree

    names = []
    for repo in ("r1", "r2"):
        for folder in ("", "src/", "src/venv/", "src/deep/er/", "venv/", "VENV/x/", "Build/", ".git/", "src/.hid/", "src/_x/y/", "lib2/"):
            for file in ("a.py", "b.PY", "c.txt"):
                target = tmp_path / repo / folder / file
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text("x = 1\n")
                names.append((repo, f"{folder}{file}"))
    (tmp_path / "stray.py").write_text("no repository")
    everything = spark.createDataFrame(names, "repo string, path string")
    for depth in ("root", "any"):
        found = readers.read_source_tree(spark, str(tmp_path), "c", "2020-01-01", depth=depth)
        assert rows(found, "repo", "path") == rows(python_sources(everything, depth=depth))

    called = []
    listed = tree.TreeReader._listed
    monkeypatch.setattr(tree.TreeReader, "_listed", lambda self, folder: called.append(folder) or listed(self, folder))
    for wanted in ("1", "5", "100"):
        reader = tree.TreeReader({"path": str(tmp_path), "deny": '["venv", "build"]', "prefixes": "._", "partitions": wanted})
        called.clear()
        files = [f for p in reader.partitions() for f in reader.read(p)]
        assert len(files) == len(set(files)) == 2 * 5
        assert called and not any("/." in f"/{c}" or "/_" in c or c.split("/")[1:2] in (["venv"], ["VENV"], ["Build"]) for c in called)
    with pytest.raises(ValueError):
        tree.TreeReader({"path": str(tmp_path), "depth": "some"})


@pytest.mark.parametrize("documents", [{}, {"r1": {}}, {
    "r1": {"a": 1, "b": {"c": None, "d": [1, 2]}, "text": 'line\n    "quoted": {\n}'},
    'odd "name" é': {"z": {"y": {}}, "tail": "ends in \\\\"}, "empty": {}, "list": [1, {"x": 2}], "text": "v", "null": None,
}])
@pytest.mark.parametrize("indent, block", [(None, 7), (2, 64), (4, 1 << 20), ("\t", 1)])
def test_keyed_json_is_split_by_document(spark, tmp_path, documents, indent, block):
    path = tmp_path / "raw.json"
    path.write_text(json.dumps(documents, indent=indent, ensure_ascii=indent is None))
    read = readers.read_keyed_json(spark, str(path), block).select("repo", F.to_json("doc").alias("doc"))
    assert {r.repo: json.loads(r.doc) for r in read.collect()} == documents


def test_blocks_are_cut_alike_wherever_they_end():
    """Pieces put together again give the same members for every size of block."""
    rng = random.Random(9)
    signs = ['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", " "]
    documents = {}
    for i in range(40):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        documents[f"k{i}{text}"] = rng.choice([text, [text, {text: [i, text]}], {"a": {}, text: None}, i, [], {}])
    for indent in (None, 3):
        raw = f" {json.dumps(documents, indent=indent, ensure_ascii=False)}\n".encode()
        for size in (1, 2, 3, 11, 100, len(raw)):
            members, inside, depth = [b""], False, 0
            for at in range(0, len(raw), size):
                before = raw[:at]
                escaped = (len(before) - len(before.rstrip(b"\\"))) % 2 == 1
                block = raw[at : at + size]
                first, *rest = keyed_json.cut(block, escaped, inside, depth)
                members[-1] += first
                members += rest
                parity, outside, within = keyed_json.summary(block, escaped)
                depth += within if inside else outside
                inside ^= parity == 1
            assert (inside, depth) == (False, 0)
            own = {}
            for member in members[1:]:
                if member.strip().startswith(b'"'):
                    own |= json.loads(b"{" + member + b"}")
            assert own == documents


def test_canonical_schema(spark, tmp_path):
    path = str(tmp_path / "stars")
    spark.sql("select 'r' as repo, timestamp '2020-01-01 00:00:00' as starred_at, 'u' as user_login, 1 as other").write.parquet(path)
    assert readers.read_canonical(spark, "star_events", path).columns == ["repo", "starred_at", "user_login"]


def test_star_and_lint_documents(spark, rows):
    stars = json.dumps({"data": {"repository": {"name": "r", "stargazers": {"edges": [
        {"cursor": "1", "starredAt": "2020-01-01T00:00:00Z", "node": {"login": "u"}}, {"cursor": "2", "node": {"login": "v"}},
    ]}}}})
    docs = spark.createDataFrame([("r", stars)], "repo string, doc string")
    assert rows(readers.star_events_of(docs), "repo", "user_login") == [("r", "u")]
    lint = json.dumps({"c1": {"date": "2020-01-01 00:00:00", "messages": {}, "stats": {
        "statement": 5, "by_msg": {"x": 2}, "repository_name": "r", "empty": {}}}})
    docs = spark.createDataFrame([("r", lint)], "repo string, doc string").withColumn("doc", F.parse_json("doc"))
    assert rows(readers.lint_stats_of(docs), "commit_hash", "key", "value") == [
        ("c1", "stats.by_msg.x", 2.0), ("c1", "stats.statement", 5.0),
    ]


def test_csv_round_trip(spark, tmp_path, rows):
    path = str(tmp_path / "csv")
    df = spark.sql("select * from values ('b', 1.5D, array(1, 2)), ('a', null, array()) as t(repo, v, l)")
    writers.write_csv(df, path, ["repo"])
    read = readers.read_csv(spark, path, "repo string, v double, l string")
    assert rows(read) == [("a", None, "[]"), ("b", 1.5, "[1,2]")]
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert "a,nan,[]" in text and text.startswith("repo,v,l\n")


def test_outputs_of_a_run(spark, tmp_path):
    run = writers.run_name(datetime(2024, 5, 6, 7, 8))
    assert run == "2024-05-06_07-08"
    df = spark.sql("select 'r' as repo, timestamp '2020-01-01 00:00:00' as date, named_struct('a', 1) as s")
    written = writers.write_outputs({"t": df, "plain": df.drop("repo")}, str(tmp_path), run, ("csv", "json", "parquet"))
    assert sorted(written) == ["plain.csv", "plain.json", "plain.parquet", "t.csv", "t.json", "t.parquet"]
    doc = readers.read_documents(spark, written["t.json"]).select("repo", F.to_json("doc").alias("doc")).first()
    assert json.loads(doc.doc) == {"date": "2020-01-01 00:00:00Z", "s": {"a": 1}}
    with pytest.raises(ValueError):
        writers.write_outputs({"t": df}, str(tmp_path), run, ("xml",))


def test_new_documents_replace_whole_ones(spark, tmp_path):
    path = str(tmp_path / "docs")
    for step in ({"a": {"x": 1, "y": 2}, "b": {"z": 1}}, {"a": {"x": 3}, "c": {}}):
        docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in step.items()], "repo string, doc string")
        writers.update_documents(docs.withColumn("doc", F.parse_json("doc")), path)
    got = readers.read_documents(spark, path).select("repo", F.to_json("doc").alias("doc")).collect()
    assert {r.repo: json.loads(r.doc) for r in got} == {"a": {"x": 3}, "b": {"z": 1}, "c": {}}


def test_parts_are_bounded_and_whole(spark):
    df = spark.range(5000).selectExpr("if(id < 4000, 'hot', concat('k', id % 10)) as k", "id")
    parts = in_parts(df, ["k"], max_rows=500)
    sizes = parts.groupBy("k", "part").count().collect()
    assert sum(s["count"] for s in sizes) == 5000
    assert max(s["count"] for s in sizes) < 700
    assert sum(s.k == "hot" for s in sizes) == 8


def test_raw_store(spark, tmp_path, rows):
    store = RawStore(spark, str(tmp_path / "raw"))
    assert store.read("metadata") is None
    docs = spark.createDataFrame([("r", '{"a":1}')], "repo string, doc string")
    stars = spark.sql("select 'r' as repo, timestamp '2020-01-01 00:00:00' as starred_at, 'u' as user_login")
    git = spark.sql("select 'g' as repo, 3 as total_commits, array('a') as developers")
    files = spark.sql(
        "select 'r' as repo, 'c' as commit_hash, concat('f', id, '.py') as path, true as parsed, array('pytest') as imports,"
        " array() as unittest_classes, array('test_a') as pytest_functions, 0L as production_statements, 2L as test_statements from range(3)"
    )
    commits = spark.sql("select 'r' as repo, 'c' as commit_hash, timestamp '2020-01-01 00:00:00' as date, 1.0D as test_to_code_ratio")
    messages = spark.sql(
        "select 'r' as repo, 'c' as commit_hash, 'm' as module, 'warning' as category, concat('W', id % 2) as msg_id,"
        " 's' as symbol, 'text' as msg, 'HIGH' as confidence, 'm.py' as path from range(5)"
    )
    stats = spark.sql("select 'r' as repo, 'c' as commit_hash, timestamp '2020-01-01 00:00:00' as committer_date, 'stats.warning' as key, 5.0D as value")
    for run in ("2024-01-01_00-00", "2024-01-01_00-01"):
        store.append_metadata(docs, run)
        store.append_stargazers(stars, run)
        store.append_git(git, run)
        store.append_tests(files, commits, run)
        store.append_lints(messages, stats, run)

    before = store.read("metadata").count()
    store.append_metadata(docs, "2024-01-01_00-01")  # a retried run replaces its own rows
    assert store.read("metadata").count() == before == 2
    assert rows(store.read("repositories")) == [("g",), ("r",)]
    assert rows(store.read("metadata"), "repository_name", "data", "run_ts") == [
        ("r", '{"a":1}', "2024-01-01_00-00"), ("r", '{"a":1}', "2024-01-01_00-01"),
    ]
    assert json.loads(store.read("gits").first()["data"]) == {"total_commits": 3, "developers": ["a"]}
    stored = store.read("stargazers").select(F.col("repository_name").alias("repo"), F.col("data").alias("doc"))
    assert rows(readers.star_events_of(stored).distinct(), "repo", "user_login") == [("r", "u")]
    test = store.commits_of("test")
    assert test.count() == 2 and set(json.loads(test.first().files)) == {"f0.py", "f1.py", "f2.py"}
    lint = store.commits_of("lint")
    found = json.loads(lint.first().totals)["m"]
    assert lint.count() == 2 and found["total_messages"] == 5 and found["categories"]["warning"]["total"] == 5
    assert found["categories"]["warning"]["message_ids"] == {"W0": 3, "W1": 2}
    ids = json.loads(lint.first().messages)["m"]["warning"]
    assert {k: v[0]["occurrences"] for k, v in ids.items()} == {"W0": 3, "W1": 2}
    assert json.loads(lint.first().stats) == {"stats.warning": 5.0}


def test_stored_runs_are_read_back(spark, tmp_path, rows):
    """In small parts and over two runs, everything comes back as it was appended."""
    store = RawStore(spark, str(tmp_path / "raw"), max_rows=3)
    messages = spark.sql(
        "select concat('r', id % 2) as repo, 'c' as commit_hash, timestamp '2020-01-01 00:00:00' as committer_date,"
        " concat('m', id % 7) as module, if(id % 3 = 0, 'warning', 'refactor') as category, concat('W', id % 2) as msg_id,"
        " 's' as symbol, if(id % 10 = 0, null, concat('say \"', id % 5, '\"')) as msg, 'HIGH' as confidence, 'm.py' as path from range(60)"
    )
    stats = spark.sql(
        "select repo, 'c' as commit_hash, timestamp '2020-01-01 00:00:00' as committer_date, concat('stats.k', id) as key,"
        " cast(id as double) as value from values ('r0'), ('r1') as t(repo) cross join range(8)"
    )
    files = spark.sql(
        "select 'r0' as repo, 'c' as commit_hash, concat('f', id, '.py') as path, true as parsed, array('pytest') as imports,"
        " array('T') as unittest_classes, array() as pytest_functions, id as production_statements, 2L as test_statements from range(9)"
    )
    commits = spark.sql("select 'r0' as repo, 'c' as commit_hash, timestamp '2020-01-01 00:00:00' as date, 1.0D as test_to_code_ratio")
    stars = spark.sql("select 'r0' as repo, timestamp '2020-01-01 00:00:00' + make_dt_interval(id) as starred_at, 'u' as user_login from range(8)")
    git = spark.sql("select 'r0' as repo, 3L as total_commits, 0.5D as average_hunks")
    for run in ("1", "2"):
        store.append_lints(messages if run == "1" else messages.where("repo = 'r0'"), stats, run)
        store.append_tests(files, commits, run)
        store.append_stargazers(stars, run)
        store.append_git(git.withColumn("total_commits", F.lit(int(run)).cast("long")), run)
        store.append_metadata(git.select("repo", F.lit('{"a":1}').alias("doc")), run)

    columns = [c for c in messages.columns]
    assert rows(store.lint_messages("1"), *columns) == rows(messages, *columns)
    assert rows(store.lint_messages("latest"), *columns) == rows(messages.where("repo = 'r0'"), *columns)
    assert store.lint_messages().count() == 90
    from repostrata.operators.lint import message_counts

    want = message_counts(messages).where("level < 7")
    level = ["repo", "commit_hash", "module", "category", "msg_id", "level", "messages"]
    assert rows(store.lint_counts("1"), *level) == rows(want, *level)
    assert store.read("lint_commits", "1").where("messages is not null").count() > 10
    assert rows(store.lint_stats("1"), *stats.columns) == rows(stats)
    kept = [c for c in files.columns]
    assert rows(store.classified_files("2"), *kept) == rows(files, *kept)
    assert rows(store.star_events("2"), *stars.columns) == rows(stars)
    assert rows(store.git_rows("total_commits bigint, average_hunks double", "latest")) == [("2", "r0", 2, 0.5)]
    assert store.documents("latest").count() == 1
    with pytest.raises(ValueError, match="nothing was stored"):
        RawStore(spark, str(tmp_path / "none")).star_events()


def test_lint_documents_are_grouped_once(spark):
    """One sort and one pass over neighbours makes all documents, cut or not, with whole totals."""
    from repostrata.session import tune
    from repostrata.sources.rawstore import distinct_messages, lint_documents

    messages = spark.sql(
        "select 'r' as repo, concat('c', if(id < 90, 0, id)) as commit_hash, concat('m', id % 3) as module, if(id % 2 = 0, 'warning', null)"
        " as category, concat('W', id % 5) as msg_id, 's' as symbol, concat('x', id) as msg, 'HIGH' as confidence, 'm.py' as path from range(93)"
    )
    stats = spark.sql("select 'r' as repo, 'c0' as commit_hash, timestamp '2020-01-01 00:00:00' as committer_date, 'k' as key, 1.0D as value")
    tune(spark)
    found = lint_documents(distinct_messages(messages), stats, max_rows=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 1 and "SortMergeJoin" not in plan and "collect_list" not in plan.split("SortAggregate")[0]
    got = found.collect()
    big = [r for r in got if r.commit_hash == "c0"]
    assert 3 <= len(big) <= 5 and len({r.part for r in big}) == len(big) and len({r.date for r in big}) == 1
    totals, entries = {}, []
    for r in big:
        found = json.loads(r.totals or "{}")
        assert not set(found) & set(totals)
        totals |= found
        for module, categories in json.loads(r.messages or "{}").items():
            entries += [(module, c, i, e["msg"]) for c, ids in categories.items() for i, es in ids.items() for e in es]
    want = [(f"m{i % 3}", "warning" if i % 2 == 0 else "", f"W{i % 5}", f"x{i}") for i in range(90)]
    assert sorted(entries) == sorted(want)
    assert {m: t["total_messages"] for m, t in totals.items()} == {"m0": 30, "m1": 30, "m2": 30}
    assert totals["m0"]["categories"][""] == {"total": 15, "message_ids": {f"W{i}": 3 for i in range(5)}}
    small = [r for r in got if r.commit_hash != "c0"]
    assert len(small) == 3 and all(json.loads(r.totals).popitem()[1]["total_messages"] == 1 and r.stats is None for r in small)


class Unset:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = self
        self.master = master
        self.folder = None

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_dir_follows_the_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named
    local = Unset("local[2]")
    assert shared_dir(local) == local.folder
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Unset("yarn"))


def test_tune_sizes_shuffles(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        tune(spark, shuffle_bytes=10 * 1024**3)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "80"
        tune(spark, shuffle_bytes=1)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "80"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_csv_text_keeps_its_shape(spark, tmp_path, rows):
    path = str(tmp_path / "csv")
    data = [("a", 'line1\nline2, "q"', ["x", 'y"z']), ("b", "back\\slash", [])]
    writers.write_csv(spark.createDataFrame(data, "repo string, t string, l array<string>"), path, ["repo"])
    want = [("a", data[0][1], '["x","y\\"z"]'), ("b", data[1][1], "[]")]
    assert rows(readers.read_csv(spark, path, "repo string, t string, l string")) == want
    read = []
    for part in sorted((tmp_path / "csv").glob("*.csv")):
        with open(part, newline="") as file:
            read += [tuple(r) for r in csv.reader(file)][1:]
    assert sorted(read) == want


def test_scratch_tables_can_be_released(spark):
    kept = pinned(spark.range(3))
    assert kept.count() == 3
    where = kept.inputFiles()[0].rpartition("/")[0]
    discard(spark, where)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(where)


def lint_rows(spark):
    """Messages of a large and of small commits, some equal, with missing values; statistics of them."""
    messages = spark.sql(
        "select if(id % 3 = 0, null, 'r') as repo, concat('c', if(id < 240, id % 2, id)) as commit_hash, concat('m', id % 7) as module,"
        " if(id % 5 = 0, null, 'warning') as category, concat('W', id % 4) as msg_id, 's' as symbol, if(id % 11 = 0, null, concat('x', id % 20))"
        " as msg, 'HIGH' as confidence, 'm.py' as path, timestamp '2020-01-01 00:00:00' as committer_date from range(250)"
    )
    stats = messages.groupBy("repo", "commit_hash", "committer_date", F.concat("module", "msg_id").alias("key"))
    return messages, stats.agg(F.count(F.lit(1)).cast("double").alias("value"))


@pytest.mark.parametrize("max_rows, max_list", [(10_000, 10_000), (7, 10_000), (7, 8), (20, 30)])
def test_lint_documents_are_whole_however_they_are_cut(spark, tmp_path, rows, max_rows, max_list):
    from repostrata.operators.lint import message_counts
    from repostrata.sources.rawstore import distinct_messages, lint_documents

    messages, stats = lint_rows(spark)
    each = messages.fillna("", ["category"]).withColumn("occurrences", F.lit(1).cast("bigint"))
    documents = lint_documents(each, stats, max_rows, max_list).withColumnsRenamed({"repo": "repository_name", "commit_hash": "hash"})
    documents.withColumn("run_ts", F.lit("1")).write.partitionBy("run_ts").parquet(f"{tmp_path}/lint_commits")
    store = RawStore(spark, str(tmp_path))
    columns = each.drop("occurrences", "committer_date").columns
    assert rows(store.lint_messages("1"), *columns) == rows(each, *columns)
    level = ["repo", "commit_hash", "module", "category", "msg_id", "level", "messages"]
    want = message_counts(each).where("level < 7")
    assert rows(store.lint_counts("1"), *level) == rows(want, *level)
    modules = store.lint_counts("1", modules_only=True)
    assert rows(modules, *level) == rows(want.where("level = 3"), *level) and modules.columns == store.lint_counts("1").columns
    assert rows(store.lint_stats("1"), *stats.columns) == rows(stats)
    found = store.read("lint_commits")
    assert found.groupBy("repository_name", "hash", "part").count().where("count > 1").isEmpty()
    # An entry is stored once, with its occurrences.
    entries = F.regexp_count("messages", F.lit('"occurrences"'))
    assert found.agg(F.sum(entries)).first()[0] == distinct_messages(messages).count()
    if max_rows == 7 and max_list > 8:
        sizes = found.select(F.max(entries), F.max(F.regexp_count("stats", F.lit(":")))).first()
        assert max(sizes) <= 7


def test_keys_of_many_rows_are_found(spark, rows):
    from repostrata.sources.rawstore import crowded_keys

    counts = spark.sql("select if(id < 50, null, if(id < 90, 'b', concat('k', id))) as k, 2 as rows from range(400)")
    assert rows(crowded_keys(counts, 79)) == [("b",), (None,)]
    assert rows(crowded_keys(counts, 80)) == [(None,)]
    assert crowded_keys(counts, 100) is None


def test_small_commits_are_brought_together_in_one_small_shuffle(spark, tmp_path):
    """Statistics go as lists, messages as they come: no joins, no other shuffle."""
    from repostrata.sources.rawstore import lint_documents, stat_lists

    messages, stats = lint_rows(spark)
    lists = stat_lists(stats)
    assert lists.count() < stats.count() / 2 and lists.agg(F.sum("rows")).first()[0] == stats.count()
    assert all(".zstd." in f for f in lists.inputFiles())
    local = stat_lists(stats.repartition("commit_hash", "repo"))
    assert local.count() == stats.select("repo", "commit_hash").distinct().count()
    # In small parts as well, whose commits are all cut.
    plan = lint_documents(messages.withColumn("occurrences", F.lit(1).cast("bigint")), lists, max_rows=3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange") == 1


def test_appending_leaves_no_shuffle_files(spark, tmp_path):
    import gc
    import time

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().endswith(".data")}

    messages, stats = lint_rows(spark)
    stats = stats.localCheckpoint()
    store = RawStore(spark, str(tmp_path / "raw"))
    gc.collect()
    before, setting = shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    store.append_lints(messages, stats, "1")
    for _ in range(100):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get(setting, None) == was


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_statistics_are_grouped_in_as_many_partitions_as_there_are(spark):
    """Several keys of each message take more room than what is shuffled, by which partitions would be merged."""
    from repostrata.sources.adapters import TestTables

    stats = TestTables(spark, "/root/testdata/sf0.001").lint_stats()
    used = stats.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
