import pytest

from repostrata.operators import upsert
from repostrata.operators.buckets import BucketTable, bucket_of, split_from
from repostrata.sources import readers, writers
from repostrata.streaming.refresh import upsert_stream

ROWS = "repo string, day long, v long, at long"


def test_keep_last_and_merge(spark, rows):
    old = spark.createDataFrame([("r", 1, 1)], "repo string, day long, v long")
    new = spark.createDataFrame([("r", 1, 2, "x"), ("s", 1, 5, "y")], "repo string, day long, v long, extra string")
    once = upsert.merge(old, new, ["repo", "day"])
    assert rows(once) == [("r", 1, 2, "x"), ("s", 1, 5, "y")]
    assert rows(upsert.merge(once, new, ["repo", "day"])) == rows(once)
    doubled = spark.createDataFrame([("r", 1, 1, 1), ("r", 1, 2, 2)], ROWS)
    assert rows(upsert.merge(None, doubled, ["repo", "day"], ["at"])) == [("r", 1, 2, 2)]


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(10_000).selectExpr("concat('r', id % 3) as repo", "id as at")
    plan = upsert.keep_last(df, ["repo"], ["at"])._jdf.queryExecution().executedPlan().toString()
    partial = plan[: plan.index("Exchange")].count("WindowGroupLimit"), plan[plan.index("Exchange"):].count("WindowGroupLimit")
    assert partial == (1, 1)


def test_new_keys(spark, rows):
    incoming = spark.createDataFrame([("a",), ("b",), ("b",)], "repo string")
    existing = spark.createDataFrame([("a",)], "repo string")
    assert rows(upsert.new_keys(incoming, existing, "repo")) == [("b",)]


def test_table_upsert_is_idempotent_and_keeps_other_buckets(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(f"r{i}", 1, i, 1) for i in range(50)], ROWS)
    second = spark.createDataFrame([("r3", 1, 99, 2), ("new", 1, 7, 1)], ROWS)
    upsert.upsert_table(first, path, ["repo", "day"], ["at"], buckets=8)
    for _ in range(2):
        upsert.upsert_table(second, path, ["repo", "day"], ["at"], buckets=8)
    upsert.upsert_table(first.limit(0), path, ["repo", "day"], ["at"], buckets=8)
    got = rows(upsert.read_table(spark, path).select("repo", "day", "v", "at"))
    want = [(f"r{i}", 1, i, 1) for i in range(50) if i != 3] + [("r3", 1, 99, 2), ("new", 1, 7, 1)]
    assert got == sorted(want, key=repr)
    with pytest.raises(ValueError):
        upsert.upsert_table(first, path, ["repo"], bucket_by=["day"])


def test_a_new_column_reaches_old_buckets_as_null(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    upsert.upsert_table(spark.createDataFrame([(f"r{i}", i) for i in range(20)], "repo string, v long"), path, ["repo"])
    wider = spark.createDataFrame([("r1", 50, "x")], "repo string, v long, extra string")
    for _ in range(2):
        upsert.upsert_table(wider, path, ["repo"])
    got = rows(upsert.read_table(spark, path).select("repo", "v", "extra"))
    assert len(got) == 20 and ("r1", 50, "x") in got and ("r2", 2, None) in got


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path, rows):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    data = [(f"r{i % 5}", i % 3, i * 13 % 101, i) for i in range(200)]
    for start in range(0, 200, 50):
        spark.createDataFrame(data[start:start + 50], ROWS).coalesce(1).write.mode("append").parquet(source)
    want = rows(upsert.keep_last(spark.read.parquet(source), ["repo", "day"], ["at"]))
    for run in ("one", "two"):
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
        upsert_stream(stream, path, str(tmp_path / run), ["repo", "day"], ["at"], buckets=4).awaitTermination()
        assert rows(upsert.read_table(spark, path).select("repo", "day", "v", "at")) == want


def contents(root):
    """Modification time and bytes of every data file."""
    return {str(p): (p.stat().st_mtime_ns, p.read_bytes()) for p in root.rglob("part-*")}


def test_buckets_split_as_the_table_grows(spark, tmp_path, rows):
    """From 4 to 64 buckets over six upserts; the rows are those of one merge."""
    path, seen, want, size = tmp_path / "t", [], None, 16 * 1024
    for step in range(6):
        key = f"(id * 7 + {step} * 311) % 1900"
        note = "concat_ws('', transform(sequence(1, 12), k -> sha2(concat(id, k), 256)))"
        lot = spark.range(400).selectExpr(f"concat('r', {key}) as repo", "1L as day", f"id + {step} as v", f"{step}L as at", f"{note} as note")
        upsert.upsert_table(lot, str(path), ["repo", "day"], ["at"], buckets=4, target=size)
        want = lot if want is None else want.unionByName(lot)
        seen.append(BucketTable(spark, str(path)).state["buckets"])
    assert rows(upsert.read_table(spark, str(path))) == rows(upsert.keep_last(want, ["repo", "day"], ["at"]))
    assert seen == sorted(seen) and seen[0] < 40 and 64 <= seen[-1] < 128
    table = BucketTable(spark, str(path))
    assert sum(table.state["bytes"].values()) <= size * table.state["buckets"]
    assert max(table.state["bytes"].values()) < 4 * size
    assert len(list(path.glob("generation-*/__bucket=*"))) == len(table.state["in"])
    with pytest.raises(ValueError):
        BucketTable(spark, str(path), target=100)


@pytest.mark.parametrize("now", [1, 2, 3, 5, 8, 13])
def test_a_new_bucket_takes_rows_of_one_other(spark, now):
    df = spark.range(2000).select(bucket_of(["id"], now).alias("old"), bucket_of(["id"], now + 1).alias("new"))
    moved = {(r.old, r.new) for r in df.where("old <> new").distinct().collect()}
    assert moved == {(split_from(now), now)}
    assert {r.new for r in df.select("new").distinct().collect()} == set(range(now + 1))


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = tmp_path / "docs"
    docs = spark.range(500).selectExpr("concat('r', id) as repo", "parse_json(concat('{\"a\":', id, '}')) as doc")
    writers.update_documents(docs, str(path), buckets=16)
    before = contents(path)
    writers.update_documents(docs.where("repo in ('r3', 'r77')").selectExpr("repo", "parse_json('{\"b\":1}') as doc"), str(path))
    after = contents(path)
    same = set(before) & set(after)
    assert len(same) >= 14 and len(set(after) - same) <= 2 and all(before[p] == after[p] for p in same)
    got = {r.repo: r.doc for r in readers.read_documents(spark, str(path)).selectExpr("repo", "to_json(doc) as doc").collect()}
    assert len(got) == 500 and got["r3"] == got["r77"] == '{"b":1}' and got["r4"] == '{"a":4}'


def test_the_ledger_lists_what_was_applied(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    lot = lambda v: spark.createDataFrame([("r", 1, v, 0)], ROWS)
    done = [upsert.upsert_table(lot(v), path, ["repo", "day"], batch=("s", n)) for n, v in ((0, 10), (2, 12), (1, 11), (2, 99), (0, 98))]
    assert done == [True, True, True, False, False]
    assert rows(upsert.read_table(spark, path)) == [("r", 1, 11, 0)]
    assert upsert.upsert_table(lot(50).limit(0), path, ["repo", "day"], batch=("s", 3))
    assert BucketTable(spark, path).state["applied"] == {"s": [3, []]}
    assert not upsert.upsert_table(lot(51), path, ["repo", "day"], batch=("s", 3))
    assert upsert.upsert_table(lot(60), path, ["repo", "day"], batch=("other", 0))
    assert rows(upsert.read_table(spark, path)) == [("r", 1, 60, 0)]


def test_a_writer_lost_before_publishing_changes_nothing(spark, tmp_path, rows, monkeypatch):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(f"r{i}", 1, i, 1) for i in range(20)], ROWS)
    upsert.upsert_table(first, path, ["repo", "day"])

    def lost(self, state):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(BucketTable, "_publish", lost)
        with pytest.raises(RuntimeError):
            upsert.upsert_table(first.selectExpr("repo", "day", "v + 1 as v", "at"), path, ["repo", "day"], batch=("s", 0))
    assert rows(upsert.read_table(spark, path)) == rows(first)
    assert upsert.upsert_table(first.selectExpr("repo", "day", "v + 1 as v", "at"), path, ["repo", "day"], batch=("s", 0))
    assert rows(upsert.read_table(spark, path).selectExpr("repo", "day", "v - 1", "at")) == rows(first)
    # The manifest was written but not yet moved to its place.
    (tmp_path / "t" / "_manifest.json").rename(tmp_path / "t" / "_manifest.json.new")
    assert upsert.read_table(spark, path).count() == 20


def test_star_growth_is_carried_over_batches(spark, tmp_path, rows):
    """In order, late, repeated and incomplete events: after every batch the table is that of all so far."""
    from repostrata.operators.stars import growth_long
    from repostrata.streaming.refresh import growth_stream

    day = "timestamp '2020-01-01 00:00:00' + make_dt_interval(%s)"
    lots = [
        f"select concat('r', id % 2) as repo, {day % 'cast(id % 5 as int)'} as starred_at, concat('u', id) as user_login from range(20)",
        f"select 'r0' as repo, {day % 'cast(id as int) + 7'} as starred_at, 'v' as user_login from range(3)",
        f"select concat('r', id) as repo, {day % 'cast(2 * id as int)'} as starred_at, if(id = 2, null, 'late') as user_login from range(4)",
        f"select 'r1' as repo, {day % '-9'} as starred_at, 'first' as user_login union all select 'r1', {day % '30'}, 'last'",
    ]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for lot in lots:
        spark.sql(lot).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema("repo string, starred_at timestamp, user_login string").parquet(source)
        growth_stream(arriving, path, str(tmp_path / "progress")).awaitTermination()
        want = growth_long(spark.read.parquet(source)).select("repo", "date", "stargazers_count")
        assert rows(upsert.read_table(spark, path)) == rows(want)


def test_a_table_grows_in_few_rewritings(spark, tmp_path, rows, monkeypatch):
    """From one bucket to dozens: not once more for every doubling."""
    stored, real = [], BucketTable._store

    def counted(self, rows, touched, buckets, batch=None):
        stored.append(buckets)
        real(self, rows, touched, buckets, batch)

    monkeypatch.setattr(BucketTable, "_store", counted)
    path = str(tmp_path / "t")
    first = spark.range(60000).selectExpr("id as repo", "id % 7 as day", "id as at", "cast(xxhash64(id) as string) as value")
    upsert.upsert_table(first, path, ["repo", "day"], ["at"], buckets=3, target=8192)
    assert stored[0] == 3 and stored[-1] > 64 and len(stored) <= 5
    assert rows(upsert.read_table(spark, path)) == rows(first)
    table = BucketTable(spark, path)
    for b in (0, 5, stored[-1] - 1):
        own = table.read([b]).select(bucket_of(["repo"], stored[-1]).alias("b")).distinct().collect()
        assert [r.b for r in own] == [b]


def test_new_buckets_come_out_of_the_existing_ones():
    assert [split_from(b) for b in (3, 5, 7, 12)] == [1, 1, 3, 4]
    assert [split_from(b, 3) for b in (3, 5, 7, 12)] == [1, 1, 1, 0]
