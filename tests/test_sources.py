import json

from spanloom.sources import ingest as S


def test_receipts_of_one_version(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([json.dumps({"version": 2, "completed": 5}), json.dumps({"version": 1, "completed": 7}), "{broken"]))
    got = S.read_receipts(spark, str(tmp_path), "version INT, completed INT", 2).collect()
    assert [r.completed for r in got] == [5]


def test_only_changed_partitions_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "day int, v string")
    path = str(tmp_path / "out")
    assert sorted(r.day for r in S.write_changed(rows, path, ["day"]).collect()) == [1, 2]
    assert S.write_changed(rows, path, ["day"]).count() == 0
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "d")], "day int, v string")
    assert [r.day for r in S.write_changed(new, path, ["day"]).collect()] == [2]
    assert sorted((r.day, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (1, "b"), (2, "d")]


def test_append_is_idempotent(spark):
    rows = S.with_id(spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "s string, n long"), ["s", "n"])
    new = S.append_new(rows, rows.limit(0))
    assert new.count() == 2 and S.append_new(rows, new).count() == 0


def test_late_rows_fill_and_never_overwrite(spark):
    a = spark.createDataFrame([(1, "app", None, "first"), (2, None, "w", "first")], "id long, app string, win string, status string")
    b = spark.createDataFrame([(1, "other", "late", "done"), (3, "new", None, "done")], "id long, app string, win string, status string")
    got = {r.id: (r.app, r.win, r.status) for r in S.fill_in(a, b, "id", ["app", "win"], ["status"]).collect()}
    assert got == {1: ("app", "late", "done"), 2: (None, "w", "first"), 3: ("new", None, "done")}


def test_commit_cap_comes_after_the_owner_filter(spark):
    rows = [(1, i, i, 9 if i % 2 else 3, 0) for i in range(10)] + [(1, 8, 8, 3, 0)]
    c = spark.createDataFrame(rows, "repo long, sha long, at_us long, author long, committer long")
    got = S.import_commits(c, owner=3, cap=3).orderBy("rank").collect()
    assert [(r.sha, r.truncated) for r in got] == [(8, True), (6, True), (4, True)]


def test_timeline_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, 20, "s"), (1, 10, "s"), (2, 5, "f")], "device long, at_us long, source string")
    S.export_timeline(rows, str(tmp_path / "out"))
    assert [r.at_us for r in spark.read.json(str(tmp_path / "out" / "device=1")).collect()] == [10, 20]
    assert {(r.source, r["rows"]) for r in S.manifest(rows, "source").collect()} == {("s", 2), ("f", 1)}


def test_calendar_scope_has_no_bound(spark):
    items = spark.range(1500).selectExpr("id", "id AS calendar", "10 AS start_us", "20 AS end_us")
    assert S.import_calendar(items, spark.range(1500).withColumnRenamed("id", "calendar"), 0, 100).count() == 1500
