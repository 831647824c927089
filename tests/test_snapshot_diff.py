from tidemill.operators.snapshot_diff import SnapshotIndex, changed_values, diff_all, index_of, probe


SCHEMA = "snapshot_no bigint, id string, a string, b int, change string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_diff(spark):
    df = rows(spark, [
        (1, "x", "1", 1, "c"), (1, "x", "1", 1, "c"), (1, "X", "1", None, "c"), (1, None, "n", 1, "c"), (1, "gone", "1", 1, "c"), (1, "same", None, None, "c"),
        (4, "x", "2", 1, "c"), (4, "X", "1", 0, "c"), (4, None, "m", 1, "c"), (4, "new", "1", 1, "c"), (4, "same", None, None, "other"),
        (5, "x", "2", 1, "c"), (5, "X", "1", 0, "c"), (5, "gone", "1", 1, "c"), (5, "new", "1", 1, "c"), (5, "new", "9", 1, "c"),
    ])
    got = {tuple(r) for r in diff_all(df, "snapshot_no", "id", ["a", "b"]).collect()}
    assert got == {(4, "x", "changed"), (4, "X", "changed"), (4, "gone", "removed"), (4, "new", "added"), (5, "gone", "added"), (5, "same", "removed"), (5, "new", "changed")}
    assert diff_all(df.limit(0), "snapshot_no", "id", ["a"]).count() == 0
    assert diff_all(df.where("snapshot_no = 1"), "snapshot_no", "id", ["a"]).count() == 0


def test_kept_index(spark, tmp_path):
    one = rows(spark, [(1, "x", "1", 1, ""), (1, "y", "1", None, "")])
    two = rows(spark, [(2, "x", "1", 2, ""), (2, "z", "1", 1, "")])
    index = SnapshotIndex(spark, str(tmp_path / "i"), "id", ["a", "b"], buckets=4)
    assert index.apply(one).count() == 0 and index.fetch().count() == 0
    assert {tuple(r) for r in index.apply(two).collect()} == {("x", "changed"), ("y", "removed"), ("z", "added")}
    assert [tuple(r) for r in index.fetch().collect()] == [("x", "b", "1", "2")]
    assert index.apply(two).count() == 0
    found = probe(index_of(one, "id", ["a", "b"]), index_of(two, "id", ["a", "b"]))
    assert changed_values(one, two, found, "id", ["a", "b"]).count() == 1


def test_middle_row_of_several_counts(spark):
    """A key with three rows is changed when any of them changes, and only then, whatever their order and repeats."""
    before = [(1, f"k{i}", str(j), i, "") for i in range(100) for j in range(3)]
    after = [(2, f"k{i}", "x" if j == i % 3 and i % 2 else str(j), i, "") for i in range(100) for j in (2, 0, 1, 1)]
    got = {tuple(r) for r in diff_all(rows(spark, before + after), "snapshot_no", "id", ["a", "b"]).collect()}
    assert got == {(2, f"k{i}", "changed") for i in range(1, 100, 2)}


def test_broken_off_before_the_swap(spark, tmp_path, monkeypatch):
    from tidemill.operators import snapshot_diff

    one, two = rows(spark, [(1, "x", "1", 1, ""), (1, "y", "1", 1, "")]), rows(spark, [(2, "x", "2", 1, "")])
    at = f"file://{tmp_path}/i"
    index = SnapshotIndex(spark, at, "id", ["a", "b"], buckets=4)
    index.apply(one)

    def fail(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(snapshot_diff, "publish", fail)
        try:
            index.apply(two)
        except OSError:
            pass
    again = SnapshotIndex(spark, at, "id", ["a", "b"], buckets=4)  # another session's view: only files and the pointer
    assert {tuple(r) for r in again.apply(two).collect()} == {("x", "changed"), ("y", "removed")}
    assert [tuple(r) for r in again.fetch().collect()] == [("x", "a", "1", "2")]
    assert again.apply(one).count() == 2 and again.fetch().count() == 1


def test_probe_shuffles_nothing(spark, tmp_path):
    index = SnapshotIndex(spark, f"file://{tmp_path}/i", "id", ["a"], buckets=8)
    index.apply(rows(spark, [(1, "x", "1", 1, "")]))
    old = index.current()
    index.apply(rows(spark, [(1, "x", "2", 1, "")]))
    plan = probe(index._index(old, old["version"]), index._index(index.current(), index.current()["version"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
