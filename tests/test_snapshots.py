from datetime import datetime

from unitquarry.operators.snapshots import snapshot_changes

CHUNKS = "library string, version string, unit_name string, section string, chunk_type string, identifier string, content string, change_kind string"
RELEASES = "library string, version string, released_at timestamp"


def run(spark, rows, releases):
    r = spark.createDataFrame([(a, v, None if n is None else datetime(2020, 1, n)) for a, v, n in releases], RELEASES)
    c = spark.createDataFrame([(a, v, u, "s", "t", i, x, "old") for a, v, u, i, x in rows], CHUNKS)
    return sorted((r.library or "", r.version or "", r.unit_name or "", r.identifier or "", r.change_kind) for r in snapshot_changes(c, r).collect())


def test_added_removed_changed_and_back(spark):
    rows = [("l", "2", "U", "A", "x"), ("l", "10", "u", "a", "x  \r\ny"), ("l", "3", "U", "a", "x\ny"), ("l", "3", "U", "B", None), ("l", "9", "U", "b", ""), ("l", "2", "U", "C", "c"), ("l", "9", "U", "C", "c")]
    order = [("l", "2", 1), ("l", "10", 2), ("l", "3", 3), ("l", "7", 4), ("l", "9", 5)]
    assert run(spark, rows, order) == [
        ("l", "10", "u", "a", "changed"), ("l", "10", "u", "c", "removed"), ("l", "3", "u", "b", "added"), ("l", "9", "u", "a", "removed"), ("l", "9", "u", "b", "changed"), ("l", "9", "u", "c", "added"),
    ]


def test_repeats_nulls_and_unlisted_versions(spark):
    rows = [("l", "1", "U", "A", "x"), ("l", "1", "U", "A", "x"), ("l", "1", "U", "A", "y"), ("l", "2", "U", "A", "y \n"), ("l", "2", "U", "A", "x"), ("l", "2", None, None, "n"), (None, "1", "U", "A", "x"), (None, None, "U", "A", "z")]
    assert run(spark, rows, [("l", "1", 1), ("l", "2", 2), ("l", "2", 9)]) == [("", "1", "u", "a", "changed"), ("l", "2", "", "", "added"), ("l", "2", "u", "a", "changed")]
    assert run(spark, rows[:5], []) == [("l", "2", "u", "a", "changed")]
    assert run(spark, [], [("l", "1", 1)]) == [] and run(spark, [("l", "1", "U", "A", "x" * 50_000 + " " * 50_000 + "y")], [("l", "1", 1)]) == []
