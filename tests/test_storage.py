import pytest

from millrace.sources import tables


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, path)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    assert tables.write_version(one, path) == 1
    changed = tables.upsert(tables.read_version(spark, path), spark.createDataFrame([(2, "c"), (3, "d")], one.schema), "id")
    assert tables.write_version(changed, path) == 2
    assert sorted(map(tuple, tables.read_version(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert tables.read_version(spark, path, 1).count() == 2
    assert tables.delete_keys(changed, one, "id").count() == 1
    tables.append(one, f"{path}-log")
    tables.append(one, f"{path}-log")
    assert spark.read.parquet(f"{path}-log").count() == 4


def test_json_log(spark, tmp_path):
    (tmp_path / "log").write_text('{"phase": "a", "seq": 1}\n{bad\n')
    good, bad = tables.read_json_log(spark, f"file://{tmp_path}/log", "phase string, seq int")
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and bad.count() == 1
