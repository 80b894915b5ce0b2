import pytest
from pyspark.sql import functions as F

from rejoinder.sources import sinks


def test_versions_are_whole_and_earlier_ones_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path)
    assert sinks.write_version(spark.range(10), path, rows_per_file=3) == 0
    old = sinks.read_version(spark, path)
    assert sinks.append_column(path, spark, "twice", F.col("id") * 2, ["id"]) and not sinks.append_column(path, spark, "twice", F.lit(0), ["id"])
    assert sorted(old.columns) == ["id"] and old.count() == 10  # a reader that began before goes on
    now = sinks.read_version(spark, path)
    assert now.agg(F.sum("twice")).first()[0] == 90 and sinks.read_version(spark, path, 0).columns == ["id"]
    assert sinks.drop_versions(spark, path) == 1 and sinks.read_version(spark, path).count() == 10
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path, 0)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("_rows") and p.is_dir()]) == 1


@pytest.mark.parametrize("step", ["rows", "draft", "mark"])
def test_a_stop_at_any_step_leaves_a_whole_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    sinks.write_version(spark.range(5), path)

    class Stopped(Exception):
        pass

    def broken(x):
        raise Stopped

    bad = spark.range(7).withColumn("x", F.udf(broken, "int")("id")) if step == "rows" else spark.range(7)
    if step != "rows":
        real = sinks._versions

        class Fs:
            def __init__(self, fs):
                self.fs = fs

            def create(self, *a):
                if step == "draft":
                    raise Stopped
                return self.fs.create(*a)

            def rename(self, *a):
                raise Stopped

            def __getattr__(self, name):
                return getattr(self.fs, name)

        monkeypatch.setattr(sinks, "_versions", lambda s, p: (Fs(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_version(bad, path)
    monkeypatch.undo()
    assert sinks.read_version(spark, path).count() == 5
    assert sinks.write_version(spark.range(9), path) == 1 and sinks.read_version(spark, path).count() == 9


def test_two_writers_of_one_version_cannot_both_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.write_version(spark.range(5), path)
    real = sinks._versions
    seen = real(spark, path)
    sinks.write_version(spark.range(6), path)
    monkeypatch.setattr(sinks, "_versions", lambda s, p: seen)  # the other began before that
    with pytest.raises(RuntimeError, match="another"):
        sinks.write_version(spark.range(7), path)
    monkeypatch.undo()
    assert sinks.read_version(spark, path).count() == 6
