import glob

import pytest
from pyspark.sql import functions as F

from reviewloom.session import scratch_path
from reviewloom.sources import bundles
from reviewloom.sources.bundles import BundleError, open_bundle, save_bundle


def tables(spark, n):
    wide = spark.range(n).select("id", F.concat(F.lit("line one\nline two "), "id").alias("text")).repartition(3)
    return {"rows": wide, "few": spark.createDataFrame([(n, "x")], "n long, s string")}


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_the_newest_whole_save_is_read(spark, fmt):
    folder = scratch_path(spark, "bundle")
    with pytest.raises(BundleError):
        open_bundle(spark, folder)
    for n in (5, 0, 9):
        paths = save_bundle(tables(spark, n), folder, fmt, as_csv=["few"], gzip=["few"])
        at = open_bundle(spark, folder)
        assert paths == {"rows": f"{at}/rows", "few": f"{at}/few"}
        if fmt == "parquet":
            assert spark.read.parquet(f"{at}/rows").count() == n
        assert spark.read.option("header", True).csv(f"{at}/few").first()["n"] == str(n)


def test_a_save_that_dies_between_tables_leaves_the_bundle(spark, monkeypatch):
    folder = scratch_path(spark, "bundle")
    before = save_bundle(tables(spark, 5), folder)
    real = bundles.save_table

    def dies(df, path, *how):
        if path.endswith("/few"):
            raise RuntimeError("lost")
        real(df, path, *how)

    monkeypatch.setattr(bundles, "save_table", dies)
    with pytest.raises(RuntimeError):
        save_bundle(tables(spark, 7), folder)
    monkeypatch.undo()
    assert before["rows"] == open_bundle(spark, folder) + "/rows"
    after = save_bundle(tables(spark, 8), folder)
    assert after["rows"] == open_bundle(spark, folder) + "/rows"


def test_changed_or_missing_files_are_found(spark):
    folder = scratch_path(spark, "bundle")
    paths = save_bundle(tables(spark, 50), folder)
    spark.range(49).write.mode("overwrite").csv(paths["rows"])
    with pytest.raises(BundleError, match="rows"):
        open_bundle(spark, folder)
    assert open_bundle(spark, folder, check=["few"])
    with pytest.raises(BundleError, match="no table"):
        open_bundle(spark, folder, check=["other"])


def test_names_that_collide_write_nothing(spark):
    folder = scratch_path(spark, "bundle")
    long = "x" * 40
    one = spark.range(1)
    for bad in ({long + "a": one, long + "b": one}, {"manifest": one}, {}):
        with pytest.raises(ValueError):
            save_bundle(bad, folder)
    assert not glob.glob(f"{folder}/*")
