import pathlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewloom.sources.reviews import CSV_PARSE, CSV_READ, load_reviews
from reviewloom.sources.split_csv import read_records, read_split_csv


@pytest.fixture
def small_splits(spark):
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def write(folder, name, rows, end="\n"):
    folder = pathlib.Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes((end.join(rows)).encode())


def read_both(spark, path, names):
    got = read_split_csv(spark, str(path), names, CSV_PARSE).orderBy("row_ix").collect()
    assert [r.row_ix for r in got] == list(range(len(got)))
    whole = spark.read.options(**CSV_READ).csv(str(path)).select(*[F.col(f"`{n}`") for n in names], "_metadata.file_path")
    want = [tuple(r)[:-1] for r in sorted(whole.collect(), key=lambda r: r.file_path)]
    return [tuple(r.row) for r in got], want


def random_field(r):
    text = "".join(r.choice(["a", "é", ",", "\n", '"', " ", "\n\n", "", "字", "b c", ",\n"]) for _ in range(r.randrange(12)))
    return quoted(text) if r.random() < 0.8 or set(text) & set(',\n"') else text


@pytest.mark.parametrize("size", ["13", "64", "1k", "1m"])
def test_equal_to_the_multi_line_reader_wherever_splits_fall(spark, tmp_path, small_splits, size):
    r = random.Random(size)
    for i in range(3):
        rows = [",".join(random_field(r) for _ in range(3)) for _ in range(25)]
        rows = [row for row in rows if row.strip(", ")] + ['x,"' + "long\n" * 40 + '",z', "", "only,two", "", "a,b,c,d"]
        write(tmp_path, f"part-{i}.csv", ['name,"two\nlines",last', *rows, ""][: None if i else -1])
    small_splits(size)
    got, want = read_both(spark, tmp_path, ["name", "two\nlines", "last"])
    assert got == want and len(got) > 75


def test_carriage_returns_empty_files_and_header_only(spark, tmp_path, small_splits):
    small_splits("20")
    write(tmp_path, "a.csv", ["k,v", '1,"x"', "2,y", "", '3,"p\nq"'], "\r\n")
    write(tmp_path, "b.csv", ["k,v"])
    write(tmp_path, "c.csv", ["k,v", "4,", '5,""', ""])
    got, want = read_both(spark, tmp_path, ["k", "v"])
    assert [k for k, _ in got] == ["1", "2", "3", "4", "5"] and got[3:] == want[3:] and got[:2] == want[:2]
    empty = tmp_path / "none"
    write(empty, "a.csv", [""])
    assert read_records(spark, str(empty)).collect() == []


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rows = [f'{i},"line one of {i}\nand ""line"" two, {"x" * (i % 720)}",{i % 7}' for i in range(50_000)]
    write(tmp_path, "r.csv", ["reviewer_name,reviewer_review,reviewer_rating", *rows, ""])
    assert (tmp_path / "r.csv").stat().st_size > 19 << 20
    small_splits("1m")
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() >= 16
    df = load_reviews(spark, str(tmp_path), "csv").select("row_ix", "reviewer_name", "reviewer_review", "reviewer_rating")
    assert df.rdd.getNumPartitions() >= 8
    whole = load_reviews(spark, str(tmp_path), "csv", strict_quotes=False).select(*df.columns)
    assert df.exceptAll(whole).count() == 0 and whole.exceptAll(df).count() == 0 and df.count() == 50_000


def test_a_quote_in_an_unquoted_field_is_an_error(spark, tmp_path):
    write(tmp_path, "r.csv", ["name,reviewer_review", 'a,a 5" screen', "b,x", ""])
    with pytest.raises(PySparkException, match="a quote inside an unquoted field"):
        load_reviews(spark, str(tmp_path), "csv").collect()
    rows = load_reviews(spark, str(tmp_path), "csv", strict_quotes=False).orderBy("row_ix").collect()
    assert [r.reviewer_review for r in rows] == ['a 5" screen', "x"]


def test_nothing_of_whole_records_is_shuffled(spark, tmp_path):
    write(tmp_path, "r.csv", ["a,b", '1,"x\ny"', ""])
    plan = read_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2  # those of pieces that cross splits
