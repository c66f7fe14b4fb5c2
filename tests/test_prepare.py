from pyspark.sql import functions as F

from reviewloom.operators import prepare as pr
from reviewloom.params import Params
from reviewloom.plans.study import Study
from reviewloom.sources import writers as wr
from reviewloom.sources.reviews import load_reviews, load_table, read_lexicon, spread_small_input
from reviewloom.session import scratch_path

COLUMNS = "row_ix long, name string, reviewer_name string, url string, reviewer_title string, reviewer_review string, reviewer_rating string, reviewer_published_date string"
ROWS = [
    (1, "HM", "ann", "u1", "Late", "the parcel never came at all", "1", "2021-05-02"),
    (2, "H&M", "ann", "u2", "Late", "the parcel  never came at\nall", "2", "2021-05-03"),  # copy of 1 once clean
    (3, "HM", None, "u3", None, "the parcel never came at all", "1", "bad date"),
    (4, "HM", None, "u4", None, "the parcel never came at all", "3", None),  # null reviewer equals null
    (5, "Zara", "bob", "u5", "Good", "all fine and quick this time", "4", "2021-01-01"),  # too many stars
    (6, "Zara", "bob", "u6", "Ok", "short", "3", "2021-01-01"),  # too short
    (7, "Zara", "bob", "u7", None, "nothing wrong except the price tag", "n/a", "2021-01-01"),
    (8, "Gap", "eve", "u8", None, "an unlisted brand with enough words", "3", "2020-01-01"),
    (9, "ZARA", "bob", "u9", "x", "mail me at a@b.example or 021 555 0199 now", "2.0", "2019-07-09"),
]


def prepared(spark, parts=1):
    return pr.prepare_reviews(spark.createDataFrame(ROWS, COLUMNS).repartition(parts), Params())


def test_prepare_hand_case(spark):
    rows = pr.sort_reviews(prepared(spark)).collect()
    assert [r.row_ix for r in rows] == [1, 3, 9, 8]
    by_ix = {r.row_ix: r for r in rows}
    assert by_ix[1].brand == "H&M" and by_ix[1].brand_ord == 1
    assert by_ix[8].brand is None and by_ix[8].brand_ord is None
    assert by_ix[9].review_text == "mail me at [REDACTED_EMAIL] or [REDACTED_PHONE] now"
    assert by_ix[9].review_full_text == "x. " + by_ix[9].review_text and by_ix[9].token_count == 8
    assert str(by_ix[9].review_month) == "2019-07-01" and by_ix[3].review_month is None
    assert by_ix[9].reviewer_rating == 2.0


def test_dedupe_does_not_depend_on_partitions(spark):
    expected = sorted(tuple(r) for r in prepared(spark).collect())
    for parts in (4, 16):
        assert sorted(tuple(r) for r in prepared(spark, parts).collect()) == expected


def test_dedupe_with_a_third_of_all_rows_alike(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_ix"), F.when(F.col("id") % 3 == 1, "copy").otherwise(F.col("id").cast("string")).alias("t")
    )
    kept = pr.dedupe_keep_first(df.repartition(8), ["t"])
    assert kept.count() == 2001 and kept.filter("t = 'copy'").first().row_ix == 1


def test_dedupe_keys_do_not_run_together(spark):
    df = spark.createDataFrame([(1, "ab", "c"), (2, "a", "bc"), (3, None, "x"), (4, "", "x"), (5, None, "x")], "row_ix long, a string, b string")
    assert sorted(r.row_ix for r in pr.dedupe_keep_first(df, ["a", "b"]).collect()) == [1, 2, 3, 4]


def test_drop_contact_columns_ignores_missing(spark):
    df = spark.createDataFrame([(1, "e", "p")], "row_ix long, email string, other string")
    assert pr.drop_contact_columns(df).columns == ["row_ix", "other"]


def test_csv_reviews_and_lexicon(spark):
    folder = scratch_path(spark, "csv")
    raw = spark.createDataFrame(
        [("HM", "a, \"quoted\"\nline", "", None), ("Zara", "x", "t", "3")],
        "name string, reviewer_review string, reviewer_title string, reviewer_rating string",
    ).coalesce(1)
    from reviewloom.sources.reviews import REVIEW_SCHEMA

    full = raw.select(*[F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string").alias(f.name) for f in REVIEW_SCHEMA if f.name != "row_ix"])
    wr.save_table(full, folder)
    rows = load_reviews(spark, folder, "csv").orderBy("row_ix").collect()
    assert [r.reviewer_review for r in rows] == ["a, \"quoted\"\nline", "x"]
    assert rows[0].reviewer_title == "" and rows[0].reviewer_rating is None and rows[0].row_ix < rows[1].row_ix

    path = scratch_path(spark, "lexicon")
    spark.createDataFrame([("good\t1.9\t0.5\t[1, 2]",), ("bad\t-2.5\t0.1\t[3]",)], "l string").coalesce(1).write.text(path)
    assert read_lexicon(spark, path) == {"good": 1.9, "bad": -2.5}


def csv_file(folder, name, rows, header="name,reviewer_review,extra"):
    import pathlib

    pathlib.Path(folder).mkdir(parents=True, exist_ok=True)
    pathlib.Path(folder, name).write_text("\n".join([header, *rows]) + "\n")


def test_csv_rows_are_numbered_by_file_name_and_position(spark, tmp_path):
    csv_file(tmp_path, "part-0.csv", [f"HM,a{i},x" for i in range(3)])
    csv_file(tmp_path, "part-1.csv", [f"HM,b{i:05d},x" for i in range(3000)])
    csv_file(tmp_path, "part-2.csv", ["HM,c0,x"])
    want = [f"a{i}" for i in range(3)] + [f"b{i:05d}" for i in range(3000)] + ["c0"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for line_breaks in (True, False):
            df = load_reviews(spark, str(tmp_path), "csv", line_breaks=line_breaks)
            rows = df.orderBy("row_ix").collect()
            assert [r.reviewer_review for r in rows] == want and [r.row_ix for r in rows] == list(range(len(want)))
        one = spark.read.option("header", True).csv(str(tmp_path / "part-1.csv"))
        assert one.rdd.getNumPartitions() > 5  # as a file without line breaks in fields is read
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_columns_go_by_name(spark, tmp_path):
    csv_file(tmp_path, "r.csv", ["9,x,great,HM", "4,y,poor,Zara"], "row_ix,extra,reviewer_review,name")
    rows = load_reviews(spark, str(tmp_path), "csv").orderBy("row_ix").collect()
    assert [(r.row_ix, r.reviewer_review, r.name, r.url) for r in rows] == [(4, "poor", "Zara", None), (9, "great", "HM", None)]


def test_missing_input_raises(spark):
    import pytest
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        load_reviews(spark, "/root/testdata/no-such-folder")


def test_only_small_inputs_are_spread(spark):
    few = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "RoundRobinPartitioning" in spread_small_input(few)._jdf.queryExecution().toString()
    many = spark.range(100).repartition(32)
    assert spread_small_input(many) is many


def test_study_on_published_dictionaries(spark):
    """The defaults run end to end on real-looking English; tables agree with one another."""
    base = [
        "My order never arrived and the delivery was late, customer service ignored every email about it",
        "Refund refused after I returned the dress, the staff were rude and the voucher was useless to me",
        "The jeans were cheap quality and the wrong size, I am very disappointed and want to exchange them",
        "Store manager in store was rude at the checkout and the queue was ridiculous, I was angry all day",
    ]
    names = ["H&M", "Zara", "Shein", "URBAN OUTFITTERS", "Gap"]
    rows = [
        (i, names[i % 5], f"r{i}", f"u{i:04d}", f"title {i}", base[(i * 7) % 4] + f" {i}", str(i % 3 + 1), f"2021-{i % 12 + 1:02d}-05",
         "1 Road", "NZ")
        for i in range(200)
    ]
    raw = spark.createDataFrame(rows, COLUMNS + ", address string, reviewer_country string")
    study = Study(raw, Params(min_topic_size=10, embedding_dim=5, lda_iterations=5))
    folder = scratch_path(spark, "study")
    paths = study.run(folder)
    summary = {r.brand: r for r in load_table(spark, folder, "brand_summary").collect()}
    assert list(summary) == ["H&M", "ZARA", "SHEIN", "Urban Outfitters"]
    assert all(r.n_reviews == 40 for r in summary.values())
    aspects = load_table(spark, folder, "aspect_distribution_by_brand")
    for r in aspects.groupBy("brand").agg(F.sum("n_reviews").alias("n"), F.sum("pct_reviews").alias("p")).collect():
        assert r.n == 40 and abs(r.p - 100) < 1e-9
    assert aspects.count() % 4 == 0 and aspects.filter("aspect_top_category = 'in_store_experience'").count() == 4
    terms = load_table(spark, folder, "topic_terms")
    assert sorted(r["count"] for r in terms.groupBy("topic_id").count().collect()) == [10] * 6
    info = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(paths["bertopic_info"])
    assert sum(int(r.n_reviews) for r in info.collect()) == 200
    public = spark.read.option("header", True).option("escape", '"').csv(paths["study1_scored_reviews_public"])
    assert "reviewer_name" not in public.columns and len(public.columns) == 20 and public.count() == 200

    from reviewloom.plans.publication import export_publication

    out = export_publication(spark, folder, scratch_path(spark, "publication"), study.params, study.reviews)
    table = spark.read.option("header", True).option("escape", '"').csv(out["Study1 Manuscript Table"])
    assert table.count() == 6 and table.filter("linked_construct is not null").count() == 6
    quotes = spark.read.option("header", True).option("escape", '"').csv(out["LDA Representative Quotes"])
    assert quotes.filter("quote_rank > 2").count() == 0 and quotes.count() > 0

    # the same from the written reviews alone
    again = export_publication(spark, folder, scratch_path(spark, "publication"), study.params)
    for name in out:
        one, two = ({r.value for r in spark.read.text(paths[name]).collect()} for paths in (out, again))  # one header per part
        assert one == two, name


def test_shared_folder_comes_from_the_session():
    import pytest

    from reviewloom.session import shared_folder

    class Stub:
        def __init__(self, master, folder):
            self.sparkContext = type("C", (), {"master": master, "applicationId": "stub"})()
            self.conf = type("F", (), {"get": staticmethod(lambda key, default: folder)})()

    assert shared_folder(Stub("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Stub("yarn", None))
    local = Stub("local[2]", None)
    assert shared_folder(local).startswith("/tmp/run-") and shared_folder(local) == shared_folder(local)


def test_written_text_keeps_its_outer_blanks(spark):
    folder = scratch_path(spark, "blanks")
    wr.save_table(spark.createDataFrame([("  a ", "b\t"), (" ", "c ")], "x string, y string"), f"{folder}/t")
    back = load_table(spark, folder, "t", spark.createDataFrame([], "x string, y string").schema)
    assert {tuple(r) for r in back.collect()} == {("  a ", "b\t"), (" ", "c ")}
