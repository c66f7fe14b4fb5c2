import subprocess
import sys

import corpus_pipeline
from reviewloom.llm import language, surrogates
from reviewloom.llm.queries import QUERIES
from reviewloom.session import materialise

SF = "/root/testdata/sf0.01"


def stages(spark, docs, sf_dir=SF):
    out = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        out[name] = docs
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_does_what_its_operator_says(spark):
    got = stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    start = got["start"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert got[name].dtypes == start.dtypes
    model = language.fit(start.filter(~language.held_out(start.doc_id)))
    kept = {r.doc_id for r in language.identify(start, model).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert ids(got["language_id"]) == kept and len(kept) > 0.98 * start.count()
    from reviewloom.llm import phrase_index, simhash

    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(got["language_id"]).collect()}
    assert ids(got["simhash_near_dedup"]) == set(classes.values()) and len(set(classes.values())) < len(classes)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = {r.doc_id for r in phrase_index.contamination(got["simhash_near_dedup"], items).collect() if not r.n_hit}
    assert ids(got["benchmark_decontamination"]) == clean and clean < ids(got["simhash_near_dedup"])
    before = {r.doc_id: r for r in got["benchmark_decontamination"].collect()}
    after = {r.doc_id: r for r in got["pii_surrogates"].collect()}
    assert before.keys() == after.keys()
    for i, r in before.items():
        found = surrogates.mentions(r.text)
        assert (after[i].text == r.text) == (not found) and (after[i].lang, after[i].source) == (r.lang, r.source)
        assert all(r.text[a:b] not in after[i].text for a, b, _, _ in found)
        assert after[i].n_chars == (len(after[i].text) if found else r.n_chars)
    pieces = got["best_fit_packing"]
    assert ids(pieces) == set(after) and pieces.columns == QUERIES["op8_best_fit_packing"](spark, SF).columns
    assert pieces.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0


def test_odd_rows_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, gone_id int, later int, lang_pred string, score int, fp int"
    more = ("r", 1, 2, "p", 3, 4)
    rows = [(i, f"plain words number {w} make a text of their own and {w} again", "en", "s", 60, *more) for i, w in enumerate("abcdefgh")]
    rows += [(20, rows[0][1], "en", "s", 60, *more), (3, rows[3][1], "en", "s", 60, *more), (30, None, None, None, None, *more), (31, "", "en", None, 0, *more)]
    rows += [(None, "words without an id but with letters", "en", None, 5, *more), (32, "12 34", "en", "s", 5, *more), (33, "x " * 200_000, "en", "s", 5, *more)]
    rows += [(34, "mail a.b@example.com for words", "en", "s", 5, *more)]
    got = stages(spark, spark.createDataFrame(rows, schema))
    assert ids(got["language_id"]) == {*range(8), 20, None, 33, 34}
    assert sorted(str(r.doc_id) for r in got["simhash_near_dedup"].collect()) == sorted(map(str, [*range(8), None, 33, 34]))
    assert got["pii_surrogates"].dtypes == got["start"].dtypes
    row = got["pii_surrogates"].filter("doc_id = 34").first()
    assert "a.b@" not in row.text and row.row == "r" and row.gone_id == 1 and row.fp == 4
    assert ids(got["best_fit_packing"]) == {*range(8), None, 33, 34}
    empty = stages(spark, spark.createDataFrame([], schema))
    assert all(df.count() == 0 for df in empty.values())


def test_run_is_all_stages(spark):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()))
    want = stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))["best_fit_packing"]
    assert got == sorted(map(tuple, want.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_registered(spark):
    from __spark_entry__ import oracle_sql, queries

    names = [n for n in queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())


def test_sql_agrees(spark):
    from oracle_check import compare, connect

    from reviewloom.llm.oracle import ORACLES

    for sf_dir in ("/root/testdata/sf0.001", SF):
        con = connect(sf_dir)
        for name, sql in ORACLES.items():
            assert compare(spark, con, sf_dir, QUERIES[name], sql) is None, name


def test_the_rest_imports_without_the_subpackage(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "registry", "reviewloom"):
        copy = shutil.copytree if (root / name).is_dir() else shutil.copy
        copy(root / name, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if copy is shutil.copytree else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
