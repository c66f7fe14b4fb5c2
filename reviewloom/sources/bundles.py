"""Bundles of result tables that are committed as a whole.

A bundle lives in one folder.  Every save writes its tables to a new sub-folder, reads the written files once for their
line counts and checksums, and last appends one row to the bundle's manifest: one line in one file, which Spark's
committer shows whole or not at all.  Readers follow the newest row.  A save that dies before its last step leaves the
bundle as it was; its sub-folder is named by no row and may be deleted, as those of earlier saves.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from reviewloom.sources.writers import save_table

NAME_LIMIT = 31  # longest table name the published bundle allows
MANIFEST = "manifest"
MANIFEST_SCHEMA = "version long, save string, tables array<struct<name: string, format: string, n: long, checksum: string>>"


class BundleError(ValueError):
    """The folder holds no bundle, or files that are not those its manifest names."""


def _newest(spark: SparkSession, folder: str) -> Row | None:
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{folder}/{MANIFEST}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows.orderBy(F.desc("version"), F.desc("save")).first()


def _fingerprint(spark: SparkSession, path: str, fmt: str) -> tuple[int, str]:
    """Number of rows (lines of text formats) of a written table, and the sum of their hashes, which has no order."""
    if fmt in ("csv", "json"):
        rows = spark.read.text(path)
    else:
        rows = spark.read.format(fmt).load(path)
    hashes = F.xxhash64(*rows.columns) if rows.columns else F.lit(0)
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(hashes.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))
    return tuple(found.first())


def _folder_of(folder: str, save: str) -> str:
    return f"{folder}/save-{save}"


def save_bundle(tables: dict[str, DataFrame], folder: str, fmt: str = "csv", as_csv: Collection[str] = (), gzip: Collection[str] = ()) -> dict[str, str]:
    """Write every named table and commit them together; returns name -> path.

    Names are cut to ``NAME_LIMIT``; names that collide then are an error, before anything is written.  Tables named in
    ``as_csv`` are CSV whatever ``fmt``, those in ``gzip`` are compressed.  Of two saves at the same time, each whole, the one with the greater id is read.
    """
    cut = {name: name[:NAME_LIMIT] for name in tables}
    if len(set(cut.values())) != len(cut):
        raise ValueError("table names collide after cutting")
    if MANIFEST in cut.values():
        raise ValueError(f"{MANIFEST!r} is no name for a table")
    if not tables:
        raise ValueError("a bundle has at least one table")
    spark = next(iter(tables.values())).sparkSession
    save = uuid.uuid4().hex
    paths = {name: f"{_folder_of(folder, save)}/{short}" for name, short in cut.items()}
    formats = {name: "csv" if name in as_csv else fmt for name in tables}
    for name, df in tables.items():
        save_table(df, paths[name], formats[name], "gzip" if name in gzip else None)
    listed = [(cut[name], formats[name], *_fingerprint(spark, path, formats[name])) for name, path in paths.items()]
    before = _newest(spark, folder)
    row = (before.version + 1 if before else 1, save, listed)
    spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/{MANIFEST}")
    return paths


def current_folder(spark: SparkSession, folder: str) -> str:
    """Where the tables of ``folder`` are: in its newest whole save if it is a bundle, else in the folder itself."""
    newest = _newest(spark, folder)
    return _folder_of(folder, newest.save) if newest else folder


def open_bundle(spark: SparkSession, folder: str, check: Collection[str] | None = None) -> str:
    """The folder with the tables of the newest whole save, ``<folder>/<table>`` each.

    The tables named in ``check`` (default: all) are read once and compared with the manifest.
    """
    newest = _newest(spark, folder)
    if newest is None:
        raise BundleError(f"no bundle in {folder}")
    at = _folder_of(folder, newest.save)
    listed = {t.name: t for t in newest.tables}
    for name in listed if check is None else check:
        if name not in listed:
            raise BundleError(f"the bundle in {folder} has no table {name}")
        try:
            found = _fingerprint(spark, f"{at}/{name}", listed[name].format)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise BundleError(f"table {name} of the bundle in {folder} is missing") from e
        if found != (listed[name].n, listed[name].checksum):
            raise BundleError(f"table {name} of the bundle in {folder} is not as its manifest says: {found}")
    return at
