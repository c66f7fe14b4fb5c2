"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import ctypes
import functools
import pathlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings results depend on.  Dates are UTC throughout.  Shuffle files are deleted as soon as their query has ended, and
    not when the driver next collects garbage."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()
#: Bytes of a batch handed to Python in a task, unless the cluster sets its own; rows may hold long texts.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in tasks, once an application; Spark hands the archive to executors.
    Also bounds the batches that tasks hand to Python."""
    sc = spark.sparkContext
    if not sc.getConf().contains(ARROW_BATCH[0]):
        spark.conf.set(*ARROW_BATCH)
    if sc.applicationId not in _SHIPPED:
        package = pathlib.Path(__file__).parent
        archive = f"{tempfile.mkdtemp(prefix='package-')}/{package.name}"
        sc.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
        _SHIPPED.add(sc.applicationId)


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Only a local[...] session falls back to /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/reviewloom-{uuid.uuid4().hex}/{name}"


#: Compression of written tables that hold whole texts, several times over: much smaller than the default.
TEXTS = "zstd"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives Catalyst the real size of the table,
    so a join with it is broadcast only when it is under ``autoBroadcastJoinThreshold``.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, compression))


#: Tables written while a stage is planned and written, until that stage is done.
_ON_THE_WAY: ContextVar[list[str] | None] = ContextVar("_ON_THE_WAY", default=None)


def write_table(df: DataFrame, name: str, compression: str | None = None, **options) -> str:
    """Write ``df`` to a new folder in the shared folder; returns its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path, compression=compression)
    on_the_way = _ON_THE_WAY.get()
    if on_the_way is not None:
        on_the_way.append(path)
    return path


def materialise_stage(plan: Callable[[], DataFrame], name: str, compression: str | None = None) -> DataFrame:
    """``materialise`` the table that ``plan()`` makes, then delete the tables written on the way to it.

    Only that one table may read them: whatever else ``plan`` reads has to be written before.
    """
    token = _ON_THE_WAY.set([])
    try:
        df = plan()
        on_the_way = _ON_THE_WAY.get()
    finally:
        _ON_THE_WAY.reset(token)
    done = materialise(df, name, compression)
    for path in on_the_way:
        drop_table(df.sparkSession, path)
    return done


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``write_table``, with the folder made for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, and the path in it, for tasks."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def shared_rows(uri: str, **scan) -> Iterator[dict]:
    """The rows of a Parquet table in the shared folder, one at a time: for tables of few, large rows."""
    fs, path = file_system(uri)
    for fragment in ds.dataset(path, filesystem=fs, format="parquet").get_fragments():
        for batch in fragment.to_batches(batch_size=1, batch_readahead=1, fragment_readahead=1, **scan):
            yield from batch.to_pylist()


#: For ``write_table``: row groups of some MB, so that a task can read a few rows of a large table.
SMALL_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}


class SharedTable:
    """A Parquet table of large rows in the shared folder, for tasks that read rows by a column of whole numbers that its
    files are sorted by.  Only row groups whose least and greatest numbers enclose one asked for are read."""

    def __init__(self, uri: str):
        self.fs, path = file_system(uri)
        files = self.fs.get_file_info(pafs.FileSelector(path))
        names = sorted(f.path for f in files if f.is_file and not f.base_name.startswith(("_", ".")))
        self.files = [(name, pq.read_metadata(name, filesystem=self.fs)) for name in names]
        self.bounds: dict[str, np.ndarray] = {}

    def _bounds(self, key: str) -> np.ndarray:
        """file, row group, least and greatest ``key``."""
        if key not in self.bounds:
            found = []
            for i, (_, meta) in enumerate(self.files):
                at = meta.schema.to_arrow_schema().names.index(key)  # flat columns come before nested ones
                for g in range(meta.num_row_groups):
                    stats = meta.row_group(g).column(at).statistics
                    found.append((i, g, stats.min, stats.max))
            self.bounds[key] = np.array(found, np.int64).reshape(-1, 4)
        return self.bounds[key]

    def rows(self, key: str, wanted: np.ndarray) -> Iterator[dict]:
        """The rows whose ``key`` is one of ``wanted`` (sorted), in the order of the files; lists as arrays."""
        bounds = self._bounds(key)
        inside = np.searchsorted(wanted, bounds[:, 2]) < np.searchsorted(wanted, bounds[:, 3], "right")
        opened, file = None, None
        for i, g in bounds[inside, :2].tolist():
            if opened != i:
                name, meta = self.files[i]
                opened, file = i, pq.ParquetFile(self.fs.open_input_file(name), metadata=meta)
            table = file.read_row_group(g).combine_chunks()
            for j in np.flatnonzero(np.isin(table.column(key).to_numpy(), wanted)).tolist():
                yield {c: _value(table.column(c)[j]) for c in table.column_names}


def _value(scalar: pa.Scalar):
    return scalar.values.to_numpy() if isinstance(scalar, pa.ListScalar) else scalar.as_py()


@functools.lru_cache(maxsize=4)
def shared_table(uri: str) -> SharedTable:
    """The table of a path, whose footers a worker reads once."""
    return SharedTable(uri)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *clear: Callable[[], None]) -> Callable:
    """``run`` for ``mapInArrow``, calling ``clear`` and handing freed memory back to the system when a task ends.

    Spark keeps Python workers for later tasks and stages; what the allocators of an idle worker hold is lost to
    the executor.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for forget in clear:
                forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped
