"""CSV whose quoted fields may hold line breaks, read in splits.

Files are read as lines, in splits like any text.  Whether a line starts a record depends on whether the number of
quotes before it in its file is even.  A first pass counts for each split its quotes and the records it would start
either way; running sums over that table of splits, one row each, say for every split where it begins and what number
its first record has.  A second pass joins the lines of each record.  Only the pieces of records that cross the edge
of a split are put together by a shuffle.

Fields follow RFC 4180: quotes stand around a whole field, and inside it they are doubled.  A quote within an
unquoted field is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.session import materialise

_PIECE = "file_path string, file_block_start long, ordinal long, row_ix long, kind int, text string"
#: Kinds of pieces: a whole record, the begin of one that goes on behind its split, and what goes on.
_WHOLE, _BEGIN, _REST = range(3)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.monotonically_increasing_id().alias("at"), "_metadata.file_path", "_metadata.file_block_start")


def _split_runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Runs of lines of one split."""
    block = batch.column("file_block_start").to_numpy()
    file = batch.column("file_path").dictionary_encode()
    change = np.flatnonzero((np.diff(block) != 0) | (np.diff(file.indices.to_numpy()) != 0)) + 1
    bounds = [0, *change.tolist(), batch.num_rows]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a < b:
            yield (batch.column("file_path")[a].as_py(), int(block[a])), batch.slice(a, b - a)


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.or_(pc.equal(lines, ""), pc.equal(lines, "\r")).to_numpy(zero_copy_only=False)


def _splits(lines: DataFrame) -> DataFrame:
    """(file_path, file_block_start, inside, ordinal, file_base): whether a split begins inside quotes, the place of its
    first record in the file, and the rows of all files before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for split, part in _split_runs(batch):
                mine = rows.setdefault(split, [0, 0, 0])
                quotes = _quotes(part.column("value"))
                before = (mine[0] + np.cumsum(quotes) - quotes) % 2
                text = ~_blank(part.column("value"))
                mine[0] += int(quotes.sum())
                mine[1] += int((text & (before == 0)).sum())
                mine[2] += int((text & (before == 1)).sum())
        if rows:
            columns = [[f for f, _ in rows], [b for _, b in rows], *zip(*rows.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file_path", "file_block_start", "quotes", "even", "odd"])

    schema = "file_path string, file_block_start long, quotes long, even long, odd long"
    counted = materialise(lines.drop("at").mapInArrow(run, schema), "csv_splits")
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("inside", F.coalesce(F.sum("quotes").over(before) % 2, F.lit(0)))
    counted = counted.withColumn("records", F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd")))
    counted = counted.withColumn("ordinal", F.coalesce(F.sum("records").over(before), F.lit(0)))
    files = counted.groupBy("file_path").agg((F.greatest(F.sum("records"), F.lit(1)) - 1).alias("rows"))
    earlier = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("file_path", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("file_base"))
    return counted.join(files, "file_path").select("file_path", "file_block_start", "inside", "ordinal", "file_base")


class _Split:
    """The records of one split, fed line by line."""

    def __init__(self, key: tuple[str, int], row: dict):
        self.key, self.state, self.ordinal, self.base = key, row["inside"], row["ordinal"], row["file_base"]
        self.held: pa.Array | None = None  # lines of a record that is not closed yet
        self.head = bool(self.state)  # whether they belong to a record of an earlier split

    def feed(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        quotes = _quotes(lines)
        before = (self.state + np.cumsum(quotes) - quotes) % 2
        self.state = int((self.state + quotes.sum()) % 2)
        starts = np.flatnonzero(before == 0)
        if self.held is not None or (len(starts) and starts[0]) or not len(starts):
            first = int(starts[0]) if len(starts) else len(lines)
            open_lines = lines.slice(0, first)
            self.held = open_lines if self.held is None else pa.concat_arrays([self.held, open_lines])
            if not len(starts):
                return
            yield from self._put(pa.array(["\n".join(self.held.to_pylist())]), _REST if self.head else _WHOLE)
            self.held, self.head = None, False
        last = len(starts) - 1 if self.state else len(starts)  # the last record goes on
        offsets = pa.array(np.append(starts, len(lines))[: last + 1].astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n") if last else pa.array([], pa.string())
        yield from self._put(joined.filter(pa.array(~_blank(joined))), _WHOLE)
        if self.state:
            self.held = lines.slice(int(starts[-1]))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            yield from self._put(pa.array(["\n".join(self.held.to_pylist())]), _REST if self.head else _BEGIN)

    def _put(self, texts: pa.Array, kind: int) -> Iterator[pa.RecordBatch]:
        n = len(texts)
        if not n:
            return
        ordinal = np.full(n, -1) if kind == _REST else self.ordinal + np.arange(n)
        self.ordinal += 0 if kind == _REST else n
        columns = [[self.key[0]] * n, [self.key[1]] * n, ordinal, self.base + ordinal - 1, np.full(n, kind, np.int32), texts]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _PIECE.split(", ")])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split: _Split | None = None
    for batch in batches:
        for key, part in _split_runs(batch):
            if split is None or split.key != key:
                if split is not None:
                    yield from split.end()
                split = _Split(key, part.slice(0, 1).to_pylist()[0])
            yield from split.feed(part.column("value"))
    if split is not None:
        yield from split.end()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(row_ix, text): the records of CSV files with a header each, numbered by file name and position.

    Blank lines between records are none.  The records are written once, to the shared folder.
    """
    lines = _lines(spark, path)
    where = ["file_path", "file_block_start"]
    placed = lines.join(_splits(lines), where).sortWithinPartitions(*where, "at").drop("at")
    pieces = materialise(placed.mapInArrow(_pieces, _PIECE), "csv_records")
    in_file = Window.partitionBy("file_path").orderBy("file_block_start", F.desc("kind"))  # at most two pieces a split
    owner = F.last(F.when(F.col("kind") == _BEGIN, F.col("file_block_start")), ignorenulls=True).over(in_file)
    crossing = pieces.filter(F.col("kind") != _WHOLE).withColumn("owner", owner)
    parts = F.array_sort(F.collect_list(F.struct("file_block_start", "text")))
    crossing = crossing.groupBy("file_path", "owner").agg(
        F.max("ordinal").alias("ordinal"), F.max("row_ix").alias("row_ix"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text")
    )
    columns = ["ordinal", "row_ix", "text"]
    whole = pieces.filter(F.col("kind") == _WHOLE).select(*columns).unionByName(crossing.select(*columns))
    return whole.filter("ordinal > 0").select("row_ix", F.regexp_replace("text", r"\r\z", "").alias("text"))


def read_split_csv(spark: SparkSession, path: str, names: list[str], options: dict) -> DataFrame:
    """``row_ix`` and a struct ``row`` of the string columns ``names`` of CSV files, parsed by Spark with ``options``."""
    records = read_records(spark, path)
    stray = F.col("text").rlike(r'[^,"]"[^,"]')
    error = F.raise_error(F.concat(F.lit("a quote inside an unquoted field: "), F.substring("text", 1, 200)))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = records.select("row_ix", F.from_csv(F.when(stray, error.cast("string")).otherwise(F.col("text")), schema, options).alias("row"))
    return parsed.select("row_ix", F.struct(*[F.col(f"row.c{i}").alias(name) for i, name in enumerate(names)]).alias("row"))
