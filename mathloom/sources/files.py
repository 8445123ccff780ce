"""Files in and out.

Between stages tables are Parquet.  CSV is read and written byte for byte where texts are hashed:
Spark's own CSV reader turns ``\\r\\n`` inside quotes into ``\\n`` and empty cells into nulls.  One
file is read by one task, so a large CSV table should be many files.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mathloom.operators.keyed import require
from mathloom.scratch import exists, filesystem

#: Rows of one Arrow batch of a CSV file, and characters of a piece that is written at once.
_BATCH, _CHUNK = 2000, 1_000_000


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).first()
    if first is None:
        return []
    return next(csv.reader([first[0].removeprefix("﻿")]), [])


def read_csv(spark: SparkSession, path: str, required: list[str] = (), exact: bool = False) -> DataFrame:
    """All columns as strings, in file order by ``row_no`` (file number and place), byte for byte.

    Takes a byte-order mark, doubled quotes and line ends inside quotes; an empty cell is ``''``.
    A header-only file gives no rows; missing required columns raise.  Files of one folder must
    have the same header.
    """
    columns = _header(spark, path)
    if required:
        missing = sorted(set(required) - set(columns))
        if missing or exact and columns != list(required):
            raise ValueError(f"missing columns {missing}" if missing else f"columns {columns}, not {list(required)}")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("row_no", T.LongType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""))
                next(reader, None)
                rows: list[list] = []
                for i, cells in enumerate(x for x in reader if x):
                    cells = (cells + [None] * len(columns))[: len(columns)]
                    rows.append([*cells, (number << 40) + i])
                    if len(rows) == _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    names = schema.names
    kinds = [pa.string()] * len(columns) + [pa.int64()]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    # Names are numbered in one task, a few bytes each; contents stay where they are read.
    number = (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("n")
    return files.join(files.select("path").select("path", number), "path").select("n", "content").mapInArrow(parse, schema)


def read_or_empty(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table, or no rows where the file is missing or empty."""
    fs, hadoop_path = filesystem(spark, path)
    if fs.exists(hadoop_path) and fs.getContentSummary(hadoop_path).getLength():
        return read_csv(spark, path)
    return spark.createDataFrame([], T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("row_no", T.LongType())]))


def read_parquet(spark: SparkSession, path: str, required: list[str] = (), exact: bool = False) -> DataFrame:
    return require(spark.read.parquet(path), list(required), exact)


def guard(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Raises if the output exists, on whatever file system, and may not be overwritten."""
    if not overwrite and exists(spark, path):
        raise FileExistsError(f"output exists: {path}")


def _put(spark: SparkSession, path: str, chunks: Iterator[bytes]) -> None:
    """Bytes to a file of any file system, written beside its place and moved into it."""
    fs, target = filesystem(spark, path)
    beside = filesystem(spark, f"{path}.tmp")[1]
    stream = fs.create(beside, True)
    try:
        for chunk in chunks:
            stream.write(bytearray(chunk))
    finally:
        stream.close()
    fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"can't move the output into place: {path}")


def write_csv(df: DataFrame, path: str, order: str = "row_no", overwrite: bool = False, mark: bool = True, drop_order: bool = True) -> int:
    """One CSV file, written beside its place and moved into it; returns the number of rows.

    ``mark``: begin with a byte-order mark.  Rows arrive a partition at a time in the order of
    ``order``; booleans are written as True and False, nulls as empty cells.
    """
    spark = df.sparkSession
    guard(spark, path, overwrite)
    ordered = df.orderBy(order)
    columns = [c for c in df.columns if not (drop_order and c == order)]
    rows = 0

    def chunks() -> Iterator[bytes]:
        nonlocal rows
        text = io.StringIO(newline="")
        writer = csv.writer(text)
        writer.writerow(columns)
        if mark:
            yield b"\xef\xbb\xbf"
        for r in ordered.select(*columns).toLocalIterator(prefetchPartitions=True):
            writer.writerow(["" if x is None else x for x in r])
            rows += 1
            if text.tell() > _CHUNK:
                yield text.getvalue().encode()
                text.seek(0)
                text.truncate()
        yield text.getvalue().encode()

    _put(spark, path, chunks())
    return rows


def write_parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """One committed batch of an output that grows."""
    df.write.mode("append").parquet(path)


def summary(df: DataFrame) -> dict:
    """A one-row aggregate as a dictionary."""
    row = df.first()
    return row.asDict(recursive=True) if row else {}


def summary_path(output: str) -> str:
    return re.sub(r"\.[^./]*$", "", output) + ".summary.json"


def write_summary(spark: SparkSession, values: dict, output: str) -> str:
    """JSON beside an output, indented, with a final newline."""
    path = summary_path(output)
    _put(spark, path, iter([(json.dumps(values, indent=2, default=str) + "\n").encode()]))
    return path


def display_path(path: str, base: str) -> str:
    """The path from ``base`` on where it lies below it, the whole path elsewhere."""
    inside = posixpath.relpath(path, base) if path.startswith("/") == base.startswith("/") else ".."
    return path if inside.split("/")[0] == ".." else inside


def read_summary(spark: SparkSession, path: str, *keys: str, default=None):
    """A value of a JSON file by its path of keys, or the default where one is absent."""
    value = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    for k in keys:
        if not isinstance(value, dict) or k not in value:
            return default
        value = value[k]
    return value


def checkpoint_step(name: str) -> int:
    """Number at the end of a checkpoint's name, or -1."""
    tail = name.rsplit("-", 1)[-1]
    return int(tail) if tail.isdigit() else -1


def checkpoints(spark: SparkSession, folder: str) -> list[str]:
    """Complete checkpoints (those with a trainer state), earliest step first."""
    fs, hadoop_path = filesystem(spark, folder)
    if not fs.exists(hadoop_path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(hadoop_path) if x.isDirectory()]
    found = [n for n in names if n.startswith("checkpoint-") and exists(spark, f"{folder}/{n}/trainer_state.json")]
    return [f"{folder}/{n}" for n in sorted(found, key=checkpoint_step)]
