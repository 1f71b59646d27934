"""Tables and files that a plan writes and reads again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []
_INNER: list[str] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, as in tests on one machine, a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="recengine-"))
        base = _OWN[0]
    return "/".join([f"{base.rstrip('/')}/recengine", *_INNER])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted at the end: nothing that is read later may depend on it."""
    _INNER.append(f"scratch-{uuid.uuid4().hex}")
    where = folder(spark)
    try:
        yield
    finally:
        _INNER.pop()
        fs, path = pa.fs.FileSystem.from_uri(where)
        if fs.get_file_info(path).type == pa.fs.FileType.Directory:
            fs.delete_dir(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its plan ends there, and Spark knows its size."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    old = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # what was shuffled for the table is nobody's once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if old is None else spark.conf.set(_CLEAN, old)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes what ``kept`` wrote, for tables that only the caller has read; nothing that is read lazily may be left of them."""
    fs, path = pa.fs.FileSystem.from_uri(table.inputFiles()[0].rsplit("/", 1)[0])
    fs.delete_dir(path)


def put(where: str, raw: bytes) -> None:
    """Writes a file of the shared folder from a task; it has its name only when it is whole."""
    fs, path = pa.fs.FileSystem.from_uri(where)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(opened := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(raw)
    fs.move(opened, path)


def get(where: str) -> bytes:
    fs, path = pa.fs.FileSystem.from_uri(where)
    with fs.open_input_file(path) as f:
        return f.read()


def blocks(df: DataFrame, by: str, rows: int) -> list[str]:
    """Files of ``df`` in order of ``by``, of at most ``rows`` rows, that tasks read one after another. The driver gets their names."""
    where = f"{folder(df.sparkSession)}/blocks-{uuid.uuid4().hex}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def done() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as f:
                for b in held:
                    f.write_batch(b)
            put(path := f"{where}/{part}-{number}", sink.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int32()), pa.array([number], pa.int32())], names=["path", "part", "number"])

        for b in batches:
            low = 0
            while low < len(b):
                held.append(b.slice(low, min(len(b) - low, rows - sum(map(len, held)))))
                low += len(held[-1])
                if sum(map(len, held)) >= rows:
                    yield done()
                    held, number = [], number + 1
        if held:
            yield done()

    found = df.repartitionByRange(by).sortWithinPartitions(by).mapInArrow(task, "path string, part int, number int").collect()
    return [r["path"] for r in sorted(found, key=lambda r: (r["part"], r["number"]))]


def placed(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """``df`` with the number (from 1) of each row in a total order, and no task that sees all rows.

    Rows are dealt to tasks by ranges of the order and written; a task's rows are numbered among themselves and begin where the
    counts of the tasks before end: the only pass over everything is over a row for each task.
    """
    dealt = kept(df.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()))
    size = dealt.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = size.select("_task", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_task").orderBy(*order))
    return dealt.join(F.broadcast(before), "_task").withColumn(name, F.col("_before") + own).drop("_task", "_before")
